"""Properties: identities between operators, skew handling, partition-count invariance."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stepjudge.operators import metrics as M
from stepjudge.operators import ranking as RK
from stepjudge.operators import rows as R
from stepjudge.operators import sequences as SQ
from stepjudge.operators import steps as ST
from stepjudge.operators import votes as V
from stepjudge.sources import fixtures as X

from conftest import SF_SMALL


def test_weighted_equals_majority_with_equal_scores(spark):
    c = X.cand(spark, SF_SMALL).withColumn("score", F.lit(1).cast("decimal(18,6)"))
    w = V.vote_weighted(c).select("problem_id", "pred_key")
    m = V.vote_majority(c).select("problem_id", "pred_key")
    assert w.exceptAll(m).count() == 0 and m.exceptAll(w).count() == 0


def test_pass_at_1_is_c_over_n(spark):
    c = X.cand(spark, SF_SMALL)
    p = M.problem_pass_at_k(c, [1]).withColumn("d", F.abs(F.col("pass_at_k") - F.col("n_correct") / F.col("n_samples")))
    assert p.agg(F.max("d")).first()[0] < 1e-12


def test_coverage_non_decreasing(spark):
    cov = [r.cov for r in M.coverage(X.cand(spark, SF_SMALL), [1, 2, 4, 8]).orderBy("n").collect()]
    assert cov == sorted(cov)


def test_flagship_matches_expected(spark):
    t = {r.n: r for r in M.scaling_table(X.cand(spark, SF_SMALL), [1, 2, 4, 8]).collect()}
    # expected numbers of the minimum slice at sf 0.001 (FIXTURES §5)
    assert t[8].problems == 1473
    assert round(t[8].acc_naive, 6) == 33.536999
    assert round(t[8].acc_weighted, 6) == 34.758995
    assert round(t[8].acc_maj, 6) == 35.437882
    assert round(t[8].cov, 6) == 74.677529
    assert round(t[2].acc_naive, 6) == 33.061779


def test_repair_labels_idempotent(spark):
    s = X.steps(spark, SF_SMALL)
    once = ST.repair_labels(s).select("problem_id", "step_idx", F.col("label").alias("gt_label"))
    twice = ST.repair_labels(once).select("problem_id", "step_idx", "label")
    assert once.withColumnRenamed("gt_label", "label").exceptAll(twice).count() == 0


def test_long_wide_round_trip(spark):
    c = X.cand(spark, SF_SMALL).select("problem_id", "idx", "answer")
    back = R.to_long(R.to_wide(c, ["problem_id"], ["answer"]), ["problem_id"], ["answer"])
    assert c.exceptAll(back.select("problem_id", "idx", "answer")).count() == 0


def test_numbering_with_a_hot_key(spark):
    """A key holding a third of all rows is split across slices and still numbered exactly."""
    n = 30000
    df = spark.range(n).withColumn("g", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97 + 1))
    got = RK.number_within(df, ["g"], ["id"], "rn", hot_rows=1000)  # group 0 is hot, the rest are not
    exp = df.withColumn("rn2", F.row_number().over(Window.partitionBy("g").orderBy("id")))
    j = got.join(exp, ["id", "g"])
    assert j.count() == n and j.filter("rn != rn2").count() == 0


def test_same_result_for_1_and_8_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        res = []
        for p in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", p)
            res.append(sorted(M.scaling_table(X.cand(spark, SF_SMALL), [1, 2, 4]).collect()))
        assert res[0] == res[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_running_max_matches_window(spark):
    df = spark.range(5000).withColumn("v", (F.col("id") * 7919) % 1000)
    got = RK.running(df, [], ["id"], {"m": ("max", "v")}, hot_rows=100)  # force range slices
    exp = df.withColumn("m2", F.max("v").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)))
    assert got.join(exp, "id").filter("m != m2").count() == 0


def test_top_k_with_hot_group(spark):
    df = spark.range(20000).withColumn("g", F.when(F.col("id") < 10000, F.lit(0)).otherwise(F.col("id") % 50 + 1))
    top = RK.top_k_within(df, ["g"], [F.col("id").desc()], 3, "rank")  # group 0 spread over the salt buckets
    hot = [r.id for r in top.filter("g = 0").orderBy("rank").collect()]
    assert hot == [9999, 9998, 9997]


def test_padding_keeps_rows_of_equal_and_null_keys(spark):
    rows = [(1, "a", [1]), (1, "b", [1, 2]), (None, "c", [1, 2, 3]), (None, "d", []), (2, "e", [5, 6]), (2, "e", [5, 6])]
    df = spark.createDataFrame(rows, "doc_id long, name string, ids array<int>")
    got = SQ.pad_batches(df, ["doc_id"], 2, {"ids": 0}).collect()
    assert sorted(r.name for r in got) == [r[1] for r in rows]
    batches = {}
    for r in got:
        batches.setdefault(r.batch_id, []).append(r)
    assert [sorted(r.name for r in batches[k]) for k in range(3)] == [["c", "d"], ["a", "b"], ["e", "e"]]
    assert [{len(r.ids) for r in batches[k]} for k in range(3)] == [{3}, {2}, {2}]


def test_balance_equal_classes(spark):
    df = spark.range(1000).withColumn("y", F.col("id") % 4 == 0)
    b = R.balance(df, "y", 3, ["id"])
    counts = {r.y: r["count"] for r in b.groupBy("y").count().collect()}
    assert counts == {True: 250, False: 250}


def test_kendall_matches_pairs(spark):
    rows = [(0, float(s), int(y)) for s, y in [(0.1, 0), (0.4, 1), (0.4, 0), (0.9, 1), (0.2, 1), (0.2, 0)]]
    df = spark.createDataFrame(rows, "g long, x double, y int")
    tau = M.kendall_binary(df, ["g"], "x", F.col("y")).first().kendall
    pairs = [(a, b) for i, a in enumerate(rows) for b in rows[i + 1:]]
    nc = sum(1 for a, b in pairs if (a[1] - b[1]) * (a[2] - b[2]) > 0)
    nd = sum(1 for a, b in pairs if (a[1] - b[1]) * (a[2] - b[2]) < 0)
    tx = sum(1 for a, b in pairs if a[1] == b[1] and a[2] != b[2])
    ty = sum(1 for a, b in pairs if a[2] == b[2] and a[1] != b[1])
    assert abs(tau - (nc - nd) / ((nc + nd + tx) * (nc + nd + ty)) ** 0.5) < 1e-12


def test_sliced_numbering_matches_window_on_fixture(spark):
    """The hot-group path (forced with a tiny bound) gives the plain window's numbers."""
    li = X.table(spark, SF_SMALL, "lineitem").select("l_orderkey", *X.LINE_ORDER)
    a = RK.number_within(li, ["l_orderkey"], X.LINE_ORDER, "rn", hot_rows=3)
    b = RK.number_within(li, ["l_orderkey"], X.LINE_ORDER, "rn")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
