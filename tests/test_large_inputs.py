"""Steps that met the limits on larger tables: the same rows by another path, and plans without the former fault."""

from pyspark.sql import functions as F

from stepjudge.operators import rows as R
from stepjudge.operators import steps as ST
from stepjudge.plans import curate as K
from stepjudge.sources import fixtures as X

from conftest import SF_SMALL


def _rows(df):
    return sorted(df.collect(), key=repr)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_align_steps_never_broadcasts(spark):
    v = spark.createDataFrame([(1, 0, 0, "+"), (1, 0, 1, "-"), (2, 0, 0, "+")], "problem_id int, gen_idx int, step_idx int, verdict string")
    s = spark.createDataFrame([(1, 0, "+"), (2, 0, "-"), (2, 1, "-")], "problem_id int, step_idx int, gt_label string")
    a = ST.align_steps(v, s)
    assert "BroadcastHashJoin" not in _plan(a)
    assert _rows(a.select("problem_id", "gen_idx", "gt_label")) == [(1, 0, "+"), (2, 0, "-")]
    assert "BroadcastHashJoin" not in _plan(a)  # nor once sizes are known


def test_generations_need_no_verdict_table(spark):
    built = X._build_gen(spark, SF_SMALL)
    assert _rows(built) == _rows(X._build_gen(spark, SF_SMALL, X.verd(spark, SF_SMALL)))
    assert "gen_idx" not in [c for line in _plan(built).splitlines() if "Exchange" in line for c in line.split()]


def test_balance_writes_no_texts(spark):
    df = spark.range(1000).select((F.col("id") % 10 > 2).alias("y"), "id", F.repeat(F.lit("x"), 100).alias("text"))
    b = R.balance(df, "y", 3, ["id"])
    assert b.columns == df.columns and [r["count"] for r in b.groupBy("y").count().collect()] == [300, 300]
    assert "Window" not in _plan(b) and "Scan ExistingRDD" not in _plan(b)
    u = df.filter("y").withColumn("u", R.hash_unit(3, "id")).orderBy("u", "id").limit(300)
    assert _rows(b.filter("y").select("id")) == _rows(u.select("id"))


def test_balance_with_equal_keys_and_no_labels(spark):
    rows = [(True, 1)] * 7 + [(False, 2)] * 3 + [(None, 3)] * 5 + [(None, None)]
    b = R.balance(spark.createDataFrame(rows, "y boolean, id int"), "y", 3, ["id"])
    assert sorted(map(str, [r["y"] for r in b.collect()])) == ["False"] * 3 + ["None"] * 3 + ["True"] * 3
    assert R.balance(spark.createDataFrame([(True, 1)], "y boolean, id int"), "y", 3, ["id"]).count() == 0


def test_class_counts_shuffle_no_texts(spark):
    s, g = X.steps(spark, SF_SMALL), X.gen(spark, SF_SMALL).select("problem_id", "gen_idx", F.col("boxed_text").alias("text"))
    plan = _plan(K.curate_long_chains(s, g).groupBy("is_correct").count())
    assert not [line for line in plan.splitlines() if "Sort [" in line and "text" in line]


def test_preference_pairs_texts_meet_their_pairs(spark):
    steps = spark.createDataFrame([(p, i, f"s{i}", "+") for p in (1, 2) for i in (0, 1)], "problem_id int, step_idx int, step string, gt_label string")
    line = lambda i, ok: f"Step {i + 1}: checked. Correct? {'Yes' if ok else 'No'}."
    chain = lambda *oks: "\n".join(line(i, ok) for i, ok in enumerate(oks))
    gens = [(1, 0, chain(1, 1)), (1, 1, chain(0, 1)), (1, 2, chain(0, 0)), (1, 3, chain(1, 1)), (1, 4, "Step 1: Correct? maybe\n" + line(1, 1)), (2, 0, chain(1, 1)), (2, 1, None)]
    p = K.preference_pairs(steps, spark.createDataFrame(gens, "problem_id int, gen_idx int, text string"), k=3)
    got = [tuple(r) for r in p.select("problem_id", "rank", "chosen_gen", "rejected_gen", "n_wrong", "chosen_cot", "rejected_cot", "solution").orderBy("rank").collect()]
    assert got == [(1, 1, 0, 2, 2, chain(1, 1), chain(0, 0), "s0\ns1"), (1, 2, 3, 1, 1, chain(1, 1), chain(0, 1), "s0\ns1")]


def test_cap_meets_texts_by_solution(spark):
    df = spark.createDataFrame([(1, i, f"t{i}", None if i != 1 else "bad_format") for i in range(4)] + [(2, 0, "u", None)],
                               "problem_id int, gen_idx int, text string, reject_reason string")
    assert [(r[0], r[1]) for r in K._cap(df, 2, False).orderBy("problem_id", "gen_idx").collect()] == [(1, 0), (1, 2), (2, 0)]
    marked = K._cap(df, 2, True).orderBy("problem_id", "gen_idx").collect()
    assert [r["reject_reason"] for r in marked] == [None, "bad_format", None, "over_cap", None]


def test_best_of_n_writes_no_texts_but_of_the_best(spark):
    from stepjudge.operators import search as SE

    rows = [(1, 0, None, "r ", 0.0, None)] + [(1, i, i - 1, f"n{i} ", float(i % 5), "EOS" if i == 6 else None) for i in range(1, 10)] + [(1, 20, 3, "x", 9.0, None)]
    rows += [(1, 21, 2, None, 8.0, None), (2, 0, None, "alone", 1.0, None)]
    tree = spark.createDataFrame(rows, "problem_id int, node_id long, parent_id long, text string, score double, stop_reason string")
    tables = []
    follow = SE.follow
    SE.follow = lambda start, step, *a: tables.append(step) or follow(start, step, *a)
    try:
        b = SE.best_paths(tree, keep=1, n=3, rounds=16, strategy="best_of_n")
    finally:
        SE.follow = follow
    assert "text" not in tables[0].schema.simpleString()
    got = [tuple(r) for r in b.select("problem_id", "rank", "node_id", "path", "depth").orderBy("problem_id", "rank").collect()]
    assert got == [(1, 1, 20, "r n1 n2 n3 x", 4), (1, 2, 21, None, 3), (1, 3, 6, "r n1 n2 n3 n4 n5 n6 ", 6), (2, 1, 0, "alone", 0)]


def test_layouts_meet_answers_with_their_question_alone(spark):
    from stepjudge.plans import benchmarks as B

    mix = spark.createDataFrame([(1, " q ", "x", "Yes", "no"), (2, "p", "y", "", "7.0"), (3, None, "z", None, None)], "id int, question string, other string, choice_answer string, answer string")
    tables = {"gaokao2024_mix": mix, "amc23": mix, "carp_en": mix.withColumnRenamed("question", "content")}
    joined = B.questions_and_answers(tables, ["id"])
    assert _plan(joined).count("Join") == 1
    one_by_one = [B.question_text(B.gold_answer(t, name), name, gold="gold").select(F.lit(name), "id", "question", "gold") for name, t in tables.items()]
    assert _rows(joined) == _rows(one_by_one[0].union(one_by_one[1]).union(one_by_one[2]))
    assert joined.columns == ["layout", "id", "question", "gold"]


def test_short_keys_tell_answers_apart(spark):
    from stepjudge.functions.answers import normalize_answers

    long = "1" * 40
    df = spark.createDataFrame([(0, long), (1, "1"), (2, None), (3, ""), (4, "1")], "id int, a string")
    df = df.unionByName(spark.range(1).select(F.lit(5).alias("id"), F.md5(F.lit(long)).alias("a")))
    got = {r["id"]: r["n"] for r in normalize_answers(df, "a", "n").collect()}
    assert got[0] == long and got[1] == got[4] == "1" and got[2] is None and got[3] == "" and got[5] != long
    assert "md5" not in [line for line in _plan(normalize_answers(df.filter("length(a) < 3"), "a", "n")).splitlines() if "Exchange" in line]


def test_subtrees_write_one_row_per_family(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    from stepjudge.operators import search as SE

    rows = [(1, 0, None, "r ", 0.0, None)] + [(1, i, (i - 1) // 2, f"n{i} ", float(i % 3), "EOS" if i == 9 else None) for i in range(1, 15)]
    rows += [(2, 0, None, "alone", 1.0, None), (3, 0, None, "box", 1.0, None), (3, 1, 0, "ed{ ", 1.0, None), (3, 2, 1, "x", 1.0, None)]
    tree = spark.createDataFrame(rows, "problem_id int, node_id long, parent_id long, text string, score double, stop_reason string")
    written, checkpoint = [], Classic.checkpoint
    monkeypatch.setattr(Classic, "checkpoint", lambda df, eager=True: written.append(df) or checkpoint(df, eager))
    b = SE.best_paths(tree, keep=2, n=4, rounds=4, strategy="dvts", lookahead=2)
    got = [tuple(r) for r in b.select("problem_id", "subtree", "rank", "node_id", "path", "score", "depth", "completed").orderBy("problem_id", "subtree", "rank").collect()]
    assert got == [
        (1, 1, 1, 8, "r n1 n3 n8 ", 2.0, 3, True), (1, 1, 2, 7, "r n1 n3 n7 ", 1.0, 3, True),
        (1, 2, 1, 11, "r n2 n5 n11 ", 2.0, 3, True), (1, 2, 2, 12, "r n2 n5 n12 ", 0.0, 3, True),
        (3, 1, 1, 1, "boxed{ ", 1.0, 1, True)]
    wide = [df for df in written if "_text" in df.columns or "text" in df.columns]
    assert not wide and sum("_kids" in df.columns for df in written) == 1


def test_sequences_group_steps_once(spark):
    from stepjudge.operators.sequences import step_sequences

    tok = lambda c: F.transform(F.split(c, r"\s+"), lambda w: F.length(w))
    steps = spark.createDataFrame([(1, 0, "a", "+"), (1, 1, "bb", "-"), (1, 2, "c", "+"), (1, 2, "c", "-"), (2, 0, "d", "+"), (None, 0, "e", "+")], "p int, i int, s string, l string")
    qs = spark.createDataFrame([(1, "q", "-"), (1, "qq", "+"), (None, "n", "+"), (9, "none", "+")], "p int, q string, sol string")
    out = step_sequences(steps, qs, ["p"], "i", "s", "l", "q", tokenize=tok, pos_id=7, solution_label="sol")
    assert "Join" not in _plan(out)
    got = sorted(out.collect(), key=lambda r: r["input_ids"])
    assert [r["p"] for r in got] == [1, 1] and [r["input_ids"][0] for r in got] == [1, 2]
    assert got[0]["labels"] == [0] + [0, 0, 0, 0, 3] * 4 and got[1]["labels"] == [0] + [0, 0, 0, 0, 7] * 4
    assert got[0]["loss_mask"] == [0] + [0, 0, 0, 0, 1] * 4 and got[0]["loss_mask_with_first_error_only"] == [0] + [0, 0, 0, 0, 1] * 2 + [0] * 10
    own = step_sequences(steps, qs.filter("p = 1").limit(1), ["p"], "i", "s", "l", "q", tokenize=tok).first()
    assert [x for x in own["labels"] if x] == [2, 3, 2, 3] and own["attention_mask"] == [1] * 21


def test_scaling_table_has_one_row_per_answer_group(spark):
    from stepjudge.operators.metrics import scaling_table

    rows = [(1, 0, "a", 1.0, "b"), (1, 1, "b", 2.0, "b"), (1, 2, "b", 0.5, "b"), (2, 1, "a", 1.0, "a"), (2, 9, "b", 9.0, "a"), (3, None, "a", 1.0, "a"), (4, 0, None, None, "a"), (4, 1, "a", None, "a")]
    df = spark.createDataFrame(rows, "problem_id int, idx int, answer_key string, score double, gold_key string")
    t = scaling_table(df, [1, 2, 4, 4])
    got = {r["n"]: tuple(r)[1:] for r in t.collect()}
    assert got[1] == (2, 0.0, 0.0, 0.0, 0.0)
    assert got[2][0] == got[4][0] == 3 and got[4][4] == 100.0
    assert "Generate explode" not in _plan(t)


def test_batches_by_length_are_no_neighbours(spark):
    from itertools import groupby

    from stepjudge.operators import scoring as SC

    df = spark.range(3000).select("id", F.array(F.lit("s")).alias("steps"), (F.col("id") % 300 + 1).cast("int").alias("length"))
    out = SC.apply_by_length(df, SC.length_scorer, "id bigint, length int, step_scores array<double>", "length", budget=500)
    got = out.withColumn("_p", F.spark_partition_id()).withColumn("_c", SC.length_class(F.col("length"))).collect()
    assert len(got) == 3000
    runs = [c for _, rows in groupby(got, lambda r: r["_p"]) for c, _ in groupby(rows, lambda r: r["_c"])]
    assert len(runs) > 2 * len({(r["_p"], r["_c"]) for r in got})


def test_remembered_values_are_told_apart_once(spark, tmpdir_path):
    from stepjudge.operators.memo import map_remembered

    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(len(b))
            yield b

    df = spark.createDataFrame([(i, v) for i, v in enumerate([3, 3, None, 5])], "id int, v int").mapInPandas(seen, "id int, v int")
    out = map_remembered(df, "v", lambda c: c * 2, "twice", tmpdir_path, "v1")
    assert calls.value == 4
    assert out.columns == ["id", "v", "twice"] and _rows(out) == [(0, 3, 6), (1, 3, 6), (2, None, None), (3, 5, 10)]
    assert "md5" not in _plan(out)
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (None,)], "v double")
    assert [r[1] for r in map_remembered(zeros, "v", lambda c: c.cast("string"), "s", tmpdir_path, "v2").orderBy("s").collect()] == [None, "-0.0", "0.0"]


def test_options_are_grouped_after_the_shuffle_alone(spark, monkeypatch):
    from stepjudge.operators import ranking as RK
    from stepjudge.operators import scoring as SC

    rows = [(1, 0, " Yes", 1, -0.1), (1, 0, "No", 2, -2.0), (1, 0, "No ", 3, -1.5), (1, 1, "The", 1, -0.1), (1, 2, "Yes", 2, -0.3), (1, 2, "x", 3, None), (None, 0, "No", 1, -0.2), (None, 0, "Yes", 2, None)]
    df = spark.createDataFrame(rows, "k int, pos int, token string, rank int, lp double")
    monkeypatch.setattr(RK, "TASK_ROWS", 3, raising=False)
    wide = SC.pivot_options(df, "k", "pos", "token", "rank", "lp")
    assert _rows(wide) == _rows(spark.createDataFrame([(1, 0, " Yes", -0.1, -1.5), (1, 1, "The", None, None), (1, 2, None, -0.3, None), (None, 0, "No", None, -0.2)], "k int, pos int, top string, yes double, no double"))
    plan = _plan(SC.pivot_options(df, "k", "pos", "token", "rank", "lp"))
    assert plan.count("Exchange ") == 1 and ", 3), REPARTITION_BY_NUM" in plan
    sent = plan[plan.index("Exchange "):]
    assert "Aggregate" not in sent and "Sort" not in sent


def test_step_scores_join_nothing(spark, monkeypatch):
    from stepjudge.operators import ranking as RK
    from stepjudge.operators import scoring as SC

    rows = [(1, p, -0.1, -2.0 if p % 3 else None, "Yes") for p in range(10)] + [(2, 0, -0.1, -0.2, "The"), (3, 0, None, -0.1, "No"), (None, 4, -0.1, -0.1, "No"), (None, None, -0.1, -0.1, "No")]
    df = spark.createDataFrame(rows, "k int, pos int, yes double, no double, top string")
    steps = spark.createDataFrame([(1, 10), (1, 10), (2, 2), (2, 1), (3, 1), (4, 0), (5, None), (None, 2)], "k int, n_steps int")
    given = [(1, i, p, False) for i, p in enumerate(p for p in range(10) if p % 3)] + [(None, 0, None, False), (None, 1, 4, False)]
    none = [(k, i, None, True) for k, n in ((2, 2), (2, 1), (None, 2)) for i in range(n)]
    scores = lambda: SC.scores_from_logprobs(df, "k", "pos", "yes", "no", "top", steps=steps)
    got = lambda s: _rows(s.select("k", "step_idx", "pos", F.col("confidence").isNull()))
    assert got(scores()) == sorted(given + none, key=repr)
    assert "Join" not in _plan(scores())
    monkeypatch.setattr(RK, "TASK_ROWS", 5)
    assert ", 4), REPARTITION_BY_NUM" in _plan(scores())  # 13 decisions, 6 rows of steps
    monkeypatch.setattr(RK, "HOT_GROUP_ROWS", 4)
    assert got(scores()) == sorted(given + none, key=repr)
