"""Evaluation queries: votes, sweeps, accuracy, pass@k, difficulty, correlation, calibration.

Every query reads the driver's tables through the fixture views (``sources.fixtures``) and runs over
the whole tables. Doubles are rounded to 6 digits and integers cast to BIGINT on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepjudge.operators import metrics as M
from stepjudge.operators import votes as V
from stepjudge.functions import answers as A
from stepjudge.operators.ranking import number_within
from stepjudge.operators.rows import map_distinct
from stepjudge.plans.registry import query
from stepjudge.sources import fixtures as X
from stepjudge.sources.fixtures import with_views

NS = [1, 2, 4, 8]


r6 = M.r6


def _correct(df: DataFrame) -> DataFrame:
    return df.withColumn("is_correct", F.col("answer_key") == F.col("gold_key"))


# ============================================================================ votes (CAND)

_SWEEP_SQL = """
s AS (SELECT c.*, ns.n FROM cand c JOIN (SELECT unnest([1, 2, 4, 8]) AS n) ns ON c.idx < ns.n),
g AS (SELECT problem_id, n, answer_key, count(*) AS cnt, sum(score) AS w, min(idx) AS fi,
             max(gold_key) AS gold FROM s GROUP BY problem_id, n, answer_key),
naive AS (SELECT problem_id, n, answer AS a, answer_key AS k FROM
          (SELECT *, row_number() OVER (PARTITION BY problem_id, n ORDER BY score DESC, idx) AS r FROM s) WHERE r = 1),
wt AS (SELECT g.problem_id, g.n, g.answer_key AS k, f.answer AS a FROM
       (SELECT *, row_number() OVER (PARTITION BY problem_id, n ORDER BY w DESC, fi) AS r FROM g) g
       JOIN cand f ON f.problem_id = g.problem_id AND f.idx = g.fi WHERE r = 1),
mj AS (SELECT g.problem_id, g.n, g.answer_key AS k, f.answer AS a FROM
       (SELECT *, row_number() OVER (PARTITION BY problem_id, n ORDER BY cnt DESC, fi) AS r FROM g) g
       JOIN cand f ON f.problem_id = g.problem_id AND f.idx = g.fi WHERE r = 1),
cv AS (SELECT problem_id, n, bool_or(answer_key = gold) AS covered, max(gold) AS gold FROM g GROUP BY problem_id, n)
"""


@query("scaling_table", with_views("WITH " + _SWEEP_SQL + """
SELECT cv.n AS n, count(*) AS problems,
  round(avg(CASE WHEN naive.k = cv.gold THEN 1.0 ELSE 0.0 END) * 100, 6) AS acc_naive,
  round(avg(CASE WHEN wt.k = cv.gold THEN 1.0 ELSE 0.0 END) * 100, 6) AS acc_weighted,
  round(avg(CASE WHEN mj.k = cv.gold THEN 1.0 ELSE 0.0 END) * 100, 6) AS acc_maj,
  round(avg(CASE WHEN cv.covered THEN 1.0 ELSE 0.0 END) * 100, 6) AS cov
FROM cv JOIN naive USING (problem_id, n) JOIN wt USING (problem_id, n) JOIN mj USING (problem_id, n)
GROUP BY cv.n""", "cand"))
def q_scaling_table(spark, sf):
    t = M.scaling_table(X.cand(spark, sf), NS)
    return t.select("n", "problems", *[r6(c).alias(c) for c in ("acc_naive", "acc_weighted", "acc_maj", "cov")])


@query("vote_sweep", with_views("WITH " + _SWEEP_SQL + """
SELECT cv.problem_id, cv.n AS n, '\\boxed{' || naive.a || '}' AS pred_naive, '\\boxed{' || wt.a || '}' AS pred_weighted,
  '\\boxed{' || mj.a || '}' AS pred_maj
FROM cv JOIN naive USING (problem_id, n) JOIN wt USING (problem_id, n) JOIN mj USING (problem_id, n)""", "cand"))
def q_vote_sweep(spark, sf):
    return V.vote_sweep(X.cand(spark, sf), NS).select("problem_id", "n", "pred_naive", "pred_weighted", "pred_maj")


# distinct scores 1e-9 apart, with distinct sums
_FINE_SQL = """
fine AS (SELECT problem_id, idx, answer, answer_key, gold_key, CAST(score AS DOUBLE) + power(2, idx) * 1e-9 AS score FROM cand),
""" + _SWEEP_SQL.replace("FROM cand c", "FROM fine c").replace("sum(score)", "sum(CAST(score AS DECIMAL(38,12)))")


@query("votes_fine_scores", with_views("WITH " + _FINE_SQL + """
SELECT cv.problem_id, cv.n AS n, naive.k AS key_naive, wt.k AS key_weighted, mj.k AS key_maj, naive.k AS key_best
FROM cv JOIN naive USING (problem_id, n) JOIN wt USING (problem_id, n) JOIN mj USING (problem_id, n) WHERE cv.n = 8""", "cand"))
def q_votes_fine_scores(spark, sf):
    """D3–D6 on DOUBLE scores that differ by 1e-9: the sweep's best candidate is best-of-N's."""
    c = X.cand(spark, sf).withColumn("score", F.col("score").cast("double") + F.pow(F.lit(2.0), F.col("idx")) * F.lit(1e-9))
    v = V.vote_sweep(c, NS).where("n = 8")
    best = V.vote_best(c.where("idx < 8")).select("problem_id", F.col("pred_key").alias("key_best"))
    return v.join(best, "problem_id").select("problem_id", "n", "key_naive", "key_weighted", "key_maj", "key_best")


@query("scaling_table_fine_scores", with_views("WITH " + _FINE_SQL + """
SELECT cv.n AS n, round(avg(CASE WHEN naive.k = cv.gold THEN 1.0 ELSE 0.0 END) * 100, 6) AS acc_naive,
  round(avg(CASE WHEN wt.k = cv.gold THEN 1.0 ELSE 0.0 END) * 100, 6) AS acc_weighted
FROM cv JOIN naive USING (problem_id, n) JOIN wt USING (problem_id, n) GROUP BY cv.n""", "cand"))
def q_scaling_table_fine_scores(spark, sf):
    """D12 on the same scores."""
    c = X.cand(spark, sf).withColumn("score", F.col("score").cast("double") + F.pow(F.lit(2.0), F.col("idx")) * F.lit(1e-9))
    return M.scaling_table(c, NS).select("n", r6("acc_naive").alias("acc_naive"), r6("acc_weighted").alias("acc_weighted"))


@query("vote_from_texts", with_views("""
WITH x AS (SELECT problem_id, idx, score, gold_key, CASE WHEN idx % 4 = 3 AND contains(answer, '/') THEN split_part(answer, '/', 2) ELSE answer END AS a FROM cand),
v AS (SELECT *, CAST(round(100 * CASE WHEN contains(a, '/') THEN CAST(split_part(a, '/', 1) AS DOUBLE) / CAST(split_part(a, '/', 2) AS DOUBLE) ELSE CAST(a AS DOUBLE) END) AS BIGINT) AS h FROM x),
k AS (SELECT *, 'n:' || CAST(h // gcd(h, 100) AS VARCHAR) || '/' || CAST(100 // gcd(h, 100) AS VARCHAR) AS k FROM v),
g AS (SELECT problem_id, k, sum(score) AS w, count(*) AS c, min(idx) AS fi, max(CASE gold_key WHEN '1/2' THEN 'n:1/2' ELSE 'n:' || gold_key || '/1' END) AS gold FROM k GROUP BY problem_id, k),
wt AS (SELECT problem_id, k, gold FROM g QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY w DESC, fi) = 1),
mj AS (SELECT problem_id, k FROM g QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY c DESC, fi) = 1),
nv AS (SELECT problem_id, k FROM k QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY score DESC, idx) = 1)
SELECT wt.problem_id, nv.k AS key_naive, wt.k AS key_weighted, mj.k AS key_maj, wt.k = wt.gold AS correct
FROM wt JOIN mj USING (problem_id) JOIN nv USING (problem_id)""", "cand"))
def q_vote_from_texts(spark, sf):
    """H11 → H12 → H24 → D3–D6 → C8: votes over solution texts in four layouts; nothing but the text,
    its score and the gold answer goes in."""
    c = X.cand(spark, sf)
    layouts = [("The answer is ", "."), ("So we get \\boxed{", "}."), ("Hence the final answer is $", "$. I hope it is correct."), ("Adding up gives ", "")]
    text = F.lit(None).cast("string")
    for i, (a, b) in enumerate(layouts):
        text = F.when(F.col("idx") % 4 == i, F.concat(F.lit(a), F.col("answer"), F.lit(b))).otherwise(text)
    t = A.extract_answers(c.select("problem_id", "idx", "score", "gold_key", text.alias("text")), "text", "pred")
    t = map_distinct(t, "pred", A.answer_key, "key")
    w = V.vote_sweep(t.select("problem_id", "idx", "score", "pred", "key", "gold_key"), [1 << 30], key="key", answer="pred", gold="gold_key")
    # a problem has one gold answer, and few differ: each is keyed once, after the votes
    golds = map_distinct(c.select(F.col("gold_key").alias("gold")).distinct(), "gold", lambda g: A.answer_key(A.normalize_answer(g)), "gold_norm")
    w = w.join(golds, "gold", "left")
    return w.select("problem_id", "key_naive", "key_weighted", "key_maj", (F.col("key_weighted") == F.col("gold_norm")).alias("correct"))


@query("vote_weighted", with_views("""
WITH g AS (SELECT problem_id, answer_key, sum(score) AS w, min(idx) AS fi FROM cand GROUP BY problem_id, answer_key),
r AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY w DESC, fi) AS r FROM g)
SELECT r.problem_id, c.answer AS pred, r.answer_key AS pred_key, round(CAST(r.w AS DOUBLE), 6) AS weight
FROM r JOIN cand c ON c.problem_id = r.problem_id AND c.idx = r.fi WHERE r.r = 1""", "cand"))
def q_vote_weighted(spark, sf):
    v = V.vote_weighted(X.cand(spark, sf))
    return v.select("problem_id", "pred", "pred_key", r6("weight").alias("weight"))


@query("vote_majority", with_views("""
WITH g AS (SELECT problem_id, answer_key, count(*) AS c, min(idx) AS fi FROM cand GROUP BY problem_id, answer_key),
r AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY c DESC, fi) AS r FROM g)
SELECT r.problem_id, cd.answer AS pred, r.answer_key AS pred_key, r.c AS votes
FROM r JOIN cand cd ON cd.problem_id = r.problem_id AND cd.idx = r.fi WHERE r.r = 1""", "cand"))
def q_vote_majority(spark, sf):
    return V.vote_majority(X.cand(spark, sf))


@query("vote_best", with_views("""
SELECT problem_id, answer AS pred, answer_key AS pred_key, round(CAST(score AS DOUBLE), 6) AS best_score FROM
 (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY score DESC, idx) AS r FROM cand) WHERE r = 1""", "cand"))
def q_vote_best(spark, sf):
    v = V.vote_best(X.cand(spark, sf))
    return v.select("problem_id", "pred", "pred_key", r6("best_score").alias("best_score"))


@query("aggregate_steps", with_views("""
SELECT problem_id,
  round(min(CAST(score AS DOUBLE)), 6) AS agg_min,
  round(product(CAST(score AS DOUBLE)) + 1e-12, 6) AS agg_prod,
  round(CAST(arg_max(score, step_idx) AS DOUBLE), 6) AS agg_last
FROM steps GROUP BY problem_id""", "steps"))
def q_aggregate_steps(spark, sf):
    s = X.steps(spark, sf)
    out = s.groupBy("problem_id").agg(*[V.step_aggregate("step_idx", "score", h).alias(f"agg_{h}") for h in V.STEP_AGGREGATES])
    # products of one-decimal scores often end exactly on a rounding tie; nudge both sides past it
    return out.select("problem_id", r6("agg_min").alias("agg_min"), r6(F.col("agg_prod") + 1e-12).alias("agg_prod"),
                      r6("agg_last").alias("agg_last"))


@query("coverage", with_views("""
SELECT n, count(*) AS problems, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) * 100, 6) AS cov FROM
 (SELECT c.problem_id, ns.n, bool_or(c.answer_key = c.gold_key) AS ok
  FROM cand c JOIN (SELECT unnest([1, 2, 4, 8]) AS n) ns ON c.idx < ns.n GROUP BY c.problem_id, ns.n)
GROUP BY n""", "cand"))
def q_coverage(spark, sf):
    c = M.coverage(X.cand(spark, sf), NS)
    return c.select(F.col("n").cast("bigint").alias("n"), "problems", r6("cov").alias("cov"))


@query("pass_at_k", with_views("""
WITH p AS (SELECT problem_id, count(*) AS n, count(*) FILTER (WHERE answer_key = gold_key) AS c FROM cand GROUP BY problem_id),
pk AS (SELECT p.*, k.k FROM p, (SELECT unnest([1, 2, 4]) AS k) k),
v AS (SELECT k, CASE WHEN n - c < k THEN 1.0 WHEN c = 0 THEN 0.0 ELSE
        1.0 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1.0 - k / CAST(i AS DOUBLE))) END AS pk FROM pk)
SELECT CAST(k AS BIGINT) AS k, count(*) AS problems, round(avg(pk), 6) AS pass_at_k FROM v GROUP BY k""", "cand"))
def q_pass_at_k(spark, sf):
    p = M.problem_pass_at_k(X.cand(spark, sf), [1, 2, 4])
    return p.groupBy(F.col("k").cast("bigint").alias("k")).agg(
        F.count(F.lit(1)).alias("problems"), r6(F.avg("pass_at_k")).alias("pass_at_k"))


@query("pass_at_1", with_views("""
SELECT count(*) AS problems, round(avg(c / n), 6) AS pass_at_1 FROM
 (SELECT problem_id, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE answer_key = gold_key) AS c FROM cand GROUP BY problem_id)""",
                             "cand"))
def q_pass_at_1(spark, sf):
    p = M.problem_pass_at_1(_correct(X.cand(spark, sf)))
    return p.agg(F.count(F.lit(1)).alias("problems"), r6(F.avg("pass_at_1")).alias("pass_at_1"))


@query("accuracy", with_views("""
SELECT round(avg(CASE WHEN answer_key = gold_key THEN 1.0 ELSE 0.0 END) * 100, 6) AS acc, count(*) AS num_samples,
  count(score) AS num_scores FROM cand""", "cand"))
def q_accuracy(spark, sf):
    a = M.accuracy(_correct(X.cand(spark, sf)))
    return a.select(r6("acc").alias("acc"), "num_samples", "num_scores")


@query("accuracy_with_failures", with_views("""
SELECT round(avg(CASE WHEN answer_key = gold_key THEN 1.0 ELSE 0.0 END) * 100, 6) AS acc, count(*) AS num_samples,
  count(score) AS num_scores, count(*) FILTER (WHERE idx % 4 = 3) AS timeout_samples, round(avg(CASE WHEN idx % 4 = 3 THEN 100.0 ELSE 0.0 END), 6) AS timeout_share FROM cand""", "cand"))
def q_accuracy_with_failures(spark, sf):
    """Every fourth candidate's comparison failed."""
    c = _correct(X.cand(spark, sf)).withColumn("status", F.when(F.col("idx") % 4 == 3, "error").when(F.col("idx") % 4 == 2, "ok"))
    a = M.accuracy(c, status="status")
    return a.select(r6("acc").alias("acc"), "num_samples", "num_scores", "timeout_samples", r6("timeout_share").alias("timeout_share"))


@query("accuracy_by", with_views("""
SELECT o.o_orderpriority AS priority, round(avg(CASE WHEN c.answer_key = c.gold_key THEN 1.0 ELSE 0.0 END) * 100, 1) AS acc,
  count(*) AS num_samples
FROM cand c JOIN orders o ON o.o_orderkey = c.problem_id GROUP BY ROLLUP (o.o_orderpriority)""", "cand"))
def q_accuracy_by(spark, sf):
    c = _correct(X.cand(spark, sf))
    o = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("problem_id"), F.col("o_orderpriority").alias("priority"))
    a = M.accuracy_by(c.join(o, "problem_id"), "priority")
    return a.select("priority", F.col("acc").cast("double").alias("acc"), "num_samples")


@query("macro_average", with_views("""
SELECT round(avg(m), 6) AS macro_avg, count(*) AS groups FROM
 (SELECT gold_key, avg(CASE WHEN answer_key = gold_key THEN 1.0 ELSE 0.0 END) AS m FROM cand GROUP BY gold_key)""", "cand"))
def q_macro_average(spark, sf):
    m = M.macro_average(_correct(X.cand(spark, sf)), "gold_key", "is_correct")
    return m.select(r6("macro_avg").alias("macro_avg"), "groups")


@query("key_accuracy", with_views("""
SELECT round(avg(CASE WHEN answer_key = gold_key THEN 1.0 ELSE 0.0 END), 6) AS key_accuracy FROM cand WHERE idx = 0""", "cand"))
def q_key_accuracy(spark, sf):
    v = V.vote_sweep(X.cand(spark, sf), [1])
    return v.agg(r6(F.avg((F.col("key_weighted") == F.col("gold")).cast("double"))).alias("key_accuracy"))


@query("difficulty_level", with_views("""
WITH p AS (SELECT problem_id, CAST(sum(CAST(score * 1000000 AS BIGINT)) AS DOUBLE) / count(*) AS m FROM cand GROUP BY problem_id),
q AS (SELECT quantile_cont(m, [0.2, 0.4, 0.6, 0.8]) AS q FROM p)
SELECT CASE WHEN m < q[1] THEN 5 WHEN m < q[2] THEN 4 WHEN m < q[3] THEN 3 WHEN m < q[4] THEN 2 ELSE 1 END AS level,
  count(*) AS problems FROM p, q GROUP BY level""", "cand"))
def q_difficulty_level(spark, sf):
    # exact integer sum, one division: the mean is bit-identical however the sum is ordered,
    # so comparisons against the cut points cannot flip
    p = X.cand(spark, sf).groupBy("problem_id").agg(
        (F.sum((F.col("score") * 1000000).cast("bigint")).cast("double") / F.count(F.lit(1))).alias("m"))
    cuts = M.quintiles(p, "m")
    lv = p.withColumn("level", M.difficulty_level("m", cuts).cast("bigint"))
    return lv.groupBy("level").agg(F.count(F.lit(1)).alias("problems"))


@query("mean_by_position", with_views("""
WITH r AS (SELECT problem_id, max(step_idx) AS len, arg_max(CAST(score AS DOUBLE), step_idx) AS last FROM steps GROUP BY problem_id),
pos AS (SELECT DISTINCT step_idx FROM steps)
SELECT pos.step_idx, round(avg(COALESCE(CAST(s.score AS DOUBLE), r.last)), 6) AS mean_score
FROM pos JOIN r ON TRUE LEFT JOIN steps s ON s.problem_id = r.problem_id AND s.step_idx = pos.step_idx
GROUP BY pos.step_idx""", "steps"))
def q_mean_by_position(spark, sf):
    m = M.mean_by_position(X.steps(spark, sf), ["problem_id"], "step_idx", "score")
    return m.select("step_idx", r6("mean_score").alias("mean_score"))


@query("rank_candidates", with_views("""
SELECT problem_id, idx, row_number() OVER (PARTITION BY problem_id ORDER BY score DESC, idx) AS rank FROM cand""", "cand"))
def q_rank_candidates(spark, sf):
    c = X.cand(spark, sf)
    return number_within(c, ["problem_id"], [F.col("score").desc(), F.col("idx")], "rank").select("problem_id", "idx", "rank")


@query("avg_rank", with_views("""
SELECT problem_id, idx, round(rank() OVER w + (count(*) OVER (PARTITION BY problem_id, score) - 1) / 2.0, 6) AS avg_rank
FROM cand WINDOW w AS (PARTITION BY problem_id ORDER BY score)""", "cand"))
def q_avg_rank(spark, sf):
    from stepjudge.operators.rows import avg_rank
    return avg_rank(X.cand(spark, sf), ["problem_id"], "score", "idx").select("problem_id", "idx", r6("avg_rank").alias("avg_rank"))


@query("batch_id", with_views("""
SELECT problem_id, idx, CAST(floor((row_number() OVER (ORDER BY problem_id, idx) - 1) / 16) AS BIGINT) AS batch_id FROM cand""", "cand"))
def q_batch_id(spark, sf):
    from stepjudge.operators.rows import batch_id
    return batch_id(X.cand(spark, sf), ["problem_id", "idx"], 16).select("problem_id", "idx", "batch_id")


# ============================================================================ correlation (CAND)

_RANKS_SQL = """
WITH r AS (SELECT problem_id, CAST(score AS DOUBLE) AS x, CASE WHEN answer_key = gold_key THEN 1.0 ELSE 0.0 END AS y FROM cand),
rk AS (SELECT problem_id, x, y,
  rank() OVER (PARTITION BY problem_id ORDER BY x) + (count(*) OVER (PARTITION BY problem_id, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY problem_id ORDER BY y) + (count(*) OVER (PARTITION BY problem_id, y) - 1) / 2.0 AS ry FROM r),
sp AS (SELECT problem_id, CASE WHEN var_pop(rx) <= 1e-12 OR var_pop(ry) <= 1e-12 THEN NULL
          ELSE covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)) END AS spearman FROM rk GROUP BY problem_id),
pr AS (SELECT a.problem_id,
          sum(CASE WHEN (a.x - b.x) * (a.y - b.y) > 0 THEN 1 ELSE 0 END) AS nc,
          sum(CASE WHEN (a.x - b.x) * (a.y - b.y) < 0 THEN 1 ELSE 0 END) AS nd,
          sum(CASE WHEN a.x = b.x AND a.y <> b.y THEN 1 ELSE 0 END) AS tx,
          sum(CASE WHEN a.y = b.y AND a.x <> b.x THEN 1 ELSE 0 END) AS ty
       FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY x, y) AS i FROM r) a
       JOIN (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY x, y) AS i FROM r) b
         ON a.problem_id = b.problem_id AND a.i < b.i
       GROUP BY a.problem_id),
kd AS (SELECT p.problem_id, CASE WHEN (nc + nd + tx) * (nc + nd + ty) = 0 THEN NULL
          ELSE (nc - nd) / sqrt(CAST((nc + nd + tx) AS DOUBLE) * (nc + nd + ty)) END AS kendall
       FROM (SELECT DISTINCT problem_id FROM r) p LEFT JOIN pr USING (problem_id))
"""


@query("spearman", with_views(_RANKS_SQL + "SELECT problem_id, round(spearman, 6) + 0.0 AS spearman FROM sp", "cand"))
def q_spearman(spark, sf):
    c = X.cand(spark, sf).withColumn("x", F.col("score").cast("double"))
    s = M.spearman(c, ["problem_id"], "x", (F.col("answer_key") == F.col("gold_key")).cast("double"))
    return s.select("problem_id", r6("spearman").alias("spearman"))


@query("kendall", with_views(_RANKS_SQL + "SELECT problem_id, round(kendall, 6) + 0.0 AS kendall FROM kd", "cand"))
def q_kendall(spark, sf):
    c = X.cand(spark, sf).withColumn("x", F.col("score").cast("double"))
    k = M.kendall_binary(c, ["problem_id"], "x", (F.col("answer_key") == F.col("gold_key")).cast("double"))
    return k.select("problem_id", r6("kendall").alias("kendall"))


@query("correlation_report", with_views(_RANKS_SQL + """
SELECT round(avg(spearman), 6) + 0.0 AS spearman, round(avg(kendall), 6) + 0.0 AS kendall, count(spearman) AS n_groups_used,
  count(*) AS num_samples FROM sp JOIN kd USING (problem_id)""", "cand"))
def q_correlation_report(spark, sf):
    c = X.cand(spark, sf).withColumn("x", F.col("score").cast("double"))
    r = M.correlation_report(c, ["problem_id"], "x", (F.col("answer_key") == F.col("gold_key")).cast("double"))
    return r.select(r6("spearman").alias("spearman"), r6("kendall").alias("kendall"), "n_groups_used", "num_samples")


# ============================================================================ calibration (CONF)

_BIN_SQL = """
WITH e AS (SELECT i, CASE WHEN i = 10 THEN 1.0 ELSE CAST(i AS DOUBLE) * CAST(0.1 AS DOUBLE) END AS edge FROM range(0, 11) t(i)),
b AS (SELECT c.doc_id, c.conf, c.correct,
        least(greatest((SELECT count(*) FROM e WHERE e.edge <= c.conf) - 1, 0), 9) AS bin FROM conf c),
t AS (SELECT g.i AS bin, count(b.doc_id) AS bin_count, COALESCE(avg(CAST(b.correct AS DOUBLE)), 0.0) AS bin_accuracy,
        COALESCE(avg(b.conf), 0.0) AS bin_confidence
      FROM range(0, 10) g(i) LEFT JOIN b ON b.bin = g.i GROUP BY g.i)
"""


@query("reliability_table", with_views(_BIN_SQL + """
SELECT bin, round(bin * 0.1, 6) AS bin_edge,
  round((bin * 0.1 + CASE WHEN bin = 9 THEN 1.0 ELSE (bin + 1) * 0.1 END) / 2, 6) AS bin_center,
  round(bin_accuracy, 6) AS bin_accuracy, round(bin_confidence, 6) AS bin_confidence, bin_count FROM t""", "conf"))
def q_reliability_table(spark, sf):
    t = M.reliability_table(X.conf(spark, sf))
    return t.select("bin", *[r6(c).alias(c) for c in ("bin_edge", "bin_center", "bin_accuracy", "bin_confidence")], "bin_count")


@query("ece", with_views(_BIN_SQL + """
SELECT round(sum(bin_count * abs(bin_accuracy - bin_confidence)) / sum(bin_count), 6) AS ece, CAST(sum(bin_count) AS BIGINT) AS num_samples FROM t""",
                       "conf"))
def q_ece(spark, sf):
    e = M.ece(X.conf(spark, sf))
    return e.select(r6("ece").alias("ece"), F.col("num_samples").cast("bigint").alias("num_samples"))


_AUC_SQL = """
SELECT CASE WHEN count(*) FILTER (WHERE p.correct > 0) = 0 OR count(*) FILTER (WHERE p.correct <= 0) = 0 THEN 0.5 ELSE
  round((SELECT sum(CASE WHEN a.conf > b.conf THEN 1.0 WHEN a.conf = b.conf THEN 0.5 ELSE 0.0 END)
         FROM {src} a JOIN {src} b ON a.correct > 0 AND b.correct <= 0)
        / (count(*) FILTER (WHERE p.correct > 0) * count(*) FILTER (WHERE p.correct <= 0)), 6) END AS auc_roc
FROM {src} p"""


@query("auc_roc", with_views(_AUC_SQL.format(src="conf"), "conf"))
def q_auc_roc(spark, sf):
    return M.auc_roc(X.conf(spark, sf)).select(r6("auc_roc").alias("auc_roc"))


@query("normalize_by_max", with_views("""
SELECT doc_id, round(CASE WHEN m > 0 THEN conf / m ELSE conf END, 6) AS conf FROM conf, (SELECT max(conf) AS m FROM conf)""", "conf"))
def q_normalize_by_max(spark, sf):
    return M.normalize_by_max(X.conf(spark, sf), "conf").select("doc_id", r6("conf").alias("conf"))


@query("calibration_report", with_views("""
WITH nc AS (SELECT doc_id, CASE WHEN m > 0 THEN conf / m ELSE conf END AS conf, correct FROM conf, (SELECT max(conf) AS m FROM conf) mm),
""" + _BIN_SQL.replace("WITH e AS", "e AS").replace("FROM conf c", "FROM nc c") + """,
a AS (""" + _AUC_SQL.format(src="nc") + """)
SELECT round(sum(bin_count * abs(bin_accuracy - bin_confidence)) / sum(bin_count), 6) AS ece, CAST(sum(bin_count) AS BIGINT) AS num_samples,
  (SELECT auc_roc FROM a) AS auc_roc FROM t""", "conf"))
def q_calibration_report(spark, sf):
    r = M.calibration_report(X.conf(spark, sf), normalize=True)
    return r.select(r6("ece").alias("ece"), F.col("num_samples").cast("bigint").alias("num_samples"), r6("auc_roc").alias("auc_roc"))
