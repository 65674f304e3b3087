"""Scoring, search and sequence queries: the scorer plug-in over documents, log-prob confidences
(LOGP), verifier scaling (GEN/VERD), tree search (TREE) and training sequences (STEPS)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepjudge.functions import answers as A
from stepjudge.functions.verdicts import boxed_verdicts
from stepjudge.operators import scoring as SC
from stepjudge.operators import search as SE
from stepjudge.operators import sequences as SQ
from stepjudge.operators.metrics import r6
from stepjudge.plans.registry import query
from stepjudge.sources import fixtures as X
from stepjudge.sources.fixtures import with_views


@query("score_candidates", """
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS st FROM documents)
SELECT doc_id, CAST(len(st) AS BIGINT) AS n_steps,
  CASE WHEN len(st) = 0 THEN NULL ELSE round((length(st[-1]) % 100) / 100.0, 6) END AS score,
  CAST(len(list_filter(st, lambda x: (length(x) % 100) / 100.0 > 0.5)) AS BIGINT) AS n_correct_steps FROM s""")
def q_score_candidates(spark, sf):
    """K6 + U1: split, score with the batched plug-in (mapInPandas), label."""
    d = X.table(spark, sf, "documents").select("doc_id", "text")
    s = SC.score_candidates(d, ["doc_id"], "text", SC.length_scorer, batch_size=16)
    return s.select("doc_id", F.size("step_scores").cast("bigint").alias("n_steps"), r6("score").alias("score"),
                    F.size(F.filter("step_labels", lambda x: x == 1)).cast("bigint").alias("n_correct_steps"))


@query("scores_from_logprobs", with_views("""
SELECT gen_id, pos, round(1.0 / (1.0 + exp(no_logprob - yes_logprob)), 6) AS confidence FROM logp
WHERE trim(top_token) IN ('Yes', 'No')""", "logp"))
def q_scores_from_logprobs(spark, sf):
    s = SC.scores_from_logprobs(X.logp(spark, sf), "gen_id", "pos", "yes_logprob", "no_logprob", "top_token")
    return s.select("gen_id", "pos", r6("confidence").alias("confidence"))


@query("combine_verifications", with_views("""
WITH d AS (SELECT problem_id, gen_idx, CASE WHEN arg_max(verdict, step_idx) = '+' THEN 1.0 ELSE 0.0 END AS dec
           FROM verd GROUP BY problem_id, gen_idx)
SELECT problem_id, round(avg(dec), 6) AS parallel_score, round(arg_max(dec, gen_idx), 6) AS sequential_score, count(*) AS k
FROM d GROUP BY problem_id""", "verd"))
def q_combine_verifications(spark, sf):
    g = X.gen(spark, sf).withColumn("decision", F.element_at(boxed_verdicts("boxed_text"), -1))
    par = SC.combine_verifications(g, ["problem_id"], "gen_idx", "decision", mode="parallel")
    seq = SC.combine_verifications(g, ["problem_id"], "gen_idx", "decision", mode="sequential").select(
        "problem_id", F.col("score").alias("sequential_score"))
    return par.join(seq, "problem_id").select("problem_id", r6("score").alias("parallel_score"),
                                              r6("sequential_score").alias("sequential_score"), "k")


@query("best_of_n", with_views("""
WITH c AS (SELECT problem_id, gen_idx, min(CASE WHEN verdict = '+' THEN 1.0 ELSE 0.0 END) AS s FROM verd GROUP BY problem_id, gen_idx)
SELECT problem_id, gen_idx AS pred, round(s, 6) AS score FROM
 (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY s DESC, gen_idx) AS r FROM c) WHERE r = 1""", "verd"))
def q_best_of_n(spark, sf):
    v = X.verd(spark, sf).withColumn("s", F.when(F.col("verdict") == "+", 1.0).otherwise(0.0))
    c = v.groupBy("problem_id", "gen_idx").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("step_idx", "s"))), lambda x: x["s"]).alias("step_scores"))
    b = SE.best_of_n(c, ["problem_id"], "step_scores", "gen_idx", idx="gen_idx", how="min")
    return b.select("problem_id", "pred", r6("score").alias("score"))


_TREE_KIDS = """
ch AS (SELECT problem_id, parent_id AS node_id, count(*) AS nchild FROM tree WHERE parent_id IS NOT NULL GROUP BY problem_id, parent_id),
t AS (SELECT tree.*, COALESCE(ch.nchild, 0) AS nchild, (COALESCE(stop_reason = 'EOS', FALSE) OR COALESCE(ch.nchild, 0) = 0) AS done
      FROM tree LEFT JOIN ch USING (problem_id, node_id))
"""


_PATHS_SQL = "WITH RECURSIVE " + _TREE_KIDS + """,
b AS (SELECT problem_id, node_id, text AS path, score, done, 0 AS depth FROM t WHERE parent_id IS NULL
      UNION ALL
      SELECT problem_id, node_id, path, score, done, depth FROM (
        SELECT t.problem_id, t.node_id, b.path || t.text AS path, t.score, t.done, b.depth + 1 AS depth,
               row_number() OVER (PARTITION BY t.problem_id ORDER BY t.score DESC, t.node_id) AS rk
        FROM b JOIN t ON t.problem_id = b.problem_id AND t.parent_id = b.node_id
        WHERE NOT b.done AND b.depth < {rounds}) WHERE rk <= 2)
SELECT problem_id, rank, node_id, path, round(CAST(score AS DOUBLE), 6) AS score, CAST(depth AS BIGINT) AS depth, done AS completed FROM
 (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY done DESC, score DESC, node_id) AS rank FROM b WHERE done OR depth = {rounds}) WHERE rank <= 2"""


def _best_paths(spark, sf, rounds):
    b = SE.best_paths(X.tree(spark, sf), keep=2, n=2, rounds=rounds)
    return b.select("problem_id", "rank", "node_id", "path", r6("score").alias("score"), F.col("depth").cast("bigint").alias("depth"), "completed")


@query("best_paths", with_views(_PATHS_SQL.replace("{rounds}", "5"), "tree"))
def q_best_paths(spark, sf):
    """Beam search (keep 2, up to 5 rounds) over the logged tree; 2 best paths."""
    return _best_paths(spark, sf, 5)


@query("best_paths_unfinished", with_views(_PATHS_SQL.replace("{rounds}", "1"), "tree"))
def q_best_paths_unfinished(spark, sf):
    """K13 with one round: paths still active after it are returned and marked."""
    return _best_paths(spark, sf, 1)


@query("lookahead_text", with_views("WITH " + """
best AS (SELECT problem_id, parent_id, node_id, text FROM
  (SELECT *, row_number() OVER (PARTITION BY problem_id, parent_id ORDER BY score DESC, node_id) AS r FROM tree WHERE parent_id IS NOT NULL)
  WHERE r = 1)
SELECT t.problem_id, t.node_id, t.text || COALESCE(b1.text, '') || COALESCE(b2.text, '') AS lookahead
FROM tree t LEFT JOIN best b1 ON b1.problem_id = t.problem_id AND b1.parent_id = t.node_id
LEFT JOIN best b2 ON b2.problem_id = t.problem_id AND b2.parent_id = b1.node_id""", "tree"))
def q_lookahead_text(spark, sf):
    return SE.lookahead_text(X.tree(spark, sf), depth=2).select("problem_id", "node_id", "lookahead")


@query("dedup_first", with_views("""
SELECT problem_id, text, min(node_id) AS node_id FROM tree GROUP BY problem_id, text""", "tree"))
def q_dedup_first(spark, sf):
    t = X.tree(spark, sf).select("problem_id", "text", "node_id")
    return SE.dedup_first(t, ["problem_id"], "text", "node_id")


@query("with_previous", with_views("""
SELECT c.problem_id, c.node_id, p.text AS previous_text FROM tree c
LEFT JOIN tree p ON p.problem_id = c.problem_id AND p.node_id = c.parent_id""", "tree"))
def q_with_previous(spark, sf):
    return SE.with_previous(X.tree(spark, sf)).select("problem_id", "node_id", "previous_text")


@query("prune_top", with_views("""
SELECT problem_id, node_id, rank FROM
 (SELECT problem_id, node_id, row_number() OVER (PARTITION BY problem_id ORDER BY score DESC, node_id DESC) AS rank FROM tree)
WHERE rank <= 2""", "tree"))
def q_prune_top(spark, sf):
    """L7 with n = 4 candidates and width 2: the top 4 // 2 = 2 per problem."""
    return SE.prune_top(X.tree(spark, sf), ["problem_id"], "score", "node_id", 4 // 2).select("problem_id", "node_id", "rank")


@query("top_completed", with_views("""
SELECT problem_id, node_id, rank FROM
 (SELECT problem_id, node_id, row_number() OVER (PARTITION BY problem_id ORDER BY score DESC, node_id) AS rank
  FROM tree WHERE stop_reason = 'EOS') WHERE rank <= 2""", "tree"))
def q_top_completed(spark, sf):
    t = X.tree(spark, sf).filter(F.col("stop_reason") == "EOS")
    return SE.top_completed(t, ["problem_id"], "score", "node_id", 2).select("problem_id", "node_id", "rank")


@query("refill", with_views("""
WITH s AS (SELECT problem_id, node_id, rank FROM
  (SELECT problem_id, node_id, row_number() OVER (PARTITION BY problem_id ORDER BY score DESC, node_id DESC) AS rank FROM tree)
  WHERE rank <= 2),
c AS (SELECT problem_id, count(*) AS cnt FROM s GROUP BY problem_id),
slots AS (SELECT c.problem_id, g.slot, g.slot % c.cnt + 1 AS rank FROM c, (SELECT unnest([0, 1, 2, 3]) AS slot) g)
SELECT slots.problem_id, CAST(slots.slot AS BIGINT) AS slot, s.node_id FROM slots JOIN s USING (problem_id, rank)""", "tree"))
def q_refill(spark, sf):
    """Survivors of L7 cycled to exactly 4 slots per problem."""
    s = SE.prune_top(X.tree(spark, sf), ["problem_id"], "score", "node_id", 2)
    return SE.refill(s, ["problem_id"], 4).select("problem_id", F.col("slot").cast("bigint").alias("slot"), "node_id")


@query("step_sequences", with_views("""
WITH f AS (SELECT problem_id, min(CASE WHEN gt_label <> '+' THEN step_idx END) AS fe FROM steps GROUP BY problem_id)
SELECT s.problem_id, CAST(2 + 5 * count(*) AS BIGINT) AS n_tokens, count(*) FILTER (WHERE s.gt_label = '+') AS n_pos_labels,
  count(*) AS n_loss, count(*) FILTER (WHERE f.fe IS NULL OR s.step_idx <= f.fe) AS n_first_error
FROM steps s JOIN f USING (problem_id) GROUP BY s.problem_id""", "steps"))
def q_step_sequences(spark, sf):
    """P10: token sequences with step labels and masks; the question is the problem's name."""
    s = X.steps(spark, sf)
    qs = s.select("problem_id").distinct().withColumn("question", F.concat(F.lit("problem "), F.col("problem_id").cast("string")))
    q = SQ.step_sequences(s, qs, pos_id=2)
    tot = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return q.select("problem_id", F.size("input_ids").cast("bigint").alias("n_tokens"),
                    F.size(F.filter("labels", lambda x: x == 2)).cast("bigint").alias("n_pos_labels"),
                    tot("loss_mask").alias("n_loss"), tot("loss_mask_with_first_error_only").alias("n_first_error"))


@query("pad_batches", """
WITH d AS (SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS n,
                  CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 8) AS BIGINT) AS batch_id FROM documents)
SELECT doc_id, batch_id, max(n) OVER (PARTITION BY batch_id) AS padded_len FROM d""")
def q_pad_batches(spark, sf):
    """P13 + W11: token arrays of documents padded to the longest in each batch of 8."""
    d = X.table(spark, sf, "documents").select("doc_id", SC.hash_tokenize(F.col("text")).alias("ids"))
    p = SQ.pad_batches(d, ["doc_id"], 8, {"ids": 0})
    return p.select("doc_id", F.col("batch_id").cast("bigint").alias("batch_id"), F.size("ids").cast("bigint").alias("padded_len"))


def _root_expansions(spark, sf):
    t = X.tree(spark, sf)
    roots = t.filter(F.col("parent_id").isNull()).select("problem_id", F.lit(0).cast("bigint").alias("beam_id"), "text")
    exp = t.filter(F.col("parent_id") == 0).select("problem_id", F.lit(0).cast("bigint").alias("beam_id"),
                                                  F.col("node_id").alias("exp_idx"), F.col("text").alias("next_text"),
                                                  "stop_reason", F.col("score").cast("double").alias("score"))
    return roots, exp


_ROOT_SQL = """
r AS (SELECT problem_id, text FROM tree WHERE parent_id IS NULL),
e AS (SELECT t.problem_id, t.node_id AS exp_idx, r.text || t.text AS text, t.text AS next_text, CAST(t.score AS DOUBLE) AS score,
             t.stop_reason FROM tree t JOIN r ON r.problem_id = t.problem_id WHERE t.parent_id = 0)
"""


@query("beam_round", with_views("WITH " + _ROOT_SQL + """,
d AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY problem_id, text ORDER BY exp_idx) = 1),
a AS (SELECT * FROM d WHERE NOT COALESCE(stop_reason IN ('EOS', 'length'), FALSE) AND next_text <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY score DESC, exp_idx DESC) AS rank FROM a QUALIFY rank <= 2),
c AS (SELECT problem_id, count(*) AS cnt FROM k GROUP BY problem_id),
s AS (SELECT c.problem_id, g.slot, g.slot % c.cnt + 1 AS rank FROM c, (SELECT unnest([0, 1, 2, 3]) AS slot) g)
SELECT s.problem_id, CAST(s.slot AS BIGINT) AS beam_id, k.text, round(k.score, 6) AS score FROM s JOIN k USING (problem_id, rank)""",
                                "tree"))
def q_beam_round(spark, sf):
    """One beam round from every root: append, dedup, keep 4 // 2 = 2, refill to 4 beams."""
    roots, exp = _root_expansions(spark, sf)
    active, _ = SE.beam_round(roots, exp, n=4, width=2)
    return active.select("problem_id", "beam_id", "text", r6("score").alias("score"))


@query("tree_round", with_views("WITH " + _ROOT_SQL + """
SELECT problem_id, CAST(0 AS BIGINT) AS beam_id, text, round(score, 6) AS score, exp_idx,
  (COALESCE(stop_reason = 'EOS', FALSE) OR next_text = '' OR contains(next_text, 'boxed{')) AS stopped
FROM e QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY score DESC, exp_idx) = 1""", "tree"))
def q_tree_round(spark, sf):
    """One diverse-tree-search round: each subtree keeps its best continuation."""
    roots, exp = _root_expansions(spark, sf)
    t = SE.tree_round(roots, exp, width=2)
    return t.select("problem_id", "beam_id", "text", r6("score").alias("score"), "exp_idx", "stopped")


def _two_beams(spark, sf):
    """The two subtrees of every root as beams with one text, and their scored continuations."""
    t = X.tree(spark, sf)
    beams = t.filter(F.col("parent_id") == 0).select("problem_id", F.col("node_id").alias("beam_id"), F.lit("path ").alias("text"))
    exp = t.filter(F.col("parent_id").isin(1, 2)).select("problem_id", F.col("parent_id").alias("beam_id"), F.col("node_id").alias("exp_idx"),
                                                         F.col("text").alias("next_text"), "stop_reason", F.col("score").cast("double").alias("score"))
    return beams, exp


_TWO_SQL = """
e AS (SELECT problem_id, parent_id AS beam_id, node_id AS exp_idx, 'path ' || text AS text, CAST(score AS DOUBLE) AS score, stop_reason
      FROM tree WHERE parent_id IN (1, 2))
"""


@query("beam_round_two_beams", with_views("WITH " + _TWO_SQL + """,
d AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY problem_id, text ORDER BY beam_id, exp_idx) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY score DESC, beam_id DESC, exp_idx DESC) AS rank FROM d
      WHERE NOT COALESCE(stop_reason IN ('EOS', 'length'), FALSE) QUALIFY rank <= 2),
c AS (SELECT problem_id, count(*) AS cnt FROM k GROUP BY problem_id),
s AS (SELECT c.problem_id, g.slot, g.slot % c.cnt + 1 AS rank FROM c, (SELECT unnest([0, 1, 2, 3]) AS slot) g)
SELECT s.problem_id, CAST(s.slot AS BIGINT) AS beam_id, k.text, round(k.score, 6) AS score FROM s JOIN k USING (problem_id, rank)""", "tree"))
def q_beam_round_two_beams(spark, sf):
    """K10 with two beams per problem: continuations are told apart, pruned and refilled across beams."""
    beams, exp = _two_beams(spark, sf)
    active, _ = SE.beam_round(beams, exp, n=4, width=2)
    return active.select("problem_id", "beam_id", "text", r6("score").alias("score"))


@query("tree_finish", with_views("WITH " + _TWO_SQL + """
SELECT problem_id, string_agg(text, '|' ORDER BY beam_id, score DESC, exp_idx) AS completions, count(*) AS n,
  first(text ORDER BY score DESC, beam_id, exp_idx) AS pred FROM e GROUP BY problem_id""", "tree"))
def q_tree_finish(spark, sf):
    """The last round fans every subtree out to its two best continuations; completions and prediction."""
    beams, exp = _two_beams(spark, sf)
    done = SE.tree_finish(SE.tree_round(beams, exp, width=2, last=True))
    return done.select("problem_id", F.array_join("completions", "|").alias("completions"), F.size("completions").cast("bigint").alias("n"), "pred")


_DEEP_ROUNDS, _DEEP_AHEAD = 24, 3

_GREEDY = """
g AS (SELECT problem_id, parent_id, node_id, text, score FROM deep WHERE parent_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY problem_id, parent_id ORDER BY score DESC, node_id) = 1)
"""


@query("lookahead_text_deep", with_views("WITH RECURSIVE " + _GREEDY + """,
a AS (SELECT problem_id, node_id, node_id AS at, text, 0 AS k FROM deep
      UNION ALL
      SELECT a.problem_id, a.node_id, g.node_id, a.text || g.text, a.k + 1 FROM a JOIN g ON g.problem_id = a.problem_id AND g.parent_id = a.at WHERE a.k < 16)
SELECT problem_id, node_id, arg_max(text, k) AS lookahead FROM a GROUP BY problem_id, node_id""", "deep"))
def q_lookahead_text_deep(spark, sf):
    """K14 sixteen steps ahead: five joins by pointer doubling."""
    return SE.lookahead_text(X.deep(spark, sf), depth=16).select("problem_id", "node_id", "lookahead")


@query("best_paths_dvts", with_views("WITH RECURSIVE " + _GREEDY + f""",
a AS (SELECT problem_id, node_id, node_id AS at, score, 0 AS k FROM deep
      UNION ALL
      SELECT a.problem_id, a.node_id, g.node_id, g.score, a.k + 1 FROM a JOIN g ON g.problem_id = a.problem_id AND g.parent_id = a.at WHERE a.k < {_DEEP_AHEAD}),
l AS (SELECT problem_id, node_id, arg_max(score, k) AS look FROM a GROUP BY problem_id, node_id),
kid AS (SELECT t.problem_id, t.node_id, t.parent_id, t.text, t.score, l.look, COALESCE(t.stop_reason = 'EOS', FALSE) OR t.text = '' AS ended,
          row_number() OVER (PARTITION BY t.problem_id, t.parent_id ORDER BY t.node_id) AS place
        FROM deep t JOIN l USING (problem_id, node_id) WHERE t.parent_id IS NOT NULL),
ch AS (SELECT * FROM kid WHERE place <= 2 QUALIFY row_number() OVER (PARTITION BY problem_id, parent_id ORDER BY look DESC, node_id) = 1),
b AS (SELECT k.problem_id, k.node_id AS subtree, k.node_id AS at, r.text || k.text AS path, k.ended OR contains(r.text || k.text, 'boxed{{') AS stopped, k.score AS own, 0 AS made
      FROM kid k JOIN deep r ON r.problem_id = k.problem_id AND r.node_id = k.parent_id AND r.parent_id IS NULL WHERE k.place <= 4
      UNION ALL
      SELECT b.problem_id, b.subtree, ch.node_id, b.path || ch.text, ch.ended OR contains(b.path || ch.text, 'boxed{{'), b.own, b.made + 1
      FROM b JOIN ch ON ch.problem_id = b.problem_id AND ch.parent_id = b.at WHERE NOT b.stopped AND b.made < {_DEEP_ROUNDS}),
e AS (SELECT problem_id, subtree, max(made) AS made FROM b GROUP BY problem_id, subtree),
leaf AS (SELECT problem_id, node_id FROM deep ANTI JOIN (SELECT problem_id, parent_id AS node_id FROM deep WHERE parent_id IS NOT NULL) USING (problem_id, node_id)),
o AS (SELECT b.problem_id, b.subtree, k.node_id, b.path || k.text AS path, CASE WHEN e.made = {_DEEP_ROUNDS} THEN k.score ELSE k.look END AS score, e.made + 1 AS depth, k.ended
      FROM e JOIN b ON b.problem_id = e.problem_id AND b.subtree = e.subtree AND b.made = e.made - 1
      JOIN kid k ON k.problem_id = b.problem_id AND k.parent_id = b.at AND k.place <= 2
      UNION ALL
      SELECT b.problem_id, b.subtree, b.at, b.path, b.own, 1, b.stopped FROM e JOIN b USING (problem_id, subtree) WHERE e.made = 0)
SELECT problem_id, subtree, node_id, path, round(CAST(score AS DOUBLE), 6) AS score, CAST(depth AS BIGINT) AS depth,
  ended OR contains(path, 'boxed{{') OR EXISTS (SELECT 1 FROM leaf WHERE leaf.problem_id = o.problem_id AND leaf.node_id = o.node_id) AS completed,
  row_number() OVER (PARTITION BY problem_id, subtree ORDER BY score DESC, node_id) AS rank
FROM o""", "deep"))
def q_best_paths_dvts(spark, sf):
    """K13 by diverse verifier tree search: four subtrees per problem, two continuations, three steps of look-ahead."""
    b = SE.best_paths(X.deep(spark, sf), keep=2, n=8, rounds=_DEEP_ROUNDS, strategy="dvts", lookahead=_DEEP_AHEAD)
    return b.select("problem_id", "subtree", "node_id", "path", r6("score").alias("score"), F.col("depth").cast("bigint").alias("depth"), "completed", "rank")


@query("best_paths_best_of_n", with_views("""WITH RECURSIVE c AS (SELECT problem_id, parent_id AS node_id, count(*) AS n FROM deep WHERE parent_id IS NOT NULL GROUP BY ALL),
t AS (SELECT deep.*, COALESCE(stop_reason = 'EOS', FALSE) AS stops, c.n IS NULL AS leaf FROM deep LEFT JOIN c USING (problem_id, node_id)),
b AS (SELECT problem_id, node_id, text AS path, score, stops OR leaf AS done, 0 AS depth FROM t WHERE parent_id IS NULL
      UNION ALL
      SELECT t.problem_id, t.node_id, b.path || t.text, t.score, t.stops OR t.leaf, b.depth + 1 FROM b JOIN t ON t.problem_id = b.problem_id AND t.parent_id = b.node_id
      WHERE NOT b.done AND b.depth < 32)
SELECT problem_id, node_id, path, round(CAST(score AS DOUBLE), 6) AS score, CAST(depth AS BIGINT) AS depth, done AS completed, rank FROM
 (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY score DESC, node_id) AS rank FROM b WHERE done) WHERE rank <= 4""", "deep"))
def q_best_paths_best_of_n(spark, sf):
    """K13 by best-of-N: the four best finished paths of each deep tree."""
    b = SE.best_paths(X.deep(spark, sf), keep=1, n=4, rounds=32, strategy="best_of_n")
    return b.select("problem_id", "node_id", "path", r6("score").alias("score"), F.col("depth").cast("bigint").alias("depth"), "completed", "rank")


@query("step_scores_from_tokens", with_views("""
WITH o AS (SELECT gen_id, pos, yes_logprob AS y, no_logprob AS n, trim(top_token) = 'Yes' AS is_yes, gen_id % 7 = 0 OR (gen_id + 3 * pos) % 5 = 4 AS undecided,
             (gen_id + 3 * pos) % 5 = 3 AS lacks FROM logp),
d AS (SELECT gen_id, pos, round(1.0 / (1.0 + exp(CAST(n AS DOUBLE) - CAST(y AS DOUBLE))), 6) AS confidence,
        row_number() OVER (PARTITION BY gen_id ORDER BY pos) - 1 AS step_idx FROM o WHERE NOT undecided AND NOT lacks),
k AS (SELECT gen_id, count(*) AS n FROM o GROUP BY gen_id HAVING bool_and(undecided))
SELECT gen_id, step_idx, pos, confidence FROM d
UNION ALL SELECT gen_id, unnest(range(n)), NULL, NULL FROM k""", "logp"))
def q_step_scores_from_tokens(spark, sf):
    """K7 from a table of listed tokens: positions without an option, keys without a decision, numbered steps."""
    lp = X.logp(spark, sf)
    wide = SC.pivot_options(X.tokens(spark, sf), "gen_id", "pos", "token", "rank", "logprob")
    steps = lp.groupBy("gen_id").agg(F.count(F.lit(1)).alias("n_steps"))
    s = SC.scores_from_logprobs(wide, "gen_id", "pos", "yes", "no", "top", steps=steps)
    return s.select("gen_id", "step_idx", "pos", r6("confidence").alias("confidence"))


@query("score_candidates_by_length", """
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS st FROM documents)
SELECT doc_id, CAST(len(st) AS BIGINT) AS n_steps, CASE WHEN len(st) = 0 THEN NULL ELSE round((length(st[-1]) % 100) / 100.0, 6) END AS score FROM s""")
def q_score_candidates_by_length(spark, sf):
    """U1 with batches of similar length: the scores don't depend on the batches."""
    d = X.table(spark, sf, "documents").select("doc_id", A.split_steps(F.col("text")).alias("steps"), F.length("text").alias("length"))
    s = SC.apply_by_length(d, SC.length_scorer, "doc_id bigint, length int, step_scores array<double>", "length", budget=20_000)
    return s.select("doc_id", F.size("step_scores").cast("bigint").alias("n_steps"), r6(F.try_element_at("step_scores", F.lit(-1))).alias("score"))


@query("length_batches", """
SELECT count(*) AS n_rows, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')))::BIGINT AS n_tokens, TRUE AS fits, TRUE AS little_padding FROM documents""")
def q_length_batches(spark, sf):
    """P13 by length: batches keep to the token budget once padded, and less than a tenth of it is padding."""
    d = X.table(spark, sf, "documents").select("doc_id", F.size(SC.hash_tokenize(F.col("text"))).alias("n"))
    b = SC.batch_by_length(d, "n", budget=8192)
    of_batch = b.groupBy("batch_id").agg(F.max("n").alias("m"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("s"))
    return of_batch.agg(F.sum("rows").alias("n_rows"), F.sum("s").alias("n_tokens"), F.bool_and((F.col("m") * F.col("rows") <= 8192) | (F.col("rows") == 1)).alias("fits"),
                        (F.sum("s") > F.sum(F.col("m") * F.col("rows")) * 0.9).alias("little_padding"))
