"""Curation queries: step-label logic (STEPS), verdict parsing (GEN against VERD), chain curation,
preference pairs, the funnel and class balancing.

The DuckDB oracles never parse text: they recompute every verdict from VERD, the rows the GEN
texts were built from, so the text path is checked against data that never was text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stepjudge.functions import verdicts as VD
from stepjudge.operators import steps as ST
from stepjudge.operators.metrics import class_counts, funnel, r6
from stepjudge.plans import curate as K
from stepjudge.plans.registry import query
from stepjudge.sources import fixtures as X
from stepjudge.sources.fixtures import with_views


def _gens(spark, sf, col):
    return X.gen(spark, sf).select("problem_id", "gen_idx", F.col(col).alias("text"))


# ============================================================================ step labels (STEPS)

@query("repair_labels", with_views("""
SELECT s.problem_id, s.step_idx, CASE WHEN s.step_idx <= COALESCE(m.lp, -1) THEN '+' ELSE '-' END AS label
FROM steps s JOIN (SELECT problem_id, max(CASE WHEN gt_label = '+' THEN step_idx END) AS lp FROM steps GROUP BY problem_id) m
USING (problem_id)""", "steps"))
def q_repair_labels(spark, sf):
    return ST.repair_labels(X.steps(spark, sf)).select("problem_id", "step_idx", "label")


_FE = "(SELECT problem_id, min(CASE WHEN gt_label <> '+' THEN step_idx END) AS fe FROM steps GROUP BY problem_id) m"


@query("until_first_error", with_views(f"""
SELECT s.problem_id, s.step_idx, s.gt_label FROM steps s JOIN {_FE} USING (problem_id)
WHERE m.fe IS NULL OR s.step_idx <= m.fe""", "steps"))
def q_until_first_error(spark, sf):
    return ST.until_first_error(X.steps(spark, sf)).select("problem_id", "step_idx", "gt_label")


@query("propagate_error", with_views(f"""
SELECT s.problem_id, s.step_idx,
  CASE WHEN (m.fe IS NULL OR s.step_idx <= m.fe) AND s.gt_label = '+' THEN '+' ELSE '-' END AS label
FROM steps s JOIN {_FE} USING (problem_id)""", "steps"))
def q_propagate_error(spark, sf):
    return ST.propagate_error(X.steps(spark, sf)).select("problem_id", "step_idx", "label")


@query("first_error_mask", with_views(f"""
SELECT s.problem_id, s.step_idx, CASE WHEN m.fe IS NULL OR s.step_idx <= m.fe THEN 1 ELSE 0 END AS mask
FROM steps s JOIN {_FE} USING (problem_id)""", "steps"))
def q_first_error_mask(spark, sf):
    return ST.first_error_mask(X.steps(spark, sf)).select("problem_id", "step_idx", F.col("mask").cast("int").alias("mask"))


# ============================================================================ verdicts (GEN vs VERD)

@query("boxed_verdicts", with_views("""
SELECT problem_id, gen_idx, string_agg(verdict, '' ORDER BY step_idx) AS verdicts, count(*) AS n_verdicts
FROM verd GROUP BY problem_id, gen_idx""", "verd"))
def q_boxed_verdicts(spark, sf):
    g = X.gen(spark, sf).withColumn("_d", VD.boxed_verdicts("boxed_text"))
    return g.select("problem_id", "gen_idx",
                    F.array_join(F.transform("_d", lambda x: F.when(x, "+").otherwise("-")), "").alias("verdicts"),
                    F.size("_d").cast("bigint").alias("n_verdicts"))


@query("line_verdicts", with_views("""
SELECT problem_id, gen_idx, string_agg(verdict, '' ORDER BY step_idx) AS verdicts, count(*) AS n_verdicts
FROM verd GROUP BY problem_id, gen_idx""", "verd"))
def q_line_verdicts(spark, sf):
    g = X.gen(spark, sf).withColumn("_d", VD.line_verdicts("line_text"))
    return g.select("problem_id", "gen_idx",
                    F.array_join(F.transform("_d", lambda x: F.when(x, "+").otherwise("-")), "").alias("verdicts"),
                    F.size("_d").cast("bigint").alias("n_verdicts"))


@query("align_steps", with_views("""
SELECT problem_id, gen_idx, count(*) AS n_aligned, count(*) FILTER (WHERE verdict = gt_label) AS n_agree
FROM verd GROUP BY problem_id, gen_idx""", "verd"))
def q_align_steps(spark, sf):
    s = X.steps(spark, sf)
    v = X.verd(spark, sf).select("problem_id", "gen_idx", "step_idx", "verdict")
    a = ST.align_steps(v, s.select("problem_id", "step_idx", "gt_label"))
    return a.groupBy("problem_id", "gen_idx").agg(F.count(F.lit(1)).alias("n_aligned"),
                                                  F.count_if(F.col("verdict") == F.col("gt_label")).alias("n_agree"))


@query("mean_verifications", with_views("""
SELECT problem_id, step_idx, round(avg(CASE WHEN verdict = '+' THEN 1.0 ELSE 0.0 END), 6) AS score, count(*) AS k
FROM verd GROUP BY problem_id, step_idx""", "verd"))
def q_mean_verifications(spark, sf):
    v = X.verd(spark, sf).withColumn("s", F.when(F.col("verdict") == "+", 1.0).otherwise(0.0))
    m = ST.mean_verifications(v, ["problem_id", "step_idx"], "s")
    return m.select("problem_id", "step_idx", r6("score").alias("score"), "k")


@query("mean_steps", with_views("""
SELECT problem_id, round(arg_max(m, step_idx), 6) AS solution_score FROM
 (SELECT problem_id, step_idx, COALESCE(avg(CASE WHEN verdict = '+' THEN 1.0 ELSE 0.0 END), 0.5) AS m
  FROM verd GROUP BY problem_id, step_idx) GROUP BY problem_id""", "verd"))
def q_mean_steps(spark, sf):
    v = X.verd(spark, sf).withColumn("s", F.when(F.col("verdict") == "+", 1.0).otherwise(0.0))
    per = ST.mean_steps(v, ["problem_id"], "step_idx", "s")
    return ST.solution_score(per, ["problem_id"], "step_idx").select("problem_id", r6("solution_score").alias("solution_score"))


@query("step_pass_rate", with_views("""
SELECT problem_id, gen_idx, round(avg(CASE WHEN verdict = '+' THEN 1.0 ELSE 0.0 END), 6) AS pass_rate
FROM verd GROUP BY problem_id, gen_idx""", "verd"))
def q_step_pass_rate(spark, sf):
    p = ST.step_pass_rate(X.verd(spark, sf), ["problem_id", "gen_idx"], "verdict")
    return p.select("problem_id", "gen_idx", r6("pass_rate").alias("pass_rate"))


# ============================================================================ curation (GEN + STEPS)

_SOL_SQL = """
sol AS (SELECT problem_id, count(*) AS n_steps, max(CASE WHEN gt_label = '+' THEN step_idx END) AS lp,
               max(step_idx) AS li FROM steps GROUP BY problem_id),
s2 AS (SELECT problem_id, n_steps, lp, CASE WHEN lp IS NULL THEN 1 WHEN lp < li THEN lp + 2 ELSE n_steps END AS n_keep,
              COALESCE(lp = li, FALSE) AS is_correct FROM sol),
lab AS (SELECT s.problem_id, string_agg(CASE WHEN s.step_idx <= COALESCE(s2.lp, -1) THEN '+' ELSE '-' END, '' ORDER BY s.step_idx) AS labels
        FROM steps s JOIN s2 USING (problem_id) GROUP BY s.problem_id),
vp AS (SELECT v.*, row_number() OVER (PARTITION BY problem_id, gen_idx ORDER BY step_idx) - 1 AS pos FROM verd v),
chk AS (SELECT vp.problem_id, vp.gen_idx, count(*) AS nv,
               bool_and(vp.pos >= s2.n_keep OR ((vp.verdict = '+') = (vp.pos <= COALESCE(s2.lp, -1)))) AS ok,
               count(*) FILTER (WHERE vp.pos < s2.n_keep AND (vp.verdict = '+') <> (vp.pos <= COALESCE(s2.lp, -1))) AS diff
        FROM vp JOIN s2 USING (problem_id) GROUP BY vp.problem_id, vp.gen_idx),
cot AS (SELECT v.problem_id, v.gen_idx,
          string_agg(CASE WHEN v.pos < s2.n_keep
                          THEN 'Step ' || CAST(v.step_idx + 1 AS VARCHAR) || ': checked. Correct? ' || CASE WHEN v.verdict = '+' THEN 'Yes.' ELSE 'No.' END
                          ELSE 'Step ' || CAST(v.pos + 1 AS VARCHAR) || ': Follows an incorrect step. Correct? No.' END,
                     chr(10) ORDER BY v.pos) AS cot
        FROM vp v JOIN s2 USING (problem_id) GROUP BY v.problem_id, v.gen_idx)
"""

_K1_SQL = _SOL_SQL + """,
gd AS (SELECT problem_id, min(gen_idx) AS gen_idx FROM gen GROUP BY problem_id, line_text),
judged AS (SELECT gd.problem_id, gd.gen_idx,
             CASE WHEN chk.nv <> s2.n_steps THEN 'bad_format' WHEN NOT chk.ok THEN 'bad_decisions' END AS reason
           FROM gd JOIN chk USING (problem_id, gen_idx) JOIN s2 USING (problem_id)),
ranked AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY problem_id, reason IS NULL ORDER BY gen_idx) END AS rk
           FROM judged),
staged AS (SELECT problem_id, gen_idx, COALESCE(reason, CASE WHEN rk > 2 THEN 'over_cap' END) AS reason FROM ranked)
"""


@query("curate_line_chains", with_views("WITH " + _K1_SQL + """
SELECT k.problem_id, k.gen_idx, s2.is_correct, CAST(s2.n_steps AS BIGINT) AS n_steps, cot.cot, lab.labels
FROM staged k JOIN s2 USING (problem_id) JOIN cot USING (problem_id, gen_idx) JOIN lab USING (problem_id)
WHERE k.reason IS NULL""", "gen"))
def q_curate_line_chains(spark, sf):
    s = X.steps(spark, sf)
    g = X.gen(spark, sf).select("problem_id", "gen_idx", F.col("line_text").alias("text"))
    c = K.curate_line_chains(s, g, max_per_solution=2)
    return c.select("problem_id", "gen_idx", "is_correct", F.col("n_steps").cast("bigint").alias("n_steps"), "cot",
                    F.array_join("labels", "").alias("labels"))


@query("curation_funnel", with_views("WITH " + _K1_SQL + """
SELECT COALESCE(reason, 'kept') AS stage, count(*) AS n, count(DISTINCT problem_id) AS problems FROM staged
GROUP BY COALESCE(reason, 'kept')""", "gen"))
def q_curation_funnel(spark, sf):
    s = X.steps(spark, sf)
    g = X.gen(spark, sf).select("problem_id", "gen_idx", F.col("line_text").alias("text"))
    return funnel(K.curate_line_chains(s, g, max_per_solution=2, keep_rejected=True))


_K2_SQL = _SOL_SQL + """,
k2 AS (SELECT chk.problem_id, chk.gen_idx, s2.is_correct, s2.n_steps FROM chk JOIN s2 USING (problem_id)
       WHERE NOT (chk.nv = 0 OR (chk.nv <> s2.n_keep AND chk.nv <> s2.n_steps)) AND chk.ok)
"""


@query("curate_long_chains", with_views("WITH " + _K2_SQL + """
SELECT k2.problem_id, k2.gen_idx, k2.is_correct, CAST(k2.n_steps AS BIGINT) AS n_steps,
  g.boxed_text || chr(10) || 'Is the solution correct? ' || CASE WHEN k2.is_correct THEN 'Yes' ELSE 'No' END AS cot,
  lab.labels
FROM k2 JOIN gen g USING (problem_id, gen_idx) JOIN lab USING (problem_id)""", "gen"))
def q_curate_long_chains(spark, sf):
    s = X.steps(spark, sf)
    g = X.gen(spark, sf).select("problem_id", "gen_idx", F.col("boxed_text").alias("text"))
    c = K.curate_long_chains(s, g, match="steps")
    return c.select("problem_id", "gen_idx", "is_correct", F.col("n_steps").cast("bigint").alias("n_steps"), "cot",
                    F.array_join("labels", "").alias("labels"))


@query("class_counts", with_views("WITH " + _K2_SQL + """
SELECT is_correct, count(*) AS n FROM k2 GROUP BY is_correct""", "gen"))
def q_class_counts(spark, sf):
    s = X.steps(spark, sf)
    g = X.gen(spark, sf).select("problem_id", "gen_idx", F.col("boxed_text").alias("text"))
    return class_counts(K.curate_long_chains(s, g))


@query("balance_classes", with_views("WITH " + _K2_SQL + """,
c AS (SELECT is_correct, count(*) AS n FROM k2 GROUP BY is_correct)
SELECT is_correct, (SELECT min(n) FROM c) AS n FROM c""", "gen"))
def q_balance_classes(spark, sf):
    s = X.steps(spark, sf)
    g = X.gen(spark, sf).select("problem_id", "gen_idx", F.col("boxed_text").alias("text"))
    return class_counts(K.balanced(K.curate_long_chains(s, g), seed=42))


@query("preference_pairs", with_views("WITH " + _SOL_SQL + """,
ok AS (SELECT chk.* FROM chk JOIN s2 USING (problem_id) WHERE chk.nv = s2.n_steps),
ch AS (SELECT problem_id, gen_idx, row_number() OVER (PARTITION BY problem_id ORDER BY gen_idx) AS rank FROM ok WHERE diff = 0),
rj AS (SELECT problem_id, gen_idx, diff, row_number() OVER (PARTITION BY problem_id ORDER BY diff DESC, gen_idx) AS rank
       FROM ok WHERE diff > 0)
SELECT ch.problem_id, ch.rank, ch.gen_idx AS chosen_gen, rj.gen_idx AS rejected_gen, rj.diff AS n_wrong,
  c1.cot AS chosen_cot, c2.cot AS rejected_cot
FROM ch JOIN rj USING (problem_id, rank)
JOIN cot c1 ON c1.problem_id = ch.problem_id AND c1.gen_idx = ch.gen_idx
JOIN cot c2 ON c2.problem_id = rj.problem_id AND c2.gen_idx = rj.gen_idx
WHERE ch.rank <= 2""", "gen"))
def q_preference_pairs(spark, sf):
    s = X.steps(spark, sf)
    g = X.gen(spark, sf).select("problem_id", "gen_idx", F.col("line_text").alias("text"))
    p = K.preference_pairs(s, g, k=2)
    return p.select("problem_id", "rank", "chosen_gen", "rejected_gen", F.col("n_wrong").cast("bigint").alias("n_wrong"),
                    "chosen_cot", "rejected_cot")


@query("partial_prefixes", with_views("WITH " + _K2_SQL + """,
base AS (SELECT k2.problem_id, k2.gen_idx, k2.n_steps, s2.lp, g.boxed_text,
           g.boxed_text || chr(10) || 'Is the solution correct? ' || CASE WHEN k2.is_correct THEN 'Yes' ELSE 'No' END AS cot
         FROM k2 JOIN gen g USING (problem_id, gen_idx) JOIN s2 USING (problem_id)),
pk AS (SELECT *, 1 + (CAST(('0x' || substr(md5('8|' || CAST(problem_id AS VARCHAR) || '|' || CAST(gen_idx AS VARCHAR)), 1, 13)) AS BIGINT)
                      % NULLIF(n_steps - 1, 0)) AS k, string_split(boxed_text, chr(10)) AS ls
       FROM base WHERE n_steps >= 4
         AND (CAST(('0x' || substr(md5('7|' || CAST(problem_id AS VARCHAR) || '|' || CAST(gen_idx AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0) < 0.1)
SELECT problem_id, gen_idx, FALSE AS partial, CAST(n_steps AS BIGINT) AS n_steps, cot FROM base
UNION ALL
SELECT problem_id, gen_idx, TRUE, CAST(k AS BIGINT),
  array_to_string(ls[1:k], chr(10)) || chr(10) || 'Is the solution correct? ' || CASE WHEN k - 1 <= COALESCE(lp, -1) THEN 'Yes' ELSE 'No' END
FROM pk WHERE len(ls) >= k""", "gen"))
def q_partial_prefixes(spark, sf):
    """K3: partial copies of a keyed-random tenth of the long chains, cut at a keyed-random step."""
    s = X.steps(spark, sf)
    g = X.gen(spark, sf).select("problem_id", "gen_idx", F.col("boxed_text").alias("text"))
    c = K.add_partial_prefixes(K.curate_long_chains(s, g), p=0.1, seed=7, min_steps=4)
    return c.select("problem_id", "gen_idx", "partial", F.col("n_steps").cast("bigint").alias("n_steps"), "cot")


_SOLUTION_SQL = """
sol AS (SELECT problem_id, string_agg(step, chr(10) ORDER BY step_idx) AS solution FROM steps GROUP BY problem_id)
"""


@query("verification_prompt", with_views("WITH " + _SOLUTION_SQL + r"""
SELECT g.problem_id, g.gen_idx, md5(
  '<|user|>' || chr(10) || 'You are given a math problem and a proposed step-by-step solution:' || chr(10) || chr(10)
  || '[Math Problem]' || chr(10) || chr(10) || 'problem ' || CAST(g.problem_id AS VARCHAR) || chr(10) || chr(10)
  || '[Solution]' || chr(10) || chr(10) || sol.solution || chr(10) || chr(10)
  || 'Review and critique each step in the proposed solution to determine whether each step is correct. If the solution is incomplete, only verify the provided steps.'
  || chr(10) || '<|assistant|>' || chr(10) || 'Let''s verify step by step:' || chr(10) || g.boxed_text) AS digest
FROM gen g JOIN sol USING (problem_id)""", "gen"))
def q_verification_prompt(spark, sf):
    """P1 (training form): the verification request for every chain, with the chain as the answer."""
    from stepjudge.functions.prompts import verification_prompt
    s = X.steps(spark, sf)
    sol = K.solutions(s).select("problem_id", "solution")
    g = X.gen(spark, sf).join(sol, "problem_id")
    p = verification_prompt(F.concat(F.lit("problem "), F.col("problem_id").cast("string")), F.col("solution"), F.col("boxed_text"))
    return g.select("problem_id", "gen_idx", F.md5(p).alias("digest"))


@query("evaluation_rows", with_views("""
SELECT problem_id, md5(string_agg('Step ' || CAST(step_idx + 1 AS VARCHAR) || ': ' || step, chr(10) ORDER BY step_idx)) AS digest
FROM steps GROUP BY problem_id""", "steps"))
def q_evaluation_rows(spark, sf):
    """Labelled steps regrouped per solution with the numbered solution text."""
    from stepjudge.operators.rows import to_wide
    from stepjudge.operators.sequences import evaluation_rows
    w = to_wide(X.steps(spark, sf), ["problem_id"], ["step", "gt_label"], idx="step_idx")
    return evaluation_rows(w, "step", "gt_label").select("problem_id", F.md5("solution").alias("digest"))


@query("gold_line", with_views("WITH " + _SOLUTION_SQL + """
SELECT problem_id, md5(replace(solution, chr(10), ' ')) AS gold_digest FROM sol""", "steps"))
def q_gold_line(spark, sf):
    """K4: the gold solution read back from a prompt's last "Correct solution" line (the prompt is
    built from the step table: a problem line, a draft line, then the gold steps on one line)."""
    s = X.steps(spark, sf)
    sol = K.solutions(s).select("problem_id", F.array_join("solution_steps", " ").alias("flat"))
    prompt = F.concat(F.lit("Problem "), F.col("problem_id").cast("string"), F.lit("\nCorrect solution: draft\n"),
                      F.lit("Correct solution: "), F.col("flat"))
    return sol.select("problem_id", F.md5(K.gold_line(prompt)).alias("gold_digest"))


def _long_with_answers(spark, sf):
    """Long chains in a think block, two of three stating an answer."""
    g = X.gen(spark, sf)
    answer = F.when(F.pmod(F.col("problem_id") + F.col("gen_idx"), F.lit(3)) > 0, F.lit("\nThe answer is 4.</think> done")).otherwise(F.lit("\nno answer"))
    return g.select("problem_id", "gen_idx", F.concat(F.lit("Hm. <think>"), "boxed_text", answer).alias("text"))


_K2_OUTCOME_SQL = _SOL_SQL + """,
e AS (SELECT problem_id, gen_idx, arg_max(verdict, pos) AS last FROM vp GROUP BY problem_id, gen_idx),
j AS (SELECT g.problem_id, g.gen_idx, s2.is_correct, s2.n_steps, COALESCE(chk.nv, 0) AS nv, g.boxed_text,
        CASE WHEN COALESCE(chk.nv, 0) = 0 OR (chk.nv <> s2.n_keep AND chk.nv <> s2.n_steps) THEN 'bad_format'
             WHEN (e.last = '+') <> s2.is_correct OR (g.problem_id + g.gen_idx) % 3 = 0 THEN 'bad_decisions' END AS reason
      FROM gen g JOIN s2 USING (problem_id) LEFT JOIN chk USING (problem_id, gen_idx) LEFT JOIN e USING (problem_id, gen_idx)),
r AS (SELECT *, row_number() OVER (PARTITION BY problem_id, reason IS NULL ORDER BY gen_idx) AS rk FROM j),
k AS (SELECT problem_id, gen_idx, is_correct, n_steps, boxed_text,
        COALESCE(reason, CASE WHEN rk > 1 THEN 'over_cap' END, CASE WHEN 7 * nv > 28 THEN 'too_long' END) AS reason FROM r)
"""


@query("curate_long_chains_outcome", with_views("WITH " + _K2_OUTCOME_SQL + """
SELECT problem_id, gen_idx, is_correct, CAST(n_steps AS BIGINT) AS n_steps,
  '<think>' || chr(10) || boxed_text || chr(10) || '</think>' || chr(10) || 'Is the solution correct? ' || CASE WHEN is_correct THEN 'Yes' ELSE 'No' END AS cot
FROM k WHERE reason IS NULL""", "gen"))
def q_curate_long_chains_outcome(spark, sf):
    """K2 by outcome, with its options: one chain per solution, at most 28 tokens, thinking stripped (H7) and wrapped again."""
    c = K.curate_long_chains(X.steps(spark, sf), _long_with_answers(spark, sf), match="outcome", max_per_solution=1, max_tokens=28, add_think=True)
    return c.select("problem_id", "gen_idx", "is_correct", F.col("n_steps").cast("bigint").alias("n_steps"), "cot")


@query("curation_funnel_outcome", with_views("WITH " + _K2_OUTCOME_SQL + """
SELECT COALESCE(reason, 'kept') AS stage, count(*) AS n, count(DISTINCT problem_id) AS problems FROM k GROUP BY ALL""", "gen"))
def q_curation_funnel_outcome(spark, sf):
    """D28 over K2 by outcome: what each rule rejects."""
    c = K.curate_long_chains(X.steps(spark, sf), _long_with_answers(spark, sf), match="outcome", max_per_solution=1, max_tokens=28, keep_rejected=True)
    return funnel(c)


@query("curate_long_chains_through_think", with_views("WITH " + _K2_SQL + """
SELECT problem_id, gen_idx, 'Hm. <think>' || chr(10) || 'Is the solution correct? ' || CASE WHEN is_correct THEN 'Yes' ELSE 'No' END AS cot FROM k2""", "gen"))
def q_curate_long_chains_through_think(spark, sf):
    """K2 with the published filter's own cut: the text through ``<think>`` stays (H7)."""
    c = K.curate_long_chains(X.steps(spark, sf), _long_with_answers(spark, sf), legacy_think=True)
    return c.select("problem_id", "gen_idx", "cot")


@query("curate_line_chain_variants", with_views("WITH " + _K1_SQL + """,
l AS (SELECT v.problem_id, v.gen_idx, v.pos, 'Step ' || CAST(v.pos + 1 AS VARCHAR) || ':' AS head,
        CASE WHEN v.pos < s2.n_keep THEN ' checked. ' ELSE ' Follows an incorrect step. ' END AS why,
        CASE WHEN v.pos < s2.n_keep AND v.verdict = '+' THEN 'Correct? Yes.' ELSE 'Correct? No.' END AS says, s2.is_correct
      FROM vp v JOIN s2 USING (problem_id) JOIN staged k USING (problem_id, gen_idx) WHERE k.reason IS NULL)
SELECT problem_id, gen_idx, 'incorrect_only' AS variant, string_agg(head || CASE WHEN says = 'Correct? Yes.' THEN ' ' ELSE why END || says, chr(10) ORDER BY pos) AS cot FROM l GROUP BY ALL
UNION ALL
SELECT problem_id, gen_idx, 'direct', string_agg(head || ' ' || says, chr(10) ORDER BY pos) FROM l GROUP BY ALL
UNION ALL
SELECT problem_id, gen_idx, 'single_label', string_agg(head || why, chr(10) ORDER BY pos) || chr(10) || 'Is the solution correct? ' || CASE WHEN bool_and(is_correct) THEN 'Yes' ELSE 'No' END
FROM l GROUP BY ALL""", "gen"))
def q_curate_line_chain_variants(spark, sf):
    """K1 with each of the three rewritings of H10."""
    s = X.steps(spark, sf)
    out = None
    for variant in ("incorrect_only", "direct", "single_label"):
        c = K.curate_line_chains(s, _gens(spark, sf, "line_text"), max_per_solution=2, variant=variant)
        c = c.select("problem_id", "gen_idx", F.lit(variant).alias("variant"), "cot")
        out = c if out is None else out.unionByName(c)
    return out


@query("gold_copies", with_views("WITH " + _K2_SQL + """,
gold AS (SELECT problem_id, string_agg(step, ' ' ORDER BY step_idx) AS gold FROM steps GROUP BY problem_id)
SELECT problem_id, gen_idx, NULL AS gold FROM k2
UNION ALL
SELECT problem_id, gen_idx, gold FROM k2 JOIN gold USING (problem_id)
WHERE CAST(('0x' || substr(md5('5|' || CAST(problem_id AS VARCHAR) || '|' || CAST(gen_idx AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0 < 0.3""", "gen"))
def q_gold_copies(spark, sf):
    """K4: copies of a keyed-random 30 % of the long chains with the gold solution of the prompt."""
    s = X.steps(spark, sf)
    flat = K.solutions(s).select("problem_id", F.concat(F.lit("Q\nCorrect solution: "), F.array_join("solution_steps", " ")).alias("prompt"))
    gold = flat.select("problem_id", K.gold_line("prompt").alias("gold"))
    c = K.curate_long_chains(s, _gens(spark, sf, "boxed_text")).select("problem_id", "gen_idx")
    return K.add_gold_copies(c, gold, 0.3, 5).select("problem_id", "gen_idx", "gold")


@query("preference_rows", with_views("WITH " + _SOL_SQL + """,
ok AS (SELECT chk.* FROM chk JOIN s2 USING (problem_id) WHERE chk.nv = s2.n_steps),
ch AS (SELECT problem_id, gen_idx, row_number() OVER (PARTITION BY problem_id ORDER BY gen_idx) AS rank FROM ok WHERE diff = 0),
rj AS (SELECT problem_id, gen_idx, row_number() OVER (PARTITION BY problem_id ORDER BY diff DESC, gen_idx) AS rank FROM ok WHERE diff > 0),
text AS (SELECT problem_id, string_agg(step, chr(10) ORDER BY step_idx) AS solution FROM steps GROUP BY problem_id)
SELECT ch.problem_id, ch.rank, '<|user|>' || chr(10) || 'You are given a math problem and a proposed step-by-step solution:' || chr(10) || chr(10)
  || '[Math Problem]' || chr(10) || chr(10) || 'problem ' || CAST(ch.problem_id AS VARCHAR) || chr(10) || chr(10)
  || '[Solution]' || chr(10) || chr(10) || text.solution || chr(10) || chr(10)
  || 'Review and critique each step in the proposed solution to determine whether each step is correct. If the solution is incomplete, only verify the provided steps.'
  || chr(10) || 'Let''s verify step by step:' AS prompt, c1.cot AS chosen, c2.cot AS rejected
FROM ch JOIN rj USING (problem_id, rank) JOIN text USING (problem_id)
JOIN cot c1 ON c1.problem_id = ch.problem_id AND c1.gen_idx = ch.gen_idx
JOIN cot c2 ON c2.problem_id = rj.problem_id AND c2.gen_idx = rj.gen_idx
WHERE ch.rank <= 2""", "gen"))
def q_preference_rows(spark, sf):
    """K5 as training text: prompt, chosen and rejected chain."""
    s = X.steps(spark, sf)
    problems = s.select("problem_id").distinct().withColumn("problem", F.concat(F.lit("problem "), F.col("problem_id").cast("string")))
    return K.preference_rows(K.preference_pairs(s, _gens(spark, sf, "line_text"), k=2), problems)
