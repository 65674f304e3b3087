"""Curation of verification chains into training rows (K1–K5, K18) and the filter funnel.

Inputs are long tables:

* ``steps``       (problem_id, step_idx, step, gt_label)   — the solution being judged
* ``generations`` (problem_id, gen_idx, text)              — sampled verification chains

Per solution, one aggregate gives the repaired labels (``operators.steps.solution_summary``);
every generation row is then judged by Column functions against those few scalars — one
aggregation, one join, no per-step explode. Every row keeps a ``reject_reason`` (NULL = kept),
so the funnel is a plain group-by over the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepjudge.functions import verdicts as VD
from stepjudge.functions.prompts import verification_prompt
from stepjudge.operators.ranking import top_k_within
from stepjudge.operators.rows import balance, hash_unit, random_cut, sample_fraction, sample_n, to_wide
from stepjudge.operators.steps import solution_summary


def solutions(steps: DataFrame, by: Sequence[str] = ("problem_id",)) -> DataFrame:
    """Per solution: summary scalars plus the step list and the solution text (steps joined by
    newline — the reference's ``prefix``)."""
    summ = solution_summary(steps, by)
    wide = to_wide(steps, by, ["step"], idx="step_idx").withColumnRenamed("step", "solution_steps")
    return summ.join(wide, list(by)).withColumn("solution", F.array_join("solution_steps", "\n"))


def repaired_labels(n_steps: Column, last_plus: Column) -> Column:
    """The repaired label list as '+'/'-' strings: correct exactly up to the last correct step."""
    return F.transform(F.sequence(F.lit(0), n_steps - 1),
                       lambda i: F.when(i <= F.coalesce(last_plus, F.lit(-1)), "+").otherwise("-"))


def _cap(df: DataFrame, cap: int | None, keep_rejected: bool, order: str = "gen_idx") -> DataFrame:
    """At most ``cap`` accepted chains per solution, in generation order; the rest are marked
    ``over_cap`` (dropped at once unless ``keep_rejected``). Only ids go through the top-k; those that stay are a
    list of at most ``cap`` per solution, so the texts, which lie by solution already, meet them where they
    are. A solution with a huge number of chains is never one task."""
    accepted = df.filter(F.col("reject_reason").isNull())
    if cap is None:
        return df if keep_rejected else accepted
    key = ["problem_id", order]
    top = top_k_within(accepted.select(*key), ["problem_id"], [F.col(order)], cap, "_rk", salt_cols=key)
    top = top.groupBy("problem_id").agg(F.collect_set(order).alias("_in"))
    stays = F.coalesce(F.array_contains("_in", F.col(order)), F.lit(False))
    if not keep_rejected:
        return accepted.join(top, "problem_id").filter(stays).drop("_in")
    marked = df.join(top, "problem_id", "left")
    return marked.withColumn("reject_reason", F.coalesce("reject_reason", F.when(~stays, F.lit("over_cap")))).drop("_in")


def _with_texts(chains: DataFrame, steps: DataFrame) -> DataFrame:
    """The solution's steps and text, joined to the chains that are left."""
    wide = to_wide(steps, ["problem_id"], ["step"], idx="step_idx").withColumnRenamed("step", "solution_steps")
    return chains.join(wide, "problem_id").withColumn("solution", F.array_join("solution_steps", "\n"))


def curate_line_chains(steps: DataFrame, generations: DataFrame, text: str = "text",
                       max_per_solution: int | None = None, variant: str | None = None,
                       keep_rejected: bool = False) -> DataFrame:
    """K1: line-verdict chains (``Correct? Yes/No`` per step).

    Duplicate chains of a solution are dropped first (the first ``gen_idx`` kept). A chain is
    kept when it has one verdict per step and its verdicts equal the repaired labels through the
    first error; it is then completed (steps after the error become "follows an incorrect step"),
    optionally rewritten (H10) and labelled (W3). Chains are judged against the solution's scalars
    alone; solution texts are joined to what is left.
    """
    # verdicts are read before the join: where the text isn't needed, it isn't shuffled
    g = generations.groupBy("problem_id", text).agg(F.min("gen_idx").alias("gen_idx")).withColumn("_dec", VD.line_verdicts(text))
    j = g.join(solution_summary(steps, ["problem_id"]), "problem_id")
    reason = (F.when(F.size("_dec") != F.col("n_steps"), F.lit("bad_format"))
              .when(~VD.matches_through(F.col("_dec"), F.col("n_keep"), F.col("last_plus")), F.lit("bad_decisions")))
    j = _with_texts(_cap(j.withColumn("reject_reason", reason).drop("_dec"), max_per_solution, keep_rejected), steps)
    cot_steps = VD.chain_variant(VD.pad_after_error(F.col(text), F.col("n_keep"), F.col("n_steps")), variant,
                                 F.col("is_correct"))
    out = j.select(
        "problem_id", "gen_idx", "solution", "solution_steps", cot_steps.alias("cot_steps"),
        repaired_labels(F.col("n_steps"), F.col("last_plus")).alias("labels"), "is_correct", "n_steps", "reject_reason",
    ).withColumn("cot", F.array_join("cot_steps", "\n"))
    return out if keep_rejected else out.drop("reject_reason")


def token_count(text: str | Column) -> Column:
    """U3 default tokenizer size: whitespace-separated pieces (a plug-in may replace it)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.size(F.filter(F.split(t, r"\s+"), lambda x: x != ""))


def curate_long_chains(steps: DataFrame, generations: DataFrame, text: str = "text", match: str = "steps",
                       max_per_solution: int | None = None, max_tokens: int | None = None,
                       add_think: bool = False, legacy_think: bool = False,
                       token_len: Callable[[Column], Column] = token_count, keep_rejected: bool = False) -> DataFrame:
    """K2: long chains with boxed verdicts (the published filter).

    The verdict count must equal the labels through the first error or the step count; then either
    every verdict matches the repaired labels through the first error (``match='steps'``) or only
    the final verdict matches the outcome and the chain states an answer (``match='outcome'``).
    Kept chains are cleaned (text after the last verdict and thinking parts removed), optionally
    length-filtered (K18), wrapped in a think block, and end with the final yes/no line.
    """
    if match not in ("steps", "outcome"):
        raise ValueError(f"unknown match rule {match!r}")
    # verdicts are read before the join: where the text isn't needed, it isn't shuffled
    g = generations.withColumn("_dec", VD.boxed_verdicts(text)).withColumn("_answers", F.col(text).contains(VD.ANSWER_PHRASE))
    j = g.join(solution_summary(steps, ["problem_id"]), "problem_id")
    n = F.size("_dec")
    fmt = (n == 0) | ((n != F.col("n_keep")) & (n != F.col("n_steps")))
    if match == "steps":
        bad = ~VD.matches_through(F.col("_dec"), F.col("n_keep"), F.col("last_plus"))
    else:
        bad = (F.try_element_at("_dec", F.lit(-1)) != F.col("is_correct")) | ~F.col("_answers")
    j = j.withColumn("reject_reason", F.when(fmt, F.lit("bad_format")).when(bad, F.lit("bad_decisions"))).drop("_dec", "_answers")
    j = _cap(j, max_per_solution, keep_rejected)
    cleaned = VD.strip_thinking(VD.truncate_after_last_verdict(F.col(text)), legacy=legacy_think)
    j = j.withColumn("_clean", cleaned)
    if max_tokens is not None:
        j = j.withColumn("reject_reason", F.coalesce(
            F.col("reject_reason"), F.when(token_len(F.col("_clean")) > max_tokens, F.lit("too_long"))))
        if not keep_rejected:
            j = j.filter(F.col("reject_reason").isNull())
    j = _with_texts(j, steps)
    body = F.concat(F.lit(VD.THINK_OPEN + "\n"), F.col("_clean"), F.lit("\n" + VD.THINK_CLOSE)) if add_think else F.col("_clean")
    cot = F.concat(body, F.lit("\n" + VD.PREDECISION + " "), F.when(F.col("is_correct"), "Yes").otherwise("No"))
    out = j.select(
        "problem_id", "gen_idx", "solution", "solution_steps", cot.alias("cot"),
        repaired_labels(F.col("n_steps"), F.col("last_plus")).alias("labels"), "is_correct", "n_steps", "reject_reason",
    ).withColumn("cot_steps", VD.lines("cot"))
    return out if keep_rejected else out.drop("reject_reason")


def add_partial_prefixes(chains: DataFrame, p: float, seed: int, min_steps: int = 4) -> DataFrame:
    """K3: for a keyed-random share ``p`` of chains with at least ``min_steps`` steps, add a copy
    cut at a random step k in [1, n-1]: solution and labels cut to k steps, the chain cut after
    its k-th verdict, and a final verdict line from the k-th label. Chains with fewer than k
    verdicts get no copy."""
    key = ["problem_id", "gen_idx"]
    pick = sample_fraction(chains.filter(F.col("n_steps") >= min_steps), p, seed, key)
    k = random_cut(F.col("n_steps"), seed + 1, key)
    pick = pick.withColumn("_k", k.cast("int"))
    labels = F.slice("labels", 1, F.col("_k"))
    ok_last = F.element_at(labels, -1) == "+"
    body = VD.cut_after_kth_verdict(F.col("cot"), F.col("_k"))
    part = pick.select(
        "problem_id", "gen_idx",
        F.array_join(F.slice("solution_steps", 1, F.col("_k")), "\n").alias("solution"),
        F.slice("solution_steps", 1, F.col("_k")).alias("solution_steps"),
        F.concat(body, F.lit("\n" + VD.PREDECISION + " "), F.when(ok_last, "Yes").otherwise("No")).alias("cot"),
        labels.alias("labels"), ok_last.alias("is_correct"), F.col("_k").alias("n_steps"),
    ).filter(body.isNotNull()).withColumn("cot_steps", VD.lines("cot")).withColumn("partial", F.lit(True))
    return chains.withColumn("partial", F.lit(False)).unionByName(part, allowMissingColumns=True)


def gold_line(prompt: str | Column) -> Column:
    """K4: the gold solution — the last prompt line starting ``Correct solution``, label removed."""
    p = F.col(prompt) if isinstance(prompt, str) else prompt
    last = F.try_element_at(F.filter(VD.lines(p), lambda s: s.startswith("Correct solution")), F.lit(-1))
    return F.trim(F.replace(last, F.lit("Correct solution:"), F.lit("")))


def add_gold_copies(chains: DataFrame, gold: DataFrame, p: float, seed: int) -> DataFrame:
    """K4: duplicate a keyed-random share ``p`` of chains with the gold solution attached."""
    pick = sample_fraction(chains, p, seed, ["problem_id", "gen_idx"]).join(gold, "problem_id")
    return chains.unionByName(pick, allowMissingColumns=True)


def preference_pairs(steps: DataFrame, generations: DataFrame, text: str = "text", k: int = 1) -> DataFrame:
    """K5: chosen/rejected chain pairs per solution.

    A chain qualifies when it has one answered ``correct?`` line per step. It is *chosen* when its
    verdicts equal the repaired labels through the first error, else *rejected* with the number
    of differing verdicts. Chosen chains in generation order are paired with rejected chains
    ranked most-wrong first (ties in generation order), pair i with pair i, i <= k.
    """
    # question lines are read once, before the join; NULL where one has no answer
    key = ["problem_id", "gen_idx"]
    read = F.transform(VD.question_lines(text), lambda s: F.lower(s)).alias("_q")
    answered = F.forall("_q", lambda s: s.contains(VD.YES_MARK) | s.contains(VD.NO_MARK))
    dec = F.when(answered, F.transform("_q", lambda s: s.contains(VD.YES_MARK)))
    scalars = solution_summary(steps, ["problem_id"])
    j = generations.select(*key, read).select(*key, dec.alias("_dec")).join(scalars, "problem_id").filter(F.size("_dec") == F.col("n_steps"))
    ids = j.select(*key, VD.mismatches_through(F.col("_dec"), F.col("n_keep"), F.col("last_plus")).alias("_diff"))
    # ids are ranked and paired; texts meet the pairs of their solution, and each other, without another shuffle
    chosen = top_k_within(ids.filter(F.col("_diff") == 0), ["problem_id"], [F.col("gen_idx")], k, "rank", salt_cols=key)
    rejected = top_k_within(ids.filter(F.col("_diff") > 0), ["problem_id"], [F.col("_diff").desc(), F.col("gen_idx")], k, "rank", salt_cols=key)
    pairs = chosen.select("problem_id", "rank", F.col("gen_idx").alias("chosen_gen"), F.lit(0).alias("n_wrong")).unionByName(
        rejected.select("problem_id", "rank", F.col("gen_idx").alias("rejected_gen"), F.col("_diff").alias("n_wrong")), allowMissingColumns=True)
    pairs = pairs.groupBy("problem_id", "rank").agg(F.max("chosen_gen").alias("chosen_gen"), F.max("rejected_gen").alias("rejected_gen"), F.max("n_wrong").alias("n_wrong"))
    pairs = pairs.filter(F.col("chosen_gen").isNotNull() & F.col("rejected_gen").isNotNull())
    of = pairs.groupBy("problem_id").agg(F.collect_list(F.struct("rank", "chosen_gen", "rejected_gen", "n_wrong")).alias("_pairs"))
    texts = generations.select(*key, text).join(of.join(scalars, "problem_id"), "problem_id")
    texts = texts.withColumn("_pair", F.explode(F.filter("_pairs", lambda p: (p["chosen_gen"] == F.col("gen_idx")) | (p["rejected_gen"] == F.col("gen_idx")))))
    cot = F.array_join(VD.pad_after_error(F.col(text), F.col("n_keep"), F.col("n_steps")), "\n")
    texts = texts.select("problem_id", "gen_idx", "_pair", cot.alias("_cot"))
    side = lambda name: F.max(F.when(F.col("gen_idx") == F.col(f"_pair.{name}_gen"), F.col("_cot"))).alias(f"{name}_cot")
    found = texts.groupBy("problem_id", "_pair").agg(side("chosen"), side("rejected")).select("problem_id", "_pair.*", "chosen_cot", "rejected_cot")
    return _with_texts(found, steps).select("problem_id", "rank", "solution", "solution_steps", "chosen_gen", "chosen_cot", "rejected_gen", "rejected_cot", "n_wrong")


def preference_rows(pairs: DataFrame, problems: DataFrame, problem: str = "problem") -> DataFrame:
    """K5, as training text: (problem_id, rank, prompt, chosen, rejected). The prompt is the verification
    request of the problem's text (``problems``: problem_id, ``problem``) and the judged solution, open for an answer."""
    j = pairs.join(problems.select("problem_id", F.col(problem).alias("_problem")), "problem_id")
    return j.select("problem_id", "rank", verification_prompt(F.col("_problem"), F.col("solution")).alias("prompt"),
                    F.col("chosen_cot").alias("chosen"), F.col("rejected_cot").alias("rejected"))


def filter_by_length(df: DataFrame, col: str, max_tokens: int,
                     token_len: Callable[[Column], Column] = token_count) -> DataFrame:
    """Keep rows whose text has at most ``max_tokens`` tokens."""
    return df.filter(token_len(F.col(col)) <= max_tokens)


def balanced(chains: DataFrame, seed: int = 42) -> DataFrame:
    """L4 on curated chains: equal numbers of correct and incorrect chains."""
    return balance(chains, "is_correct", seed, ["problem_id", "gen_idx"])


def sample_chains(chains: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """L3 on curated chains: a keyed shuffle, then the first n."""
    return sample_n(chains, n, seed, ["problem_id", "gen_idx"], written=True)


def grade_candidates(df: DataFrame, text: str, gold: str, benchmark: str = "math", out: str = "is_correct") -> DataFrame:
    """Extract each candidate's answer (H11, H12 per distinct answer) and compare it with the
    gold answer (H16); a comparison that cannot decide counts as false."""
    from stepjudge.functions.answers import answers_equal, extract_answers
    p = extract_answers(df, text, "pred", benchmark)
    return p.withColumn(out, F.coalesce(answers_equal(F.col("pred"), F.col(gold)), F.lit(False)))
