"""Answer selection: step-score aggregation, the N sweep, and the three votes.

Long form everywhere: one row per (problem, candidate). Every vote is a two-level aggregate
(answer group, then problem), so Spark runs it with partial aggregation: a problem with a huge
number of candidates is combined map-side and never lands whole in one task. Ties are named
explicitly: the group (or candidate) that appears first — the lowest ``idx`` — wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEP_AGGREGATES = ("min", "prod", "last")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def aggregate_steps(scores: str | Column, how: str = "last") -> Column:
    """Collapse an array of step scores to one: ``min``, ``prod`` or ``last``."""
    if how not in STEP_AGGREGATES:
        raise ValueError(f"unknown step aggregate {how!r}; expected one of {STEP_AGGREGATES}")
    a = _c(scores)
    if how == "min":
        return F.array_min(a)
    if how == "prod":
        return F.aggregate(a, F.lit(1.0).cast("double"), lambda acc, x: acc * x)
    return F.try_element_at(a, F.lit(-1))


def aggregate_steps_long(df: DataFrame, by: Sequence[str], step: str, score: str, how: str = "last",
                         name: str = "agg_score") -> DataFrame:
    """D1 on a long step table: ``min``, product or the score at the largest step index."""
    if how not in STEP_AGGREGATES:
        raise ValueError(f"unknown step aggregate {how!r}; expected one of {STEP_AGGREGATES}")
    return df.groupBy(*by).agg(step_aggregate(step, score, how).alias(name))


def step_aggregate(step: str, score: str, how: str) -> Column:
    """D1 as an aggregate over a long step table."""
    s = F.col(score).cast("double")
    return {"min": F.min(s), "prod": F.product(s), "last": F.max_by(s, F.col(step))}[how]


def boxed(col: str | Column) -> Column:
    """Wrap in ``\\boxed{}``."""
    return F.concat(F.lit("\\boxed{"), _c(col), F.lit("}"))


def doubling_ns(max_n: int) -> list[int]:
    """1, 2, 4, ... up to ``max_n``."""
    ns, n = [], 1
    while n <= max_n:
        ns.append(n)
        n *= 2
    return ns


def sweep(df: DataFrame, ns: Sequence[int], idx: str = "idx") -> DataFrame:
    """One row per (candidate, n) for every n with ``idx < n`` — the first n candidates of
    every problem, all n in one pass (no job per n)."""
    arr = F.array(*[F.lit(int(n)) for n in ns])
    return df.withColumn("n", F.explode(F.filter(arr, lambda n: _c(idx) < n)))


def exact(df: DataFrame, score: str) -> Column:
    """A score that sums without rounding, whatever the order: decimals and integers as they are, doubles
    as DECIMAL(38,18). A sum that doesn't fit is an error, not a wrong winner."""
    if isinstance(df.schema[score].dataType, (T.DecimalType, T.IntegralType)):
        return F.col(score)
    return F.col(score).cast("decimal(38,18)")


def first_sweep(df: DataFrame, ns: Sequence[int], idx: str = "idx") -> DataFrame:
    """D2 for aggregates: every candidate once, under the least n that holds it (column ``_n``)."""
    least = F.array_min(F.filter(F.array(*[F.lit(int(n)) for n in ns]), lambda n: _c(idx) < n))
    return df.withColumn("_n", least).where(F.col("_n").isNotNull())


def later_ns(df: DataFrame, ns: Sequence[int]) -> DataFrame:
    """Each partial aggregate of ``first_sweep`` under every n from its own on (column ``n``)."""
    return df.withColumn("n", F.explode(F.filter(F.array(*[F.lit(int(n)) for n in ns]), lambda n: n >= F.col("_n")))).drop("_n")


def _first_group_stats(df: DataFrame, by: Sequence[str], key: str, answer: str, idx: str,
                       score: str | None) -> DataFrame:
    """Per answer group: size, first index, first answer text and (optionally) score sum.

    Two steps: a hash aggregate per distinct (group, answer text) with numeric buffers only — the
    pass over every candidate — then the text of the first index per group, a (sort-based)
    aggregate over distinct answers only."""
    pre = [F.count(F.lit(1)).alias("_c0"), F.min(idx).alias("_i0")]
    if score is not None:
        pre.append(F.sum(exact(df, score)).alias("_w0"))
    d = df.groupBy(*by, key, answer).agg(*pre)
    aggs = [
        F.sum("_c0").alias("_cnt"),
        F.min("_i0").alias("_first_idx"),
        F.min_by(F.col(answer), F.col("_i0")).alias("_first_answer"),
    ]
    if score is not None:
        aggs.append(F.sum("_w0").alias("_weight"))
    return d.groupBy(*by, key).agg(*aggs)


def vote_weighted(df: DataFrame, by: Sequence[str] = ("problem_id",), key: str = "answer_key",
                  score: str = "score", answer: str = "answer", idx: str = "idx") -> DataFrame:
    """D3: the answer group with the largest score sum; ties to the group seen first.
    Returns (by..., pred, pred_key, weight) — ``pred`` is the first original answer of the group."""
    g = _first_group_stats(df, by, key, answer, idx, score)
    win = F.max_by(F.struct(F.col("_first_answer").alias("a"), F.col(key).alias("k"), F.col("_weight").alias("w")),
                   F.struct(F.col("_weight"), -F.col("_first_idx")))
    return g.groupBy(*by).agg(win.alias("_w")).select(
        *by, F.col("_w.a").alias("pred"), F.col("_w.k").alias("pred_key"), F.col("_w.w").alias("weight"))


def vote_majority(df: DataFrame, by: Sequence[str] = ("problem_id",), key: str = "answer_key",
                  answer: str = "answer", idx: str = "idx") -> DataFrame:
    """The most frequent answer group; ties to the group seen first."""
    g = _first_group_stats(df, by, key, answer, idx, None)
    win = F.max_by(F.struct(F.col("_first_answer").alias("a"), F.col(key).alias("k"), F.col("_cnt").alias("c")),
                   F.struct(F.col("_cnt"), -F.col("_first_idx")))
    return g.groupBy(*by).agg(win.alias("_w")).select(
        *by, F.col("_w.a").alias("pred"), F.col("_w.k").alias("pred_key"), F.col("_w.c").cast("bigint").alias("votes"))


def first_argmax(value: str | Column, score: str | Column, idx: str | Column = "idx") -> Column:
    """``value`` of the row with the largest score, the lowest idx on ties (an aggregate)."""
    return F.max_by(_c(value), F.struct(_c(score), -_c(idx)))


def vote_best(df: DataFrame, by: Sequence[str] = ("problem_id",), score: str = "score",
              answer: str = "answer", key: str = "answer_key", idx: str = "idx") -> DataFrame:
    """Best-of-N — the top-scored candidate, first on ties."""
    best = first_argmax(F.struct(F.col(answer).alias("a"), F.col(key).alias("k"), F.col(score).alias("s")),
                        score, idx)
    return df.groupBy(*by).agg(best.alias("_b")).select(
        *by, F.col("_b.a").alias("pred"), F.col("_b.k").alias("pred_key"), F.col("_b.s").alias("best_score"))


def vote_sweep(df: DataFrame, ns: Sequence[int], by: Sequence[str] = ("problem_id",), key: str = "answer_key",
               score: str = "score", answer: str = "answer", idx: str = "idx",
               gold: str | None = "gold_key") -> DataFrame:
    """Naive, weighted and majority votes for every n in one plan.

    Every candidate is aggregated once, per distinct (problem, least n that holds it, key, answer);
    these partial sums are then added up for every n, by answer group and by problem. Returns
    (by..., n, pred_naive, pred_weighted, pred_maj, key_naive, key_weighted, key_maj[, gold, covered]).
    """
    keys0 = [*by, "_n", key, answer] + ([gold] if gold is not None else [])
    d = first_sweep(df, ns, idx).groupBy(*keys0).agg(
        F.count(F.lit(1)).alias("_c0"), F.sum(exact(df, score)).alias("_w0"), F.min(idx).alias("_i0"),
        F.max(F.struct(F.col(score), -F.col(idx))).alias("_b0"))
    d = later_ns(d, ns)
    lvl1 = [
        F.sum("_c0").alias("_cnt"),
        F.sum("_w0").alias("_weight"),
        F.min("_i0").alias("_first_idx"),
        F.min_by(F.col(answer), F.col("_i0")).alias("_first_answer"),
        F.max_by(F.struct(F.col("_b0").alias("o"), F.col(answer)), F.col("_b0")).alias("_best"),
    ]
    if gold is not None:
        lvl1.append(F.max(gold).alias("_gold"))
    g = d.groupBy(*by, "n", key).agg(*lvl1)
    grp = F.struct(F.col("_first_answer").alias("a"), F.col(key).alias("k"))
    lvl2 = [
        F.max_by(F.struct(F.col("_best").getField(answer).alias(answer), F.col(key).alias("k")),
                 F.col("_best.o")).alias("_naive"),
        F.max_by(grp, F.struct(F.col("_weight"), -F.col("_first_idx"))).alias("_wt"),
        F.max_by(grp, F.struct(F.col("_cnt"), -F.col("_first_idx"))).alias("_mj"),
    ]
    if gold is not None:
        lvl2 += [F.max("_gold").alias("gold"), F.bool_or(F.col(key) == F.col("_gold")).alias("covered")]
    r = g.groupBy(*by, "n").agg(*lvl2)
    cols = [
        *by, F.col("n").cast("bigint").alias("n"),
        boxed(F.col("_naive").getField(answer)).alias("pred_naive"),
        boxed(F.col("_wt.a")).alias("pred_weighted"),
        boxed(F.col("_mj.a")).alias("pred_maj"),
        F.col("_naive.k").alias("key_naive"), F.col("_wt.k").alias("key_weighted"), F.col("_mj.k").alias("key_maj"),
    ]
    if gold is not None:
        cols += ["gold", "covered"]
    return r.select(*cols)
