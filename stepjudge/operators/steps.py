"""Step-label logic on long step tables ``(solution keys..., step_idx, label)``.

The reference's running windows over a solution's labels all reduce to two per-solution scalars:
the index of the last correct step (label repair) and the index of the first error. Both are
aggregates (partial aggregation, skew-safe) joined back on the solution key (AQE splits a skewed
join partition), instead of windows that would put a whole solution in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepjudge.functions.verdicts import step_label


def solution_summary(steps: DataFrame, by: Sequence[str] = ("problem_id",), step: str = "step_idx",
                     label: str = "gt_label") -> DataFrame:
    """Per solution: ``n_steps``, ``last_plus`` (index of the last correct label, NULL if none),
    ``first_err`` (index of the first incorrect label after repair), ``n_keep`` (labels through the
    first error) and ``is_correct`` (last repaired label is correct)."""
    ok = step_label(label)
    g = steps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.max(F.when(ok, F.col(step))).alias("last_plus"),
        F.max(step).alias("_last_idx"),
    )
    first_err = F.when(F.col("last_plus").isNull(), F.lit(0)).when(
        F.col("last_plus") < F.col("_last_idx"), F.col("last_plus") + 1)
    return g.select(
        *by, F.col("n_steps").cast("int").alias("n_steps"), F.col("last_plus").cast("int").alias("last_plus"),
        first_err.cast("int").alias("first_err"),
        F.coalesce(first_err + 1, F.col("n_steps")).cast("int").alias("n_keep"),
        F.coalesce(F.col("last_plus") == F.col("_last_idx"), F.lit(False)).alias("is_correct"),
    )


def repair_labels(steps: DataFrame, by: Sequence[str] = ("problem_id",), step: str = "step_idx",
                  label: str = "gt_label", out: str = "label") -> DataFrame:
    """Every step up to the last correct one becomes correct ('+'); the rest stay '-'."""
    s = solution_summary(steps, by, step, label).select(*by, "last_plus")
    j = steps.join(s, list(by))
    return j.withColumn(out, F.when(F.col(step) <= F.col("last_plus"), "+").otherwise(
        F.when(step_label(label), "+").otherwise("-"))).drop("last_plus")


def _with_first_err(steps: DataFrame, by, step, label) -> DataFrame:
    ok = step_label(label)
    fe = steps.groupBy(*by).agg(F.min(F.when(~ok, F.col(step))).alias("_fe"))
    return steps.join(fe, list(by))


def until_first_error(steps: DataFrame, by: Sequence[str] = ("problem_id",), step: str = "step_idx",
                      label: str = "gt_label") -> DataFrame:
    """The steps up to and including the first incorrect one (all when there is none)."""
    j = _with_first_err(steps, by, step, label)
    return j.filter(F.col("_fe").isNull() | (F.col(step) <= F.col("_fe"))).drop("_fe")


def propagate_error(steps: DataFrame, by: Sequence[str] = ("problem_id",), step: str = "step_idx",
                    label: str = "gt_label", out: str = "label") -> DataFrame:
    """Labels through the first error as they are, '-' after it."""
    j = _with_first_err(steps, by, step, label)
    keep = F.col("_fe").isNull() | (F.col(step) <= F.col("_fe"))
    return j.withColumn(out, F.when(keep & step_label(label), "+").otherwise("-")).drop("_fe")


def first_error_mask(steps: DataFrame, by: Sequence[str] = ("problem_id",), step: str = "step_idx",
                     label: str = "gt_label", out: str = "mask") -> DataFrame:
    """1 through the first error, 0 after it."""
    j = _with_first_err(steps, by, step, label)
    keep = F.col("_fe").isNull() | (F.col(step) <= F.col("_fe"))
    return j.withColumn(out, F.when(keep, 1).otherwise(0)).drop("_fe")


def align_steps(verdicts: DataFrame, labels: DataFrame, by: Sequence[str] = ("problem_id",),
                step: str = "step_idx") -> DataFrame:
    """Verdict i next to label i, only where both exist (an inner equi-join: the shorter list
    wins, as Python's ``zip`` does). Labels are as many as steps: their few bytes a row in Parquet may
    look small enough to pass through the driver as a broadcast table, so the join is a sorted one."""
    return verdicts.join(labels.hint("merge"), [*by, step])


def mean_verifications(df: DataFrame, by: Sequence[str], score: str, name: str = "score") -> DataFrame:
    """The mean of K parallel verification scores."""
    return df.groupBy(*by).agg(F.avg(F.col(score).cast("double")).alias(name), F.count(F.lit(1)).alias("k"))


def mean_steps(df: DataFrame, by: Sequence[str], step: str, score: str, neutral: float = 0.5) -> DataFrame:
    """Position-wise mean over several verifications ignoring missing scores; a position with
    no score anywhere gets ``neutral``. Returns per (by..., step) and, via ``solution_score``, the
    score of the last position."""
    g = df.groupBy(*by, step).agg(F.avg(F.col(score).cast("double")).alias("_m"))
    return g.select(*by, step, F.coalesce(F.col("_m"), F.lit(float(neutral))).alias("step_score"))


def solution_score(step_scores: DataFrame, by: Sequence[str], step: str, score: str = "step_score") -> DataFrame:
    """The score at the last position of each solution."""
    return step_scores.groupBy(*by).agg(F.max_by(F.col(score), F.col(step)).alias("solution_score"))


def step_pass_rate(df: DataFrame, by: Sequence[str], verdict: str) -> DataFrame:
    """The share of steps judged correct."""
    return df.groupBy(*by).agg(F.avg(step_label(verdict).cast("double")).alias("pass_rate"))
