"""Evaluation metrics: coverage, pass@k, accuracy tables, calibration and rank correlation.

All metrics are aggregates with partial (map-side) aggregation. The ones that need an order —
AUC, Spearman, Kendall — are reduced to counts per distinct value first and then to a running
sum over those counts (``operators.ranking.running``), so no metric ever needs all pairs, a
global sort in one task, or a group collected into one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepjudge.operators.ranking import running
from stepjudge.operators.votes import exact, sweep
from stepjudge.session import checkpoint_dir


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def r6(x: str | Column) -> Column:
    """Round a double to 6 digits (the comparison rule of the fixtures); ``+ 0.0`` turns a
    negative zero into zero so equal values also hash equally."""
    return F.round(_c(x).cast("double"), 6) + F.lit(0.0)


# ------------------------------------------------------------------------------------ pass@k


def pass_at_k(n: str | Column, c: str | Column, k: int | str | Column) -> Column:
    """Unbiased pass@k = 1 - prod_{i=n-c+1..n} (1 - k/i); 1 when n - c < k.

    ``c = 0`` has its own branch: ``sequence(n+1, n)`` would count down instead of being empty.
    """
    n, c = _c(n), _c(c)
    k = F.lit(k) if isinstance(k, int) else _c(k)
    prod = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, i: acc * (1.0 - k / i))
    return F.when(n - c < k, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(1.0 - prod)


def problem_pass_at_k(df: DataFrame, ks: Sequence[int], by: Sequence[str] = ("problem_id",),
                      key: str = "answer_key", gold: str = "gold_key") -> DataFrame:
    """pass@k per problem from answer keys; one row per (problem, k)."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_samples"),
                            F.count_if(F.col(key) == F.col(gold)).alias("n_correct"))
    g = g.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))
    return g.withColumn("pass_at_k", pass_at_k("n_samples", "n_correct", "k"))


def problem_pass_at_1(df: DataFrame, by: Sequence[str] = ("problem_id",), correct: str = "is_correct") -> DataFrame:
    """pass@1 per problem = correct / candidates; unreadable (NULL) counts as wrong."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if(F.coalesce(F.col(correct), F.lit(False))).alias("n_correct"),
    ).withColumn("pass_at_1", F.coalesce(F.try_divide(F.col("n_correct"), F.col("n_samples")), F.lit(0.0)))


# ------------------------------------------------------------------------------------ accuracy


def coverage(df: DataFrame, ns: Sequence[int], by: Sequence[str] = ("problem_id",), correct: Column | str | None = None,
             idx: str = "idx") -> DataFrame:
    """coverage@n ×100 — share of problems with any correct candidate among the first n."""
    ok = F.coalesce(_c(correct) if correct is not None else (F.col("answer_key") == F.col("gold_key")), F.lit(False))
    s = sweep(df.withColumn("_ok", ok), ns, idx)
    per = s.groupBy(*by, "n").agg(F.bool_or("_ok").alias("_any"))
    return per.groupBy("n").agg(
        F.count(F.lit(1)).alias("problems"),
        (F.avg(F.col("_any").cast("double")) * 100).alias("cov"),
    )


def accuracy(df: DataFrame, correct: str = "is_correct", score: str | None = "score",
             status: str | None = None) -> DataFrame:
    """Accuracy ×100, number of samples, of scored samples, and of failed comparisons with their share ×100."""
    aggs = [
        (F.avg(F.coalesce(F.col(correct), F.lit(False)).cast("double")) * 100).alias("acc"),
        F.count(F.lit(1)).alias("num_samples"),
    ]
    if score is not None:
        aggs.append(F.count(score).alias("num_scores"))
    if status is not None:
        failed = F.coalesce(F.col(status) == "error", F.lit(False))
        aggs += [F.count_if(failed).alias("timeout_samples"), (F.avg(failed.cast("double")) * 100).alias("timeout_share")]
    return df.agg(*aggs)


def scaling_table(df: DataFrame, ns: Sequence[int], by: Sequence[str] = ("problem_id",), key: str = "answer_key",
                  score: str = "score", idx: str = "idx", gold: str = "gold_key") -> DataFrame:
    """``n, problems, acc_naive, acc_weighted, acc_maj, cov`` — votes, coverage and accuracy
    for every n in one plan (three aggregation levels, no job per n).

    Only correctness is needed here, not the winning texts: an answer group is a hit when its key is the gold
    key. Every candidate is aggregated once, into one row per answer group with the figures of every n, and groups
    into one row per problem; rows per n are told apart only then. Scores are compared as they are and summed
    exactly (``votes.exact``), so this table and the votes never disagree.
    """
    ns = sorted({int(n) for n in ns})
    at, s, hit = F.col(idx), exact(df, score), F.col(key) == F.col(gold)
    per_n = lambda make: [make(n, f"{n}") for n in ns]
    groups = df.where(at < ns[-1]).groupBy(*by, key).agg(
        F.min(idx).alias("_fi"), F.min(F.when(hit, at)).alias("_right"), F.min(F.when(~hit, at)).alias("_wrong"),
        *per_n(lambda n, i: F.count(F.when(at < n, 1)).alias("_cnt" + i)),
        *per_n(lambda n, i: F.sum(F.when(at < n, s)).alias("_w" + i)),
        *per_n(lambda n, i: F.max(F.when(at < n, F.struct(F.col(score), -at))).alias("_best" + i)))

    def votes(n: int, i: str) -> Column:
        there = F.col("_fi") < n
        hits = F.when(F.col("_right") < n, 1).when(F.col("_wrong") < n, 0)
        ranked = lambda c: F.when(there, F.struct(F.col(c + i), -F.col("_fi")))
        return F.struct(F.lit(n).cast("bigint").alias("n"), F.bool_or(there).alias("there"), F.max_by(hits, F.col("_best" + i)).alias("naive"),
                        F.max_by(hits, ranked("_w")).alias("weighted"), F.max_by(hits, ranked("_cnt")).alias("maj"), F.max(hits).alias("covered"))

    of_n = groups.groupBy(*by).agg(F.array(*per_n(votes)).alias("_of_n")).select(F.inline("_of_n")).where("there")
    pct = lambda c: F.avg(F.col(c).cast("double")) * 100
    return of_n.groupBy("n").agg(
        F.count(F.lit(1)).alias("problems"), pct("naive").alias("acc_naive"), pct("weighted").alias("acc_weighted"),
        pct("maj").alias("acc_maj"), pct("covered").alias("cov"))


def accuracy_by(df: DataFrame, col: str, correct: str = "is_correct", total: bool = True) -> DataFrame:
    """Accuracy ×100 by a column, rounded to one decimal; with ``total`` a grand-total row
    (``col`` NULL) from the same aggregation (GROUPING SETS)."""
    acc = F.round(F.avg(F.coalesce(F.col(correct), F.lit(False)).cast("double")) * 100, 1)
    if total:
        g = df.rollup(col).agg(acc.alias("acc"), F.count(F.lit(1)).alias("num_samples"))
    else:
        g = df.groupBy(col).agg(acc.alias("acc"), F.count(F.lit(1)).alias("num_samples"))
    return g


def count_empty(df: DataFrame, col: str = "pred") -> DataFrame:
    """Number of empty predictions."""
    return df.agg(F.count_if(F.col(col) == "").alias("empty_samples"), F.count(F.lit(1)).alias("num_samples"))


def macro_average(df: DataFrame, group: str, value: Column | str) -> DataFrame:
    """Mean of per-group means."""
    per = df.groupBy(group).agg(F.avg(_c(value).cast("double")).alias("_m"))
    return per.agg(F.avg("_m").alias("macro_avg"), F.count(F.lit(1)).alias("groups"))


def difficulty_level(metric: str | Column, cuts: Column) -> Column:
    """Level 5 (hard) .. 1 (easy) from four ascending cut points, strict ``<``."""
    m = _c(metric)
    return (F.when(m < cuts[0], 5).when(m < cuts[1], 4).when(m < cuts[2], 3).when(m < cuts[3], 2).otherwise(1))


def quintiles(df: DataFrame, metric: str) -> Column:
    """Cut points at 20/40/60/80 % (linear interpolation) as a scalar subquery Column, by one rule at
    every size: counts per distinct value, their running sum, and the values at the ranks around each
    cut. No group is held in a buffer."""
    counts = df.where(F.col(metric).isNotNull()).groupBy(F.col(metric).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    cum = running(counts, [], ["_v"], {"_upto": ("sum", "_n")})
    total = counts.agg(F.sum("_n")).scalar()
    cum = cum.withColumn("_rows", total)
    cuts = []
    for p in (0.2, 0.4, 0.6, 0.8):
        at = F.lit(p) * (F.col("_rows") - 1)
        cuts += [F.min(F.when(F.col("_upto") > F.floor(at), F.col("_v"))), F.min(F.when(F.col("_upto") > F.ceil(at), F.col("_v"))), F.max(at - F.floor(at))]
    row = cum.agg(*[c.alias(f"_{i}") for i, c in enumerate(cuts)])
    q = F.array(*[F.col(f"_{i}") + (F.col(f"_{i + 1}") - F.col(f"_{i}")) * F.col(f"_{i + 2}") for i in range(0, len(cuts), 3)])
    return row.select(q.alias("q")).scalar()


def mean_by_position(df: DataFrame, by: Sequence[str], pos: str, value: str) -> DataFrame:
    """Column means of a ragged score matrix whose short rows are padded with their last value.

    Row r contributes its value at position p when it has p, else its last value. Partial sums:
    sum over existing cells plus, for every row shorter than p, its last value — computed from
    per-length totals with a running sum, never materialising the padded matrix.
    """
    rows = df.groupBy(*by).agg(F.max(pos).alias("_len"), F.max_by(F.col(value).cast("double"), F.col(pos)).alias("_last"))
    cells = df.groupBy(pos).agg(F.sum(F.col(value).cast("double")).alias("_s"), F.count(F.lit(1)).alias("_n"))
    # rows whose last position is L pad every p > L with _last
    ends = rows.groupBy(F.col("_len").alias(pos)).agg(F.sum("_last").alias("_pad_s"), F.count(F.lit(1)).alias("_pad_n"))
    both = cells.join(ends, pos, "full").fillna(0, subset=["_s", "_n", "_pad_s", "_pad_n"])
    # padding carried into position p = sum over L < p of ends(L)
    sc = running(both, [], [pos], {"_cs": ("sum", "_pad_s"), "_cn": ("sum", "_pad_n")})
    return sc.select(
        F.col(pos),
        ((F.col("_s") + F.col("_cs") - F.col("_pad_s")) / (F.col("_n") + F.col("_cn") - F.col("_pad_n"))).alias("mean_score"),
    )


# ------------------------------------------------------------------------------------ calibration


def bin_index(conf: str | Column, bins: int = 10) -> Column:
    """Bin of a confidence: number of edges ``i*(1/bins) <= conf`` minus one, clipped to [0, bins-1].

    Edges are built as ``i * step`` (as an evenly spaced grid is), so 0.3 lands in bin 2 when
    3*0.1 > 0.3 — the same as the reference's binning, unlike ``floor(conf*bins)``.
    """
    step = 1.0 / bins
    edges = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.when(i == bins, F.lit(1.0)).otherwise(i * F.lit(step)))
    cnt = F.size(F.filter(edges, lambda e: e <= _c(conf)))
    return F.least(F.greatest(cnt - 1, F.lit(0)), F.lit(bins - 1))


def normalize_by_max(df: DataFrame, col: str = "conf") -> DataFrame:
    """Divide by the global maximum when it is positive (scalar subquery, no join)."""
    mx = df.select(F.max(col)).scalar()
    return df.withColumn(col, F.when(mx > 0, F.col(col) / mx).otherwise(F.col(col)))


def reliability_table(df: DataFrame, conf: str = "conf", correct: str = "correct", bins: int = 10) -> DataFrame:
    """Per bin — edge, centre, accuracy (0 when empty), count."""
    step = 1.0 / bins
    per = df.groupBy(bin_index(conf, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("bin_count"),
        F.avg(F.col(correct).cast("double")).alias("bin_accuracy"),
        F.avg(F.col(conf).cast("double")).alias("bin_confidence"),
    )
    grid = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return grid.join(per, "bin", "left").select(
        F.col("bin"),
        (F.col("bin") * F.lit(step)).alias("bin_edge"),
        ((F.col("bin") * F.lit(step) + F.when(F.col("bin") + 1 == bins, F.lit(1.0))
          .otherwise((F.col("bin") + 1) * F.lit(step))) / 2).alias("bin_center"),
        F.coalesce("bin_accuracy", F.lit(0.0)).alias("bin_accuracy"),
        F.coalesce("bin_confidence", F.lit(0.0)).alias("bin_confidence"),
        F.coalesce("bin_count", F.lit(0)).cast("bigint").alias("bin_count"),
    )


def ece(df: DataFrame, conf: str = "conf", correct: str = "correct", bins: int = 10) -> DataFrame:
    """Expected calibration error = sum_b n_b/N * |acc_b - conf_b|."""
    t = reliability_table(df, conf, correct, bins)
    return t.agg(
        (F.sum(F.col("bin_count") * F.abs(F.col("bin_accuracy") - F.col("bin_confidence"))) / F.sum("bin_count")).alias("ece"),
        F.sum("bin_count").alias("num_samples"),
    )


def auc_roc(df: DataFrame, conf: str = "conf", correct: str = "correct", by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC (Mann-Whitney, half credit for tied scores); 0.5 with a single class.

    Counts per distinct score, then a running count of negatives below each score.
    """
    by = list(by)
    y = F.col(correct).cast("double") > 0
    per = df.groupBy(*by, F.col(conf).alias("_s")).agg(F.count_if(y).alias("_pos"), F.count_if(~y).alias("_neg"))
    rs = running(per, by, ["_s"], {"_neg_le": ("sum", "_neg")})
    below = F.col("_neg_le") - F.col("_neg")
    out = rs.groupBy(*by).agg(
        F.sum(F.col("_pos") * (below + 0.5 * F.col("_neg"))).alias("_u"),
        F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"),
    )
    return out.select(*by, F.when((F.col("_p") == 0) | (F.col("_n") == 0), F.lit(0.5))
                      .otherwise(F.col("_u") / (F.col("_p") * F.col("_n"))).alias("auc_roc"))


def calibration_report(df: DataFrame, conf: str = "conf", correct: str = "correct", bins: int = 10,
                       normalize: bool = False) -> DataFrame:
    """One row with num_samples, ece, auc_roc."""
    d = normalize_by_max(df, conf) if normalize else df
    # both parts are one-row aggregates: AUC enters as a scalar subquery, no join needed
    return ece(d, conf, correct, bins).withColumn("auc_roc", auc_roc(d, conf, correct).select("auc_roc").scalar())


# ------------------------------------------------------------------------------------ correlation


def rank_cells(df: DataFrame, by: Sequence[str], x: str, y: Column) -> DataFrame:
    """Counts per (group, x, y) — the only input the rank statistics need. Checkpointed once so
    the size checks and running sums below read it instead of recomputing the upstream plan."""
    checkpoint_dir(df.sparkSession)
    return df.groupBy(*by, F.col(x).alias("_x"), y.alias("_y")).agg(F.count(F.lit(1)).alias("_c")).checkpoint(eager=True)


def _rank_stats(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per (group, x, y) counts with tie-averaged ranks of x and of y inside the group."""
    by = list(by)
    xs = cells.groupBy(*by, "_x").agg(F.sum("_c").alias("_cx"))
    xs = running(xs, by, ["_x"], {"_cum_x": ("sum", "_cx")})
    xs = xs.withColumn("_rx", F.col("_cum_x") - F.col("_cx") + (F.col("_cx") + 1) / 2.0)
    ys = cells.groupBy(*by, "_y").agg(F.sum("_c").alias("_cy"))
    ys = running(ys, by, ["_y"], {"_cum_y": ("sum", "_cy")})
    ys = ys.withColumn("_ry", F.col("_cum_y") - F.col("_cy") + (F.col("_cy") + 1) / 2.0)
    return cells.join(xs, [*by, "_x"]).join(ys, [*by, "_y"])


def _spearman_from_cells(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    r = _rank_stats(cells, by)
    c = F.col("_c")
    g = r.groupBy(*by).agg(
        F.sum(c).alias("n"), F.sum(c * F.col("_rx")).alias("sx"), F.sum(c * F.col("_ry")).alias("sy"),
        F.sum(c * F.col("_rx") * F.col("_rx")).alias("sxx"), F.sum(c * F.col("_ry") * F.col("_ry")).alias("syy"),
        F.sum(c * F.col("_rx") * F.col("_ry")).alias("sxy"),
    )
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    eps = 1e-9
    rho = F.when((vx <= eps) | (vy <= eps), F.lit(None).cast("double")).otherwise(cov / F.sqrt(vx * vy))
    return g.select(*by, rho.alias("spearman"))


def spearman(df: DataFrame, by: Sequence[str], x: str, y: Column) -> DataFrame:
    """Spearman rho per group (Pearson of tie-averaged ranks); NULL for a constant group."""
    return _spearman_from_cells(rank_cells(df, by, x, y), by)


def _kendall_from_cells(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    by = list(by)
    yy = F.col("_y").cast("double") > 0
    per = cells.groupBy(*by, "_x").agg(F.sum(F.when(yy, F.col("_c")).otherwise(0)).alias("_pos"),
                                       F.sum(F.when(~yy, F.col("_c")).otherwise(0)).alias("_neg"))
    rs = running(per, by, ["_x"], {"_neg_le": ("sum", "_neg")})
    g = rs.groupBy(*by).agg(
        F.sum("_pos").alias("P"), F.sum("_neg").alias("N"),
        F.sum(F.col("_pos") * (F.col("_neg_le") - F.col("_neg"))).alias("below"),
        F.sum(F.col("_pos") * F.col("_neg_le")).alias("le"),
        F.sum((F.col("_pos") + F.col("_neg")) * (F.col("_pos") + F.col("_neg") - 1) / 2).alias("n1"),
    )
    n = F.col("P") + F.col("N")
    n0 = n * (n - 1) / 2
    n2 = F.col("P") * (F.col("P") - 1) / 2 + F.col("N") * (F.col("N") - 1) / 2
    above = F.col("P") * F.col("N") - F.col("le")
    den = (n0 - F.col("n1")) * (n0 - n2)
    tau = F.when(den <= 0, F.lit(None).cast("double")).otherwise((F.col("below") - above) / F.sqrt(den))
    return g.select(*by, tau.alias("kendall"))


def kendall_binary(df: DataFrame, by: Sequence[str], x: str, y: Column) -> DataFrame:
    """Kendall tau-b per group for a binary ``y`` (correct / not) — from counts, no pairs.

    nc - nd = sum over positives of (negatives with smaller x - negatives with larger x);
    tau_b = (nc - nd) / sqrt((n0 - n1)(n0 - n2)) with tie corrections n1 (x) and n2 (y).
    """
    return _kendall_from_cells(rank_cells(df, by, x, y), by)


def correlation_report(df: DataFrame, by: Sequence[str], x: str, y: Column) -> DataFrame:
    """Mean Spearman and Kendall over groups; constant groups are skipped and counted.
    Both statistics come from one checkpointed count table."""
    cells = rank_cells(df, by, x, y)
    s = _spearman_from_cells(cells, by)
    k = _kendall_from_cells(cells, by)
    j = s.join(k, list(by), "full")
    return j.agg(
        F.avg("spearman").alias("spearman"), F.avg("kendall").alias("kendall"),
        F.count("spearman").alias("n_groups_used"), F.count(F.lit(1)).alias("num_samples"),
    )


def funnel(df: DataFrame, reason: str = "reject_reason", problem: str = "problem_id") -> DataFrame:
    """Rows per reject reason (NULL = kept) and distinct problems among kept rows."""
    return df.groupBy(F.coalesce(F.col(reason), F.lit("kept")).alias("stage")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(problem).alias("problems"))


def class_counts(df: DataFrame, label: str = "is_correct") -> DataFrame:
    """Rows per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def best_so_far(df: DataFrame, order: Sequence[str], value: str) -> DataFrame:
    """Running best over checkpoints, skew-safe (range slices + carried maxima)."""
    return running(df, [], list(order), {"best_so_far": ("max", value)})


def best_checkpoint(df: DataFrame, step: str, value: str) -> DataFrame:
    """The checkpoint with the highest value; the earliest wins a tie (strict improvement)."""
    return df.agg(F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(F.col(value), -F.col(step))).alias("b")).select("b.*")
