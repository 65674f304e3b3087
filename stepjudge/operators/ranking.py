"""Skew-safe numbering, running aggregates and top-k within groups.

A plain ``row_number() OVER (PARTITION BY g ORDER BY o)`` sends every row of a group to one task.
If one group holds a third of the table, that task holds a third of the table. Whole tables (no
group) are always split; groups are measured first (one partial aggregation), and those beyond a
bound are split while the rest stay on the plain window:

1. range-partition on ``(g, o)`` with an explicit partition count, so a hot group is cut into many
   contiguous, ordered slices, and checkpoint the sliced table (range bounds are sampled per
   exchange, so two consumers of an unmaterialised range shuffle could disagree on slice ids);
2. compute the running value inside each slice, partitioned by ``(slice, g)``;
3. carry the totals of earlier slices forward. Only the first group of a slice can continue
   from an earlier slice, so the carry table has at most one row per slice — the number of shuffle
   partitions, not of rows: a proven bound, hence a safe broadcast.

Everything is DataFrame code; no rows pass through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepjudge.session import checkpoint_dir, shuffle_partitions

_P = "_sj_slice"


def _cols(xs: Sequence[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


# A group with more rows than this is "hot": it is cut into range slices instead of being
# numbered by one window task. Smaller groups stay on the plain window (bounded per task).
HOT_GROUP_ROWS = 2_000_000

# buckets per group for the two-level top-k
TOP_K_SALTS = 1024

# Narrow rows are dealt to tasks of this many, ...
TASK_ROWS = 250_000
# ... but to no more than this many tasks: up to there (``spark.shuffle.sort.bypassMergeThreshold``) a shuffle's rows go
# straight to files; beyond, a task that reads a large split holds all rows it sends.
MOST_TASKS = 200

_OPS = {"count": F.count, "sum": F.sum, "max": F.max, "min": F.min}


def tasks_for(rows: int) -> int:
    """How many tasks share so many narrow rows."""
    return min(MOST_TASKS, max(1, -(-rows // TASK_ROWS)))


def _window_running(df: DataFrame, keys: Sequence[str], order_cols: list[Column],
                    aggs: dict[str, tuple[str, str | Column | None]], partitions: int | None = None) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.repartition(partitions, *keys) if partitions else df
    for name, (op, col) in aggs.items():
        c = F.lit(1) if op == "count" else (F.col(col) if isinstance(col, str) else col)
        out = out.withColumn(name, _OPS[op](c).over(w))
    return out


def _sliced_running(df: DataFrame, keys: Sequence[str], order_cols: list[Column],
                    aggs: dict[str, tuple[str, str | Column | None]], n: int) -> DataFrame:
    # The slice id must be the same for every consumer below. Range bounds are sampled per
    # exchange (and depend on the columns it carries), so the sliced table is materialised once
    # in the shared checkpoint folder: one set of bounds, and a lineage cut that survives a lost
    # executor.
    checkpoint_dir(df.sparkSession)
    sliced = (
        df.repartitionByRange(n, *[F.col(k) for k in keys], *order_cols)
        .withColumn(_P, F.spark_partition_id())
        .checkpoint(eager=True)
    )
    w_local = (
        Window.partitionBy(_P, *keys).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = sliced
    tot_exprs = []
    for name, (op, col) in aggs.items():
        c = F.lit(1) if op == "count" else (F.col(col) if isinstance(col, str) else col)
        local = local.withColumn(f"_sj_l_{name}", _OPS[op](c).over(w_local))
        tot_exprs.append(_OPS[op](c).alias(f"_sj_t_{name}"))
    totals = local.groupBy(_P, *keys).agg(*tot_exprs, F.count(F.lit(1)).alias("_sj_rows"))
    w_prev = Window.partitionBy(*keys).orderBy(_P).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals
    for name, (op, _) in aggs.items():
        fn = {"count": F.sum, "sum": F.sum, "max": F.max, "min": F.min}[op]
        carry = carry.withColumn(f"_sj_c_{name}", fn(f"_sj_t_{name}").over(w_prev))
    carry = carry.withColumn("_sj_prev", F.sum("_sj_rows").over(w_prev))
    # at most one continuing group per slice -> at most `n` rows
    carry = carry.filter(F.col("_sj_prev") > 0).select(_P, *keys, *[f"_sj_c_{a}" for a in aggs])
    c = F.broadcast(carry).alias("_sj_carry")
    joined = local.alias("_sj_local").join(
        c,
        (F.col(f"_sj_local.{_P}") == F.col(f"_sj_carry.{_P}"))
        & reduce(
            lambda a, b: a & b,
            [F.col(f"_sj_local.{k}").eqNullSafe(F.col(f"_sj_carry.{k}")) for k in keys],
            F.lit(True),
        ),
        "left",
    )
    out = joined.select("_sj_local.*", *[F.col(f"_sj_carry._sj_c_{a}") for a in aggs])
    for name, (op, _) in aggs.items():
        lv, cv = F.col(f"_sj_l_{name}"), F.col(f"_sj_c_{name}")
        if op in ("count", "sum"):
            val = lv + F.coalesce(cv, F.lit(0))
        elif op == "max":
            val = F.greatest(lv, cv)
        else:
            val = F.least(lv, cv)
        out = out.withColumn(name, val)
    drop = [_P] + [f"_sj_l_{a}" for a in aggs] + [f"_sj_c_{a}" for a in aggs]
    return out.drop(*drop)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    aggs: dict[str, tuple[str, str | Column | None]],
    slices: int | None = None,
    hot_rows: int | None = None,
    by_rows: bool = False,
) -> DataFrame:
    """Add inclusive running aggregates per group in ``order`` (a total order is expected).

    ``aggs`` maps an output name to ``(op, column)`` with op in ``count``, ``sum``, ``max``, ``min``.
    Without keys the table is always cut into range slices with carried totals. With keys one aggregate
    job measures the groups first: groups of at most ``hot_rows`` rows use the plain window, larger
    ("hot") ones, a group of null keys included, are cut into slices. The two parts are disjoint and
    are unioned. ``by_rows`` shares the plain window among ``tasks_for`` its rows: adaptive execution merges tasks by
    compressed bytes, and narrow rows take many times as much once sorted.
    """
    keys = list(keys)
    order_cols = _cols(order)
    n = slices or shuffle_partitions(df.sparkSession)
    limit = HOT_GROUP_ROWS if hot_rows is None else hot_rows
    if not keys:
        return _sliced_running(df, keys, order_cols, aggs, n)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_sj_n"))
    r = sizes.agg(F.max("_sj_n"), F.sum(F.when(F.col("_sj_n") > limit, F.col("_sj_n")).otherwise(0)), F.sum("_sj_n")).first()
    biggest, hot_rows = int(r[0] or 0), int(r[1] or 0)
    partitions = tasks_for(int(r[2] or 0) - hot_rows) if by_rows else None
    if biggest <= limit:
        return _window_running(df, keys, order_cols, aggs, partitions)
    hot = sizes.filter(F.col("_sj_n") > limit).select(*[F.col(k).alias(f"_sj_h_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_sj_h_{k}")) for k in keys])
    cold = df.join(hot, same, "left_anti")
    warm = df.join(hot, same, "left_semi")
    # enough slices that each holds about `limit` rows of the hot groups
    slices_needed = max(n, -(-hot_rows // limit))
    return _window_running(cold, keys, order_cols, aggs, partitions).unionByName(
        _sliced_running(warm, keys, order_cols, aggs, slices_needed))


def number_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "rn", base: int = 1,
    hot_rows: int | None = None, by_rows: bool = False,
) -> DataFrame:
    """Row number per group (``base``-based) in a total ``order``; skew-safe (see ``running``).

    ``keys=[]`` numbers the whole table, never with a single-partition window.
    """
    out = running(df, keys, order, {name: ("count", None)}, hot_rows=hot_rows, by_rows=by_rows)
    if base != 1:
        out = out.withColumn(name, F.col(name) + F.lit(base - 1))
    return out.withColumn(name, F.col(name).cast("bigint"))


def top_k_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, name: str = "rank",
    salt_cols: Sequence[str] | None = None, salts: int | None = None,
) -> DataFrame:
    """Keep the first ``k`` rows of every group in ``order`` and number them 1..k.

    A rank filter over a window: Spark then keeps ``k`` rows per group in every task before the shuffle
    (``WindowGroupLimit``), so a hot group sends ``k`` rows per input partition however large it is. Spark
    does so up to ``spark.sql.optimizer.windowGroupLimitThreshold``; a larger ``k`` takes two levels, the
    top ``k`` inside ``(group, salt)`` buckets (at least ``TOP_K_SALTS`` of them), then the exact top ``k``
    over the survivors.
    """
    keys = list(keys)
    order_cols = _cols(order)
    spark = df.sparkSession
    w2 = Window.partitionBy(*keys).orderBy(*order_cols)
    if salts is None and k <= int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        out = df.withColumn(name, F.row_number().over(w2)).filter(F.col(name) <= k)
        return out.withColumn(name, F.col(name).cast("bigint"))
    s = salts or max(shuffle_partitions(spark), TOP_K_SALTS)
    salt_src = [F.col(c) for c in (salt_cols or df.columns)]
    salted = df.withColumn("_sj_salt", F.pmod(F.xxhash64(*salt_src), F.lit(s)))
    w1 = Window.partitionBy(*keys, "_sj_salt").orderBy(*order_cols)
    pre = salted.withColumn("_sj_r1", F.row_number().over(w1)).filter(F.col("_sj_r1") <= k)
    return (
        pre.withColumn(name, F.row_number().over(w2).cast("bigint"))
        .filter(F.col(name) <= k)
        .drop("_sj_salt", "_sj_r1")
    )


def with_group_agg(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Attach per-group aggregates to every row: partial aggregation, then an equi-join
    (AQE splits a skewed join partition; the aggregated side has one row per group)."""
    g = df.groupBy(*keys).agg(*aggs)
    return df.join(g, list(keys), "left")
