"""Row-level operators: identity, projection guards, long/wide adapters, sampling, set operations,
look-up joins.

Randomness is keyed hashing (md5 of the seed and the key): the same rows are drawn on every run, on
any number of partitions, and after a lost executor recomputes a partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepjudge.operators.ranking import number_within, top_k_within
from stepjudge.operators.selection import EXACT, before, first_n, last_of_first_n
from stepjudge.session import checkpoint_dir


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hash_int(seed: int, *keys: str | Column) -> Column:
    """A reproducible 52-bit integer per row from the seed and the key columns: the first 13 hex
    digits of ``md5("seed|key1|key2…")``. Any engine with md5 draws the same rows (so the draws can
    be checked in SQL), on any number of partitions and after any recomputation."""
    text = F.concat_ws("|", F.lit(str(int(seed))), *[_c(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def hash_unit(seed: int, *keys: str | Column) -> Column:
    """A reproducible pseudo-random number in [0, 1) per row (``hash_int`` / 2^52)."""
    return hash_int(seed, *keys).cast("double") / float(1 << 52)


# ------------------------------------------------------------------------------- B: projections


def ensure_solution(df: DataFrame, answer: str = "answer", solution: str = "solution") -> DataFrame:
    """B1: add ``solution = \\boxed{answer}`` when the table has no solution column."""
    if solution in df.columns or answer not in df.columns:
        return df
    return df.withColumn(solution, F.concat(F.lit("\\boxed{"), F.col(answer), F.lit("}")))


def ensure_idx(df: DataFrame, order_by: Sequence[str | Column], idx: str = "idx") -> DataFrame:
    """B2: add a 0-based row number when absent, in a total ``order_by`` — range slices plus carried
    offsets, never a single-partition window."""
    if idx in df.columns:
        return df
    return number_within(df, [], order_by, idx, base=0)


def lower_columns(df: DataFrame) -> DataFrame:
    """Lower-case all column names; two names that collide are an error."""
    low = [c.lower() for c in df.columns]
    if len(set(low)) != len(low):
        raise ValueError(f"column names collide when lower-cased: {df.columns}")
    return df.toDF(*low)


def keep_types(df: DataFrame, col: str, values: Iterable[str]) -> DataFrame:
    """Keep rows whose ``col`` is in a fixed list (an IN-list filter, pushed to the scan)."""
    return df.filter(F.col(col).isin(list(values)))


def drop_multi_answer(df: DataFrame, col: str = "answer") -> DataFrame:
    """Drop rows whose answer holds several answers (a ``;``)."""
    return df.filter(~F.col(col).contains(";"))


def select_existing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keep the listed columns that exist, in the listed order."""
    return df.select(*[c for c in names if c in df.columns])


def drop_empty(df: DataFrame, col: str) -> DataFrame:
    """Drop rows with an empty string / empty array / NULL in ``col``."""
    t = dict(df.dtypes)[col]
    if t.startswith("array"):
        return df.filter(F.size(col) > 0)
    return df.filter(F.length(F.col(col)) > 0)


def replicate(df: DataFrame, n: int, col: str = "sample_idx") -> DataFrame:
    """Repeat every row ``n`` times, numbered 0..n-1."""
    return df.withColumn(col, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(int(n) - 1).cast("bigint"))))


# ------------------------------------------------------------------------------- B7: assertions

RULES = ("required_columns", "unique", "exact_n", "at_least_n", "same_length", "non_empty")


def check(df: DataFrame, rule: str, cols: Sequence[str] = (), by: Sequence[str] = ("problem_id",), n: int | None = None) -> DataFrame:
    """Rows (or groups) that violate a rule; an empty result means the rule holds."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}; expected one of {RULES}")
    if rule == "required_columns":
        missing = [c for c in cols if c not in df.columns]
        return df.sparkSession.createDataFrame([(m,) for m in missing], "missing string")
    if rule == "unique":
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if rule in ("exact_n", "at_least_n"):
        g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        return g.filter(F.col("n") != n) if rule == "exact_n" else g.filter(F.col("n") < n)
    if rule == "same_length":
        a, b = cols
        size = lambda c: F.coalesce(F.size(c), F.lit(-1))  # noqa: E731  a missing list has no length, so it equals no list
        return df.filter(F.col(a).isNull() | F.col(b).isNull() | (size(a) != size(b)))
    (a,) = cols
    empty = F.size(a) == 0 if dict(df.dtypes)[a].startswith("array") else F.length(a) == 0
    return df.filter(F.col(a).isNull() | empty)


def require(df: DataFrame, rule: str, **kw) -> DataFrame:
    """Raise when ``check`` finds a violation; otherwise return ``df`` unchanged."""
    bad = check(df, rule, **kw)
    if bad.limit(1).count() > 0:
        raise ValueError(f"data check {rule!r} failed: {bad.limit(5).collect()}")
    return df


# ------------------------------------------------------------------------------- B11: long / wide


def to_long(df: DataFrame, by: Sequence[str], arrays: Sequence[str], idx: str = "idx") -> DataFrame:
    """One row per list element (same position across parallel list columns), 0-based ``idx``."""
    z = F.arrays_zip(*[F.col(a) for a in arrays])
    others = [c for c in df.columns if c not in arrays]
    ex = df.select(*others, F.posexplode_outer(z).alias(idx, "_z"))
    return ex.select(*others, F.col(idx).cast("bigint").alias(idx), *[F.col(f"_z.{a}").alias(a) for a in arrays])


def to_wide(df: DataFrame, by: Sequence[str], values: Sequence[str], idx: str = "idx") -> DataFrame:
    """Regroup long rows into list columns in ``idx`` order (sinks only: it builds one row per
    group, so it is used where the reference's output format is one row per problem)."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(idx).alias("_i"), *[F.col(v) for v in values])))
    g = df.groupBy(*by).agg(packed.alias("_p"))
    return g.select(*by, *[F.transform("_p", _field(v)).alias(v) for v in values])


def _field(name: str):
    return lambda x: x[name]


# ------------------------------------------------------------------------------- L: sort, sample


def slice_rows(df: DataFrame, start: int, end: int | None, order_by: Sequence[str | Column], idx: str = "idx") -> DataFrame:
    """L1: rows [start, end) in ``order_by`` (B2 numbering, then a filter)."""
    d = ensure_idx(df, order_by, idx)
    cond = F.col(idx) >= start
    if end is not None:
        cond = cond & (F.col(idx) < end)
    return d.filter(cond)


def head_n(df: DataFrame, n: int, order_by: Sequence[str | Column], exact: int = EXACT) -> DataFrame:
    """L2: first n rows (all, when the table is smaller), as a set: a bounded top-n while n is small, and
    beyond ``exact`` rows a filter up to the n-th key (``selection.first_n``)."""
    return first_n(df, n, order_by, exact)


def sample_n(df: DataFrame, n: int, seed: int, key: Sequence[str], exact: int = EXACT, written: bool = False) -> DataFrame:
    """L3: seeded shuffle, then the first n — the first n in the order of a keyed hash (``selection.first_n``)."""
    return first_n(df.withColumn("_u", hash_unit(seed, *key)), n, ["_u", *key], exact, written).drop("_u")


def sample_fraction(df: DataFrame, p: float, seed: int, key: Sequence[str]) -> DataFrame:
    """Bernoulli sample with probability p, decided per row by a keyed hash."""
    return df.filter(hash_unit(seed, *key) < F.lit(float(p)))


def random_cut(steps_n: str | Column, seed: int, key: Sequence[str]) -> Column:
    """A cut point in [1, n-1] per row (NULL when n < 2)."""
    n = _c(steps_n)
    return F.when(n >= 2, 1 + F.pmod(hash_int(seed, *key), n - 1))


def balance(df: DataFrame, label: str, seed: int, key: Sequence[str]) -> DataFrame:
    """L4: keep all rows of the minority class and an equal-size keyed-random sample of the majority.

    Only the labels and keys are checkpointed, to count the classes (one aggregate, one row per class) and to
    find the last hash that stays (``selection.last_of_first_n``: passes over counts); rows are then cut by a filter,
    so texts are neither written nor numbered. Of rows with one key at the cut, as many as are wanted stay.
    Rows without a label are cut like a majority."""
    checkpoint_dir(df.sparkSession)
    order = ["_u", *key]
    d = df.withColumn("_u", hash_unit(seed, *key))
    narrow = d.select(F.col(label).alias("_label"), *order).checkpoint(eager=True)
    counts = {r[0]: r[1] for r in narrow.groupBy("_label").agg(F.count(F.lit(1))).collect()}
    n_true, n_false = counts.get(True, 0), counts.get(False, 0)
    target = min(n_true, n_false)
    major = n_true > n_false
    kept = d.filter(F.col(label) != F.lit(major))
    for cut in (c for c in (major, None) if c in counts and target > 0):
        of = F.col(label).eqNullSafe(F.lit(cut).cast("boolean"))
        part = d.filter(of)
        if counts[cut] > target:
            mine = narrow.filter(F.col("_label").eqNullSafe(F.lit(cut).cast("boolean")))
            last, ties = last_of_first_n(mine, target, order)
            equal = before(mine, order, last, equal=True)
            if mine.filter(equal).count() > ties:
                part = part.filter(before(mine, order, last)).unionByName(part.filter(equal).limit(ties))
            else:
                part = part.filter(before(mine, order, last) | equal)
        kept = kept.unionByName(part)
    return kept.drop("_u")


def top_distinct(df: DataFrame, col: str, k: int, digits: int) -> DataFrame:
    """The k largest distinct rounded values."""
    return df.select(F.round(F.col(col), digits).alias(col)).distinct().orderBy(F.col(col).desc()).limit(int(k))


def weighted_choice(df: DataFrame, by: Sequence[str], value: str, weight: str | Column, seed: int, key: Sequence[str]) -> DataFrame:
    """One row per group drawn with probability proportional to ``weight`` (exponential race:
    the largest log(u)/w wins — an aggregate, so a hot group is combined map-side)."""
    u = F.greatest(hash_unit(seed, *key), F.lit(1e-300))
    race = F.log(u) / _c(weight)
    return df.groupBy(*by).agg(F.max_by(F.col(value), race).alias(value))


def rank_rejected(df: DataFrame, by: Sequence[str], diff: str, order: str, name: str = "rank") -> DataFrame:
    """Rejected rows by number of wrong verdicts, most first, stable on ``order``."""
    return number_within(df, by, [F.col(diff).desc(), F.col(order)], name)


def prune_top(df: DataFrame, by: Sequence[str], score: str, order: str, k: int) -> DataFrame:
    """The top k per group by score, later row first on equal scores
    (a stable ascending sort keeps the later row at the top)."""
    return top_k_within(df, by, [F.col(score).desc(), F.col(order).desc()], k, "rank", salt_cols=list(by) + [order])


# ------------------------------------------------------------------------------- W9 / W11


def avg_rank(df: DataFrame, by: Sequence[str], value: str, order: str, name: str = "avg_rank") -> DataFrame:
    """1-based rank with ties averaged: first position of the tie group + (size - 1) / 2.
    Numbering is skew-safe; tie groups are an aggregate joined back."""
    n = number_within(df, by, [F.col(value), F.col(order)], "_rn")
    ties = n.groupBy(*by, value).agg(F.min("_rn").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    out = n.join(ties, [*by, value])
    return out.withColumn(name, F.col("_first") + (F.col("_cnt") - 1) / 2.0).drop("_rn", "_first", "_cnt")


def batch_id(df: DataFrame, order_by: Sequence[str | Column], size: int, name: str = "batch_id") -> DataFrame:
    """Consecutive batches of ``size`` rows in a total order (global numbering, skew-safe)."""
    n = number_within(df, [], order_by, "_rn", base=0)
    return n.withColumn(name, F.floor(F.col("_rn") / F.lit(int(size))).cast("bigint")).drop("_rn")


# ------------------------------------------------------------------------------- S: set operations


def union_tagged(parts: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    """UNION ALL by name, missing columns NULL, each part tagged."""
    tagged = [d.withColumn(tag, F.lit(t)) for t, d in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def distinct_generations(df: DataFrame, by: Sequence[str], text: str, order: str) -> DataFrame:
    """S3: one row per distinct text of an example, the first occurrence kept (an aggregate)."""
    return df.groupBy(*by, text).agg(F.min(order).alias(order))


def same_multiset(a: str | Column, b: str | Column) -> Column:
    """Two lists hold the same values with the same multiplicities."""
    return F.array_sort(_c(a)) == F.array_sort(_c(b))


# ------------------------------------------------------------------------------- C: look-up joins


def attach_candidates(problems: DataFrame, cached: DataFrame, on: Sequence[str] = ("problem_id",)) -> DataFrame:
    """Left join; problems without cached candidates keep NULLs. AQE picks the strategy
    from measured sizes (broadcast only below its threshold)."""
    return problems.join(cached, list(on), "left")


#: Words of 64 bits that a filter of done keys may have: 4 million are 64 MB as a broadcast table, whatever the table's size.
FILTER_WORDS = 1 << 22


def _hashed(df: DataFrame, on: Sequence[str], words: int) -> DataFrame:
    """With ``_word``, the word of a filter that a key belongs to, and ``_bits``, the four bits (some may be equal) it sets there."""
    keys = [F.col(c) for c in on]
    bits = " | ".join(f"shiftleft(1L, CAST(shiftright(_g, {6 * i}) & 63 AS INT))" for i in range(4))
    out = df.withColumn("_word", F.pmod(F.xxhash64(*keys), F.lit(words))).withColumn("_g", F.xxhash64(F.lit(77), *keys))
    return out.withColumn("_bits", F.expr(bits)).drop("_g")


def remaining(examples: DataFrame, done: DataFrame, on: Sequence[str] = ("idx",),
              order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Examples not yet processed and the processed rows de-duplicated by key, the last row (largest
    ``order``) winning. A filter of the done keys passes what is surely new; only the rest, the done ones and
    about one new row in a hundred, meets the keys in an anti join. A key with a NULL is never done."""
    on = list(on)
    keys = done.select(*on)
    n = keys.agg(F.approx_count_distinct(F.struct(*on))).first()[0]
    words = min(FILTER_WORDS, max(1024, 1 << (max(n, 1) // 5).bit_length()))
    # a Bloom filter, a word per key, as a small table; what it doesn't know is surely new and isn't shuffled
    known = _hashed(keys, on, words).groupBy("_word").agg(F.bit_or("_bits").alias("_known"))
    probed = _hashed(examples, on, words).join(F.broadcast(known), "_word", "left")
    maybe = F.coalesce(F.col("_known").bitwiseAND(F.col("_bits")) == F.col("_bits"), F.lit(False))
    cols = examples.columns
    todo = probed.filter(~maybe).select(*cols).unionByName(probed.filter(maybe).select(*cols).join(keys.distinct(), on, "left_anti"))
    if order is None:
        return todo, done
    last = done.groupBy(*on).agg(F.max_by(F.struct(*[F.col(c) for c in done.columns]), F.col(order)).alias("_l")).select("_l.*")
    return todo, last


def pair_by_rank(chosen: DataFrame, rejected: DataFrame, by: Sequence[str], k: int, rank: str = "rank") -> DataFrame:
    """C4: pair the i-th chosen with the i-th rejected row of a group, i <= k."""
    c = chosen.filter(F.col(rank) <= k)
    r = rejected.filter(F.col(rank) <= k)
    return c.join(r, [*by, rank])


def map_distinct(df: DataFrame, col: str, fn, name: str) -> DataFrame:
    """Evaluate an expensive function once per distinct value and join the result back.

    ``fn`` maps a Column to a Column (it may be a pandas UDF). The distinct values are a shuffle-
    aggregated table; the join back is an equi-join AQE can broadcast when it is small.
    """
    d = df.select(col).distinct().withColumn(name, fn(F.col(col)))
    return df.join(d, col, "left")
