"""The first n rows of an order, without gathering n rows anywhere.

``orderBy().limit(n)`` brings n rows to one task, which is fine while n is a report's size and not when n
is a third of the table. Here the place of the n-th row is found by refinement: the order columns are
turned into numeric keys, one after the other; each pass counts the rows still in question per bucket of a
key (a partial aggregation with at most ``BUCKETS`` rows of output), keeps the bucket that holds the n-th
row, and notes that everything before it is in. A bucket of one value goes on with the next key. What is
left is at most ``EXACT`` rows, of which an ordinary top-n takes its part. The result is a filter over the
table plus those few rows: nothing is shuffled but counts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepjudge.session import checkpoint_dir

BUCKETS = 2048
EXACT = 10_000  # rows that one task may sort
CHUNK = 7  # bytes of a text compared at a time: they fit a bigint

Key = tuple[Column, bool, bool]  # value, descending, nulls first


def ordering(df: DataFrame, order_by: Sequence[str | Column]) -> list[Key]:
    """The keys of an order: names (ascending), expressions (ascending) or a named column's asc()/desc()."""
    out = []
    for c in order_by:
        if isinstance(c, str):
            out.append((F.col(c), False, True))
            continue
        m = re.fullmatch(r"Column<'(.*) (ASC|DESC) NULLS (FIRST|LAST)'>", repr(c), re.DOTALL)
        if m is None:
            out.append((c, False, True))
        elif m.group(1) in df.columns:
            out.append((F.col(f"`{m.group(1)}`"), m.group(2) == "DESC", m.group(3) == "FIRST"))
        else:
            raise ValueError(f"order by named columns, or plain expressions in ascending order, not {c}")
    return out


def _numeric_keys(rows: DataFrame, key: Key) -> Iterator[Column]:
    """Numbers that order ``rows`` as the key does: first its special values, then the value (texts by chunks)."""
    c, descending, nulls_first = key
    kind = rows.select(c.alias("k")).schema["k"].dataType
    floating = isinstance(kind, (T.FloatType, T.DoubleType))
    special = F.lit(2)
    if floating:
        special = F.when(F.isnan(c), 4).when(c == float("inf"), 3).when(c == float("-inf"), 1).otherwise(2)
    special = -special if descending else special
    yield F.when(c.isNull(), -9 if nulls_first else 9).otherwise(special)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        raw = c.cast("binary")
        longest = rows.agg(F.max(F.octet_length(c))).first()[0] or 0
        for at in range(0, longest, CHUNK):
            number = F.conv(F.rpad(F.hex(F.substring(raw, at + 1, CHUNK)), 2 * CHUNK, "0"), 16, 10).cast("bigint")
            number = F.coalesce(number, F.lit(0).cast("bigint"))
            yield -number if descending else number
        number = F.coalesce(F.octet_length(c), F.lit(0))  # texts that differ in zero bytes at the end alone
        yield -number if descending else number
        return
    if isinstance(kind, T.BooleanType):
        c = c.cast("int")
    elif isinstance(kind, T.DateType):
        c = F.unix_date(c)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.unix_micros(c.cast("timestamp"))
    elif floating:
        c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c).cast("double")
    elif not isinstance(kind, T.NumericType):
        raise ValueError(f"no order by a column of type {kind.simpleString()}")
    c = F.coalesce(c, F.lit(0).cast("int" if not isinstance(kind, T.DecimalType) else kind))
    if not descending:
        yield c
    elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        yield -c
    else:
        yield -1 - c.cast("bigint")  # the least bigint has no negative


def first_n(df: DataFrame, n: int, order_by: Sequence[str | Column], exact: int = EXACT, written: bool = False) -> DataFrame:
    """The first n rows of ``df`` in an order (all, if it has fewer), as a set: sort them where they are shown.

    Rows equal in every order column are told apart by their place in the table. The table is read once
    per pass, about log(rows / ``exact``) / log(``BUCKETS``) + 1 of them a key; ``written`` writes it to the
    checkpoint folder first, for tables that cost more to compute than to write.
    """
    n = int(n)
    if n <= 0:
        return df.limit(0)
    keys = ordering(df, order_by)
    sort = [(c.desc_nulls_first() if nulls else c.desc_nulls_last()) if down else (c.asc_nulls_first() if nulls else c.asc_nulls_last()) for c, down, nulls in keys]
    if n <= exact:
        return df.orderBy(*sort).limit(n)  # Spark keeps n rows per task and n at the end
    if written:
        checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)
    size = df.count()
    if n >= size:
        return df
    sure, border = F.lit(False), F.lit(True)
    found, ends = _refine(df, keys, n, size, exact, sure, border)
    if ends is None:
        return df.where(found)
    border, need, size = ends
    rest = df.where(border)
    if size > exact:  # more equal rows than a task may sort: by their place in the table
        checkpoint_dir(df.sparkSession)
        rest = rest.withColumn("_place", F.monotonically_increasing_id()).checkpoint(eager=True)
        place = [(F.col("_place"), False, True)]
        taken, ends = _refine(rest, place, need, size, exact, F.lit(False), F.lit(True))
        part = rest.where(taken)
        if ends is not None:
            part = part.unionByName(rest.where(ends[0]).orderBy("_place").limit(ends[1]))
        return df.where(found).unionByName(part.drop("_place"))
    return df.where(found).unionByName(rest.orderBy(*sort).limit(need))


def last_of_first_n(df: DataFrame, n: int, order_by: Sequence[str], exact: int = EXACT) -> tuple[Row | None, int]:
    """(the n-th row's values of the ascending order columns, how many rows equal to it are among the first n);
    (None, 0) for a table without rows or n = 0. A row of another table with the same columns is among the first n if
    it comes before, so wide rows need not be written or sorted to be cut (see ``before``)."""
    order = F.struct(*order_by)
    size = df.count()
    n = min(int(n), size)
    if n <= 0:
        return None, 0
    found, ends = F.lit(True), (F.lit(True), n, size)
    if n > exact:
        found, ends = _refine(df, ordering(df, order_by), n, size, exact, F.lit(False), F.lit(True))
    if ends is None:
        last = df.where(found).agg(F.max(order)).first()[0]
    elif ends[2] > exact and n > exact:  # equal in every order column
        last = df.where(ends[0]).select(order).first()[0]
    else:
        last = df.where(ends[0]).orderBy(*order_by).limit(ends[1]).agg(F.max(order)).first()[0]
    return last, n - df.where(before(df, order_by, last)).count()


def before(df: DataFrame, order_by: Sequence[str], row: Row, equal: bool = False) -> Column:
    """Whether a row comes before ``row`` in the ascending order (``equal``: has the same values)."""
    here = F.struct(*order_by)
    there = F.struct(*[F.lit(row[c]).cast(df.schema[c].dataType).alias(c) for c in order_by])
    return here.eqNullSafe(there) if equal else here < there


def _bucket(number: Column, low, high) -> Column:
    """The bucket of a number of [low, high]: monotone whatever the rounding, and low and high lie in different ones."""
    if not isinstance(low, float) and high - low < 2**53:  # exact differences: large numbers of one double stay apart
        base, start, stop = (number - F.lit(low)).cast("double"), 0.0, float(high - low)
    else:
        base, start, stop = number.cast("double"), float(low), float(high)
    half = 0.5 if math.isinf(stop - start) else 1.0
    width = (stop * half - start * half) / BUCKETS
    if width == 0.0:
        width = stop - start
    return F.least(F.floor((base * half - F.lit(start * half)) / F.lit(width)), F.lit(BUCKETS)).cast("int")


def _refine(df: DataFrame, keys: Sequence[Key], need: int, size: int, exact: int, sure: Column, border: Column):
    """(rows surely in, None or (rows in question, how many of them, their number))."""
    for key in keys:
        for number in _numeric_keys(df.where(border), key):
            low, high = df.where(border).agg(F.min(number), F.max(number)).first()
            while low != high:
                bucket = _bucket(number, low, high)
                counts = df.where(border).groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min(number).alias("low"), F.max(number).alias("high"))
                before = 0
                for r in sorted(counts.collect(), key=lambda r: r["b"]):  # one row per bucket
                    if before + r["n"] >= need:
                        break
                    before += r["n"]
                sure = sure | (border & (bucket < r["b"]))
                border = border & (bucket == r["b"])
                need, size, low, high = need - before, r["n"], r["low"], r["high"]
                if need == size:
                    return sure | border, None
                if size <= exact:
                    return sure, (border, need, size)
    return sure, (border, need, size)
