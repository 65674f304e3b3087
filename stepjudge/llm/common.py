"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepjudge.session import checkpoint_dir

#: White space that separates words in every operator here.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: Texts of one Arrow batch are handled in slices of about this many characters.
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: written to the shared folder of ``spark.checkpoint.dir``.

    Spark removes the shuffle files of a lineage when the driver collects what stood for it, which a
    driver with little to do may not do for hours; so it is asked to here.
    """
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def free(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of tables that nothing holds any more.

    What Python let go reaches the JVM a moment later, and what the first collection frees can hold more.
    """
    for _ in range(2):
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of this subpackage's own once nothing reads it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def with_struct(df: DataFrame, fields: Sequence[str], value: Column, keep: Sequence[str]) -> DataFrame:
    """``keep`` and the fields of a struct column, which is evaluated once per row. Fields replace columns of their name."""
    tmp = free_name(df, "_out")
    keep = [c for c in keep if c.lower() not in {f.lower() for f in fields}]
    return df.withColumn(tmp, value).select(*keep, *[F.col(f"{tmp}.{f}").alias(f) for f in fields])


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n (null for a null key)."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n))


def held_out(key: str, n: int, rest: int) -> Column:
    """True where the key's remainder is ``rest``; a null key is never held out and never learned from."""
    return F.coalesce(crc_mod(key, n) == rest, F.lit(False))


def learnable(key: str, n: int, rest: int) -> Column:
    return F.coalesce(crc_mod(key, n) != rest, F.lit(False))


def slices(texts: pd.Series, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of a batch, each of about ``limit`` characters (one text at least)."""
    return slices_of(texts.str.len().fillna(0).to_numpy(dtype="int64"), limit)


def slices_of(size, limit: int) -> Iterator[tuple[int, int]]:
    """The same from the texts' sizes."""
    start, held = 0, 0
    for i, n in enumerate(size):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(size):
        yield start, len(size)
