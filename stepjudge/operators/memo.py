"""Results that last over runs: a table of value → result per function version.

``map_distinct`` computes once per distinct value of one table; here a value computed in any earlier run isn't
computed again. The table is a folder of published parts (``sources.publication``), each holding the values that
one run was the first to need, by digest. A run takes its distinct values, drops those that some part knows
(an anti join by digest), computes the rest and publishes them as the next part; if another run published that part
first, it looks again, so no value is held twice. A run that finds everything known computes and writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepjudge.session import checkpoint_dir, shuffle_partitions
from stepjudge.sources.publication import publish, published, read_published


# short types whose values are equal just when their texts are
_EXACT = (T.IntegralType, T.BooleanType, T.DateType, T.DecimalType)


def _digest(value: Column) -> Column:
    return F.md5(value.cast("string"))


def remembered(spark: SparkSession, path: str, version: str) -> tuple[DataFrame | None, int]:
    """(the table (digest, result), or None if nothing is known yet; the number of its parts)."""
    table, n = None, 0
    while published(spark, path, f"{version}-{n}"):
        part = read_published(spark, path, f"{version}-{n}")
        table, n = part if table is None else table.unionByName(part), n + 1
    return table, n


def map_remembered(df: DataFrame, col: str, fn: Callable[[Column], Column], name: str, path: str, version: str) -> DataFrame:
    """C6 with a memory: ``fn`` of every value of ``col``, as column ``name``; NULL for NULL.

    ``version`` names the function (its code and options): another version has a table of its own. Values are told apart
    once, before they get digests, and written; results meet their rows by a value that is short, else by digest."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    kind = df.schema[col].dataType
    exact, given = isinstance(kind, _EXACT), df.where(F.col(col).isNotNull()).select(F.col(col).alias("_value"))
    if exact or kind == T.StringType():
        values = given.distinct().select(_digest(F.col("_value")).alias("_digest"), "_value")
    else:
        values = given.groupBy(_digest(F.col("_value")).alias("_digest")).agg(F.any_value("_value").alias("_value"))
    values = values.checkpoint(eager=True)
    while True:
        known, n = remembered(spark, path, version)
        unseen = values if known is None else values.join(known.select("_digest"), "_digest", "left_anti")
        if unseen.isEmpty():
            break
        # the parts lie by digest, so that later joins meet sorted runs of it
        part = unseen.select("_digest", fn(F.col("_value")).alias("_result")).repartition(shuffle_partitions(spark), "_digest").sortWithinPartitions("_digest")
        publish(part, path, f"{version}-{n}")  # lost to another run: look at what it knows, and go on
    if known is None:
        return df.withColumn(name, fn(F.col(col)))  # no value at all: the column's type alone matters
    known = known.withColumnRenamed("_result", name)
    if exact:
        known = values.join(known, "_digest").select("_value", name)
        return df.join(known, F.col(col) == F.col("_value"), "left").drop("_value")
    return df.withColumn("_digest", _digest(F.col(col))).join(known, "_digest", "left").drop("_digest")
