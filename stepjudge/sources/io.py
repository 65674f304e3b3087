"""Sources and sinks (A1–A9): JSON lines, generation directories, benchmarks, cached candidates,
metrics, verification logs, versioned outputs.

Readers take a declared schema and fail on a malformed line (the reference aborts there too).
Writers are ordinary DataFrame writes — partitioned, parallel, no collect.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepjudge.operators.rows import check
from stepjudge.sources.json_arrays import read_json_arrays
from stepjudge.sources.publication import publish, read_published

GENERATIONS_SCHEMA = T.StructType([
    T.StructField("problem", T.StringType()),
    T.StructField("prefix", T.StringType()),
    T.StructField("traj_gt_labels", T.ArrayType(T.StringType())),
    T.StructField("prompt", T.StringType()),
    T.StructField("generations", T.ArrayType(T.StringType())),
])

COMPLETIONS_SCHEMA = T.StructType([
    T.StructField("problem", T.StringType()),
    T.StructField("solution", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("completions", T.ArrayType(T.StringType())),
    T.StructField("completion_tokens", T.ArrayType(T.IntegerType())),
    T.StructField("scores", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("agg_scores", T.ArrayType(T.DoubleType())),
    T.StructField("pred", T.StringType()),
])


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """A1: JSON lines with a declared schema; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_generation_dirs(spark: SparkSession, dirs: Sequence[str], name_like: str = "*all_outputs*",
                         schema: T.StructType = GENERATIONS_SCHEMA) -> DataFrame:
    """A2: every JSON-array file whose name matches ``name_like`` in the given directories, concatenated.
    A file is read by as many tasks as it has splits (``json_arrays``); a malformed file fails the read."""
    return read_json_arrays(spark, list(dirs), schema, name_like)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_benchmark(spark: SparkSession, name: str, split: str, root: str, fmt: str | None = None) -> DataFrame:
    """A3: a benchmark split from ``root/name/split.{parquet,jsonl}`` (parquet preferred)."""
    base = f"{root.rstrip('/')}/{name}/{split}"
    if fmt == "parquet" or (fmt is None and _exists(spark, f"{base}.parquet")):
        return spark.read.parquet(f"{base}.parquet")
    return spark.read.option("mode", "FAILFAST").json(f"{base}.jsonl")


def read_cached_candidates(spark: SparkSession, path: str, n: int, schema: T.StructType = COMPLETIONS_SCHEMA) -> DataFrame:
    """A4: cached completions; every problem must have at least n, the first n are kept. A problem without a
    list has none; where token counts are listed there must be as many as completions."""
    df = read_jsonl(spark, path, schema)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    short = df.filter((size("completions") < n) | (F.col("completion_tokens").isNotNull() & (F.least(size("completions"), F.lit(n)) != F.least(size("completion_tokens"), F.lit(n)))))
    if short.limit(1).count() > 0:
        raise ValueError(f"some problems have fewer than {n} cached completions, or token counts that don't fit them")
    keep = ["completions", "completion_tokens", "scores", "agg_scores"]
    for c in keep:
        df = df.withColumn(c, F.slice(c, 1, n))
    return df


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A5: JSON lines (one part file per task), UTF-8, non-ASCII kept as is."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


#: Rows that a wide record of metrics may hold: one per n of a sweep.
METRIC_ROWS = 10_000


def write_metrics(df: DataFrame, path: str, by: str = "n", mode: str = "overwrite") -> None:
    """A metrics table written wide by ``by`` — one record holding one list per metric. The record is for a table
    with one row per n; a table that repeats an n, or of more than ``METRIC_ROWS`` rows, is refused before anything is gathered."""
    metrics = [c for c in df.columns if c != by]
    # counted per n first, and no further than the first row too many
    some = df.groupBy(by).agg(F.count(F.lit(1)).alias("rows")).limit(METRIC_ROWS + 1).agg(F.count(F.lit(1)).alias("n"), F.max("rows").alias("rows")).first()
    if some["n"] > METRIC_ROWS or (some["rows"] or 0) > 1:
        raise ValueError(f"a metrics record needs one row per {by}, {METRIC_ROWS} at most; aggregate first")
    packed = df.agg(F.array_sort(F.collect_list(F.struct(by, *metrics))).alias("_m"))
    wide = packed.select(*[F.transform("_m", _getter(c)).alias(c) for c in [by, *metrics]])
    wide.coalesce(1).write.mode(mode).json(path)


def _getter(name: str):
    return lambda x: x[name]


def write_verification_log(df: DataFrame, path: str, input_col: str = "input", score: str = "score",
                           verifications: str = "verifications", mode: str = "overwrite") -> None:
    """``{input, score, verifications[]}`` records."""
    df.select(F.col(input_col).alias("input"), F.col(score).alias("score"), F.col(verifications).alias("verifications")) \
        .write.mode(mode).json(path)


def run_version(options: Mapping[str, object]) -> str:
    """A version name built from the run options (stable across runs and machines)."""
    text = json.dumps(dict(sorted(options.items())), sort_keys=True, default=str)
    return "v-" + hashlib.sha1(text.encode()).hexdigest()[:12]


def write_if_absent(df: DataFrame, path: str, version: str) -> bool:
    """Publish ``df`` as ``version`` of ``path`` unless that version exists; True if this call published it.
    Read it by ``publication.read_published``."""
    return publish(df, path, version)


def materialize(df: DataFrame, path: str, version: str = "table") -> DataFrame:
    """Cache a normalised table on disk after the first load, then read it back; of several first loads one is kept."""
    publish(df, path, version)
    return read_published(df.sparkSession, path, version)


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """B7 for readers: the listed columns must exist."""
    missing = check(df, "required_columns", cols=cols)
    if missing.count() > 0:
        raise ValueError(f"missing columns: {[r.missing for r in missing.collect()]}")
    return df
