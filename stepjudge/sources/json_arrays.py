"""JSON arrays of objects, read by many tasks per file (A2).

Spark's multi-line reader gives a whole file to one task. Here a file is read as text that ends a row at
every closing brace, which splits like any text file. What a brace means depends on what stands before it
in the file, and that is two running sums: quotes (an odd number: inside a string), then braces outside of
strings (zero: a record has ended). Both run over a slim table of counts per piece, in range slices with
carried totals where a file is large (``ranking.running``). The pieces of a record then meet by file and
record number and are parsed with the declared schema.

The result has a row per object of the arrays. Anything else fails the read: text between records other
than one comma, an unclosed array, string or record, or a record that doesn't fit the schema.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepjudge.operators.ranking import running
from stepjudge.session import checkpoint_dir


def _opened(segments: Column, first: int) -> Column:
    """Opening braces in every second segment from ``first`` on (segments are what quotes part)."""
    return F.aggregate(F.transform(segments, lambda s, i: F.when(i % 2 == first, F.length(s) - F.length(F.replace(s, F.lit("{")))).otherwise(0)), F.lit(0), lambda a, x: a + x)


def read_json_arrays(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str, name_like: str | None = None, split_bytes: int | None = None) -> DataFrame:
    """All objects of the JSON arrays in the given files or directories. ``split_bytes``: the size of a split, if not the session's."""
    reader = spark.read.option("lineSep", "}")
    if name_like:
        reader = reader.option("pathGlobFilter", name_like)
    setting, before = "spark.sql.files.maxPartitionBytes", None
    checkpoint_dir(spark)
    if split_bytes:
        before = spark.conf.get(setting)
        spark.conf.set(setting, str(split_bytes))
    try:
        pieces = reader.text(list(paths)).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))
        # rows of a split have rising ids; written once, since another reading could number the splits otherwise
        pieces = pieces.checkpoint(eager=True)
    finally:
        if before is not None:
            spark.conf.set(setting, before)
    segments = F.split(F.regexp_replace("text", r"(?s)\\.", ""), '"', -1)
    slim = pieces.withColumn("s", segments).select("file", "block", "id", (F.size("s") - 1).alias("quotes"), _opened(F.col("s"), 0).alias("even"), _opened(F.col("s"), 1).alias("odd"))
    order = ["block", "id"]
    slim = running(slim, ["file"], order, {"upto": ("sum", "quotes"), "at": ("count", None)})
    pieces_of = slim.groupBy("file").agg(F.max("at").alias("n"))
    slim = slim.join(pieces_of, "file")
    last = F.col("at") == F.col("n")
    opened = F.when((F.col("upto") - F.col("quotes")) % 2 == 0, F.col("even")).otherwise(F.col("odd"))
    # a piece ends at a brace, but for the file's last; the brace counts unless it stands in a string
    closed = F.when(~last & (F.col("upto") % 2 == 0), 1).otherwise(0)
    slim = slim.select("file", "block", "id", "upto", last.alias("last"), (opened - closed).alias("change"), opened.alias("opened"), closed.alias("closed"))
    slim = running(slim, ["file"], order, {"depth": ("sum", "change")})
    ends = F.when((F.col("closed") == 1) & (F.col("depth") == 0), 1).otherwise(0)
    slim = running(slim.withColumn("ends", ends), ["file"], order, {"ended": ("sum", "ends")})
    slim = slim.withColumn("record", F.col("ended") - F.col("ends"))
    joined = pieces.join(slim.select("id", "last", "upto", "depth", "record", "ended"), "id")
    raw = F.when(F.col("last"), F.col("text")).otherwise(F.concat("text", F.lit("}")))
    piece = F.struct("block", "id", raw.alias("raw"))
    whole = joined.groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["raw"]), "").alias("raw"), F.max("last").alias("last"), F.max("upto").alias("quotes"))
    lead = F.when(F.col("record") == 0, F.lit(r"^\s*\[\s*\{")).otherwise(F.lit(r"^\s*,\s*\{"))
    tail = F.when(F.col("record") == 0, F.lit(r"^\s*\[\s*\]\s*$")).otherwise(F.lit(r"^\s*\]\s*$"))
    bad = F.raise_error(F.concat(F.lit("malformed JSON array in "), F.col("file"), F.lit(": "), F.left("raw", F.lit(80))))
    good = F.when(F.col("last"), F.regexp_like("raw", tail)).otherwise(F.regexp_like("raw", lead))
    # a file's last piece is the array's end and no record; it is checked, too
    text = F.when(~good, bad.cast("string")).when(F.col("last"), F.lit(None)).otherwise(F.regexp_replace("raw", r"^\s*[\[,]", ""))
    parsed = whole.select(text.alias("t")).where("t IS NOT NULL").select(F.from_json("t", schema, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.*")
