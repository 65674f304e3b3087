"""Streaming use of the grading functions.

The reference has no streaming operators (no watermark, window or state store), so nothing
stream-specific is built. What carries over is that the row-level Column functions work on a
streaming DataFrame unchanged; the distinct-value normalisation and the votes need whole groups,
so they run per micro-batch through ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepjudge.functions.answers import answers_equal, extract_answers
from stepjudge.session import checkpoint_dir

CANDIDATE_STREAM_SCHEMA = T.StructType([
    T.StructField("problem_id", T.LongType()),
    T.StructField("idx", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("gold", T.StringType()),
])


def read_candidate_stream(spark: SparkSession, path: str, schema: T.StructType = CANDIDATE_STREAM_SCHEMA) -> DataFrame:
    """JSON-lines files arriving in a folder, read as a stream with a declared schema."""
    return spark.readStream.schema(schema).option("mode", "FAILFAST").json(path)


def grade_batch(batch: DataFrame, text: str = "text", gold: str = "gold") -> DataFrame:
    """Extract, normalise and grade one micro-batch (the table operators, unchanged)."""
    p = extract_answers(batch, text, "pred")
    return p.withColumn("is_correct", answers_equal(F.col("pred"), F.col(gold)))


def start_grading(stream: DataFrame, out_path: str, name: str = "grading", text: str = "text", gold: str = "gold"):
    """Grade every micro-batch and append it to a parquet table; progress is kept in the shared
    checkpoint folder, so a restarted query resumes where it stopped."""
    ckpt = f"{checkpoint_dir(stream.sparkSession).rstrip('/')}/{name}"

    def write(batch: DataFrame, batch_id: int) -> None:
        # each micro-batch owns its folder and overwrites it: a replayed batch (after a failure)
        # replaces its earlier output instead of adding to it
        grade_batch(batch, text, gold).write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", ckpt).start()
