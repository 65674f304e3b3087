"""Substring deduplication by content-defined chunks.

Every text is cut where the gear hash of the last 32 bytes begins with zero bits; such cuts depend on
the content alone, so an insertion shifts nothing behind it. Chunks are compared by a 64-bit digest and
their length. A chunk is repeated if two documents hold it; neighbouring repeated chunks form a run, and
runs of ``MIN_WORDS`` words or more are reported. The copy in the document of smallest id stays.

A null text counts as empty and has no chunks; rows without an id take no part, since nothing could be
told about them. Rows of one id are one document: their copies don't count as repeats across documents.
Their texts are cut and read on their own (``text_hash`` tells them apart), and each distinct run of a text
is reported once. Repeats within one document alone aren't reported. An empty
table gives no rows. Columns other than those named aren't used.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepjudge.llm.chunking import Buffer, local
from stepjudge.llm.common import SPACES, free_name, slices

BITS, HIGH = 5, 1024  # mean chunk of 32 bytes; cut evenly beyond HIGH
MIN_WORDS = 16


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """(doc_id, text_hash, seq, start, size, words, digest) of every chunk; start and size in code points."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch["t"]):
                part = batch.iloc[a:b]
                buf = Buffer(part["t"].tolist())
                row, start, end = local(buf, bits, HIGH)
                points = np.concatenate([[0], np.cumsum(buf.bytes & 0xC0 != 0x80)])
                space = np.isin(buf.bytes, np.frombuffer(SPACES.encode() + b"\0", dtype=np.uint8))
                ends = np.concatenate([[0], np.cumsum(~space[:-1] & space[1:]), [0]])[: len(buf.bytes) + 1]
                first = np.searchsorted(row, row, side="left")
                yield pd.DataFrame(
                    {
                        "doc_id": part["k"].to_numpy()[row],
                        "text_hash": part["h"].to_numpy()[row],
                        "seq": np.arange(len(row)) - first,
                        "start": points[start] - points[buf.start[row]],
                        "size": points[end] - points[start],
                        "words": ends[np.minimum(end, len(ends) - 1)] - ends[start],
                        "digest": buf.digests(start, end).astype(np.int64),
                    }
                )

    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h")).dropna()
    return rows.mapInPandas(run, "doc_id bigint, text_hash bigint, seq int, start int, size int, words int, digest bigint")


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, start, end, n_words, first_doc, removable): runs of chunks that other documents hold too.

    ``first_doc`` is the smallest id that holds one of the run's chunks; ``removable`` are the run's
    code points in chunks that a document of smaller id holds.
    """
    found = chunks(docs, key, text)
    shared = (
        found.groupBy("digest", "size")
        .agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        .where("first_doc < last_doc")
        .select("digest", "size", "first_doc")
    )
    held = found.join(shared, ["digest", "size"]).select("doc_id", "text_hash", "seq", "start", "size", "words", "first_doc").distinct()
    order = Window.partitionBy("doc_id", "text_hash").orderBy("start")
    new = F.coalesce(F.col("start") != F.lag(F.col("start") + F.col("size")).over(order), F.lit(True))
    runs = held.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order))
    return (
        runs.groupBy("doc_id", "text_hash", "run")
        .agg(
            F.min("start").alias("start"),
            F.max(F.col("start") + F.col("size")).alias("end"),
            F.sum("words").alias("n_words"),
            F.min("first_doc").alias("first_doc"),
            F.sum(F.when(F.col("first_doc") < F.col("doc_id"), F.col("size")).otherwise(0)).alias("removable"),
        )
        .where(F.col("n_words") >= min_words)
        .drop("run")
    )


def remove_runs(docs: DataFrame, runs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the runs that stay in a document of smaller id; all columns are kept."""
    gone, mine, hashed = free_name(docs, "_gone"), free_name(docs, "_key"), free_name(docs, "_hash")
    spans = runs.where("first_doc < doc_id").groupBy(F.col("doc_id").alias(mine), F.col("text_hash").alias(hashed)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(gone))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, ranges in zip(texts, spans, strict=True):
            at, kept = 0, []
            for r in ranges:
                kept.append(t[at : r["start"]])
                at = r["end"]
            out.append("".join([*kept, t[at:]]))
        return pd.Series(out, dtype=object)

    joined = docs.join(spans, (docs[key] == F.col(mine)) & (F.xxhash64(docs[text]) == F.col(hashed)), "left")
    changed = F.when(F.col(gone).isNotNull() & F.col(text).isNotNull(), cut(F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(gone), F.array().cast("array<struct<start:int,end:int>>")))).otherwise(F.col(text))
    return joined.withColumn(text, changed).select(*docs.columns)
