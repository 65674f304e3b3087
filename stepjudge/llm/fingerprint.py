"""Document fingerprints: the set of a text's content-defined chunks, each with its length.

Chunks are cut at normalised gear-hash boundaries, so an edit changes the chunks it touches and the
others stay. A fingerprint is the sorted list of distinct chunks, each a 48-bit digest and its length
in 16 hex digits. ``likeness(a, b)`` is containment by length: the share of a's distinct bytes that
lies in chunks which b has too.

``next_pairs`` fingerprints every document and its edited text (the end replaced by the beginning of
the next document by ascending id). Null ids come first; rows of one id are ordered by text. A null
text counts as empty; an empty text has an empty fingerprint, like any other empty one (1) and unlike
the rest (0). A table of one row has itself as next; an empty table gives no rows. Columns other than
those named aren't used.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepjudge.llm.chunking import Buffer, normalised
from stepjudge.llm.common import slices
from stepjudge.session import shuffle_partitions

LOW, NORMAL, HIGH, BITS = 12, 40, 160, 5


def chunk_sets(texts: list[str]) -> list[np.ndarray]:
    """Per text its distinct chunks, sorted: 48 bits of digest, then 16 bits of length."""
    buf = Buffer(texts)
    row, start, end = normalised(buf, LOW, NORMAL, HIGH, BITS)
    code = (buf.digests(start, end) & np.uint64(0xFFFFFFFFFFFF0000)) | (end - start).astype(np.uint64)
    code = code[np.lexsort((code, row))]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    return np.split(code[fresh], np.cumsum(np.bincount(row[fresh], minlength=len(texts)))[:-1])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    length = (a & np.uint64(0xFFFF)).astype(np.int64)
    at = np.searchsorted(b, a).clip(max=len(b) - 1)
    return float(length[b[at] == a].sum() / length.sum())


def text_of(chunks: np.ndarray) -> str:
    return chunks.astype(">u8").tobytes().hex()


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compare(texts: list[str]) -> pd.DataFrame:
    """One row for each text but the last, which only serves as a next one."""
    own, changed = texts[:-1], [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    sets = chunk_sets(texts + changed)
    mine, theirs = sets[: len(texts)], sets[len(texts) :]
    return pd.DataFrame(
        {
            "n_chars": list(map(len, own)),
            "edited_sha256": pd.Series([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], dtype=object),
            "fingerprint": pd.Series([text_of(s) for s in mine[:-1]], dtype=object),
            "edited_fingerprint": pd.Series([text_of(s) for s in theirs], dtype=object),
            "near_edited": [likeness(a, b) for a, b in zip(mine, theirs, strict=False)],
            "near_next": [likeness(a, b) for a, b in zip(mine, mine[1:], strict=False)],
        }
    )


def next_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of each document and of its edited text.

    Ids are cut into ranges at their approximate quantiles. The first rows of a range also go to the
    range before it (the first range's to the last), where they only serve as next document. What the
    driver holds is one id per range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    n = buckets or 4 * shuffle_partitions(spark)
    found = rows.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10_000).alias("q")).first()["q"] if n > 1 else []
    bounds = sorted(set(found or []))
    placed = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("k"))) if bounds else F.lit(0)
    # a null id makes the comparison null, which filter() takes as false: the first range
    rows = rows.withColumn("b", placed)
    firsts = sorted((r["b"], r["none"], r["k"]) for r in rows.groupBy("b").agg(F.min("k").alias("k"), F.max(F.col("k").isNull()).alias("none")).collect())
    before = {b: firsts[i - 1][0] for i, (b, _, _) in enumerate(firsts)}
    ahead = F.lit(None).cast("int")
    for b, none, k in firsts:
        first = F.col("k").isNull() if none else F.col("k") == F.lit(k)
        ahead = F.when((F.col("b") == b) & first, F.lit(before[b])).otherwise(ahead) if len(firsts) <= 16 else ahead
    if len(firsts) > 16:
        heads = {k: before[b] for b, none, k in firsts if not none}
        ahead = F.create_map(*[F.lit(x) for item in heads.items() for x in item])[F.col("k")]
        if firsts[0][1]:
            ahead = F.coalesce(F.when(F.col("k").isNull(), F.lit(before[firsts[0][0]])), ahead)
    rows = rows.withColumn("ahead", ahead)
    places = F.filter(F.array(F.struct(F.col("b").alias("b"), F.lit(0).alias("ahead")), F.struct(F.col("ahead").alias("b"), F.lit(1).alias("ahead"))), lambda x: x["b"].isNotNull())
    dealt = rows.select("k", "t", F.explode(places).alias("p")).select("k", "t", "p.b", "p.ahead")
    dealt = dealt.repartition(max(1, n // 4), "b").sortWithinPartitions("b", "ahead", F.col("k").asc_nulls_first(), "t")

    def run(batches):
        held = None
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            for a, z in slices(batch["t"]):
                part = batch.iloc[a : z + 1]  # and the row after it
                if len(part) < 2:
                    continue
                last = part["ahead"].to_numpy()[:-1] == 1
                out = _compare(part["t"].tolist())
                out.insert(0, "doc_id", part["k"].to_numpy()[:-1])
                yield out[~last]
            held = batch.iloc[-1:]

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def typed(batches):
        for out in run(batches):
            yield out.astype({"doc_id": "Int64"})

    return dealt.mapInPandas(typed, schema)
