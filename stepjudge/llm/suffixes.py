"""Removal of byte strings that occur in an earlier document, by a logarithmic family of suffix indexes.

A byte goes if a string of ``SPAN`` bytes that covers it also starts in a document of smaller id. Every such
string holds a sampled suffix: among its grams (20 bytes for 50) that of smallest digest, so two equal
strings hold the same one at the same place.

* Texts that an earlier document holds as a whole are told by digest and take no further part.
* Documents come in batches of rising id. A batch gets its (sparse) suffix array: the sampled suffixes in the
  order of their grams' digests, packed as one row per bucket of grams (about a million suffixes for all batches
  together, however large the table is) in a bucketed table.
* The array is merge-scanned against the existing levels, whose rows of the same bucket meet it without a shuffle,
  and against itself. A gram that another document holds too is reported for both documents.
* The array then is a level of size 1; two levels of equal size merge into one of twice the size that keeps the first
  document of each gram, so there are never more than log2(batches) of them and each entry is rewritten as often
  at most.
* The reported grams are verified exactly. Each gives its bytes before and behind; of equal surroundings all but
  those in the first document are done, the rest are compared string by string within their gram (grams beyond
  ``HOT`` distinct surroundings by an aggregate per string, so no task holds such a group). This runs in
  ``ROUNDS`` parts by gram, which bounds what is on disk at a time.

Grams are 64-bit digests; the bytes around them are compared as they are. Strings never cross documents and are
judged on the input. A null text counts as empty. Rows without an id keep all their bytes and take none from
others. Rows of one id and one text are treated alike; rows of one id take nothing from each other, whatever
their texts. Texts shorter than ``SPAN`` bytes lose nothing. A very long text costs its task memory of about 100
bytes for each of its own. An empty table gives no rows. Further columns aren't used.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepjudge.llm.common import free, remove, slices_of
from stepjudge.session import checkpoint_dir

SPAN = 50
BATCHES = 4
ROUNDS = 2
HOT = 50_000  # distinct surroundings of one gram that a task compares in memory
BUCKET_BYTES = 16_000_000  # bytes of text for each bucket of the index tables
PART = 50_000  # suffixes of one row of those known to be shared
SLICE_OUT = 4_000_000  # characters given out at once
PACK = 500_000  # suffixes that a task packs at once
WHOLE = -1  # stands for the places of a text that is a copy as a whole
SLICE = 64_000  # characters handled at once: what numpy works on then stays in a core's cache
MIX = 0xD6E8FEB86659FD93
BASE = 0x9E3779B97F4A7C15


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """A 32-bit digest of the ``size`` bytes from every place on, by doubling; it only orders the grams of a window."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    block = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(MIX & 0xFFFFFFFF)  # digests of 1, 2, 4, ... bytes
    out, width, at, rest = None, 1, 0, size
    while rest:
        step = np.uint32(pow(BASE, width, 1 << 32))
        if rest & 1:
            part = block[at : at + n]
            out = part.copy() if out is None else out * step + part
            at += width
        rest >>= 1
        if rest:
            block = block[:-width] * step + block[width:]
            width *= 2
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(12)
    return out


def digests(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit digest of the ``size`` bytes from each given place on."""
    wide = -(-size // 8) * 8
    raw = np.zeros((len(at), wide), dtype=np.uint8)
    raw[:, :size] = data[at[:, None] + np.arange(size)]
    out = np.zeros(len(at), dtype=np.uint64)
    for column in raw.view(np.uint64).T:
        out = (out ^ column) * np.uint64(MIX)
        out ^= out >> np.uint64(32)
        out *= np.uint64(BASE)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def gram_size(span: int) -> int:
    """Two fifths of a string; longer where a mask of 32 bits couldn't tell its places apart."""
    return max(span * 2 // 5, span - 31)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    out, held = values, 1
    while held * 2 <= width:
        out, held = np.minimum(out[:-held], out[held:]), held * 2
    n = len(values) - width + 1
    return np.minimum(out[:n], out[width - held : width - held + n])


def sampled(texts: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in it, gram) of every sampled suffix, the texts' bytes one behind the other and their bounds."""
    size = gram_size(span)
    width = span - size + 1
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    bound = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    gram = grams(data, size)
    if len(gram) < width:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, data, bound
    # sampled: the smallest of some window of grams, that is, the largest of the windows' least is its own
    edge = np.zeros(width - 1, dtype=np.uint32)
    most = ~_least(~np.concatenate([edge, _least(gram, width), edge]), width)
    at = np.flatnonzero(most == gram)
    text = np.searchsorted(bound, at, side="right") - 1
    inside = (at + size <= bound[text + 1]) & (bound[text + 1] - bound[text] >= span)
    at, text = at[inside], text[inside]
    return text, at - bound[text], digests(data, at, size), data, bound


def suffixes(docs: DataFrame, buckets: int, span: int = SPAN) -> DataFrame:
    """(bucket, grams, docs): the sampled suffixes of a table (doc_id, text), packed per bucket of grams whenever a task has
    ``PACK`` of them.

    A pack keeps the first document of each gram, so a gram that a third of all documents hold sends an entry per pack
    to its bucket. Grams that several documents of a pack hold are shared for sure: all their documents are listed in
    a row with a negative bucket, which the scan passes on."""

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        gram, doc = (np.concatenate(parts) for parts in zip(*held, strict=True))
        order = np.lexsort((doc, gram))
        gram, doc = gram[order], doc[order]
        first = _firsts(gram)
        kept_gram, kept_doc = gram, doc
        size = np.diff(np.concatenate([first, [len(gram)]]))
        known = np.repeat(doc[first] < doc[first + size - 1], size)  # several documents here: shared for sure
        at = (gram[first].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        each, begin = np.unique(at[order], return_index=True)
        cut = [first[order[i:j]] for i, j in zip(begin.tolist(), [*begin.tolist()[1:], len(order)], strict=True)]
        # what is known needs no bucket: it is dealt out in small parts
        gram, doc = gram[known], doc[known]
        parts = [slice(i, i + PART) for i in range(0, len(gram), PART)]
        spread = [-1 - int(gram[c][0].view(np.uint64) % np.uint64(buckets)) for c in parts]
        rows = [(kept_gram[c], kept_doc[c]) for c in cut] + [(gram[c], doc[c]) for c in parts]
        return _packed_rows(np.array([*each.tolist(), *spread], dtype=np.int32), [g for g, _ in rows], [d for _, d in rows])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            texts, ids = batch.column("t"), batch.column("doc_id").to_numpy()
            for a, b in slices_of(pc.utf8_length(texts).to_numpy(), SLICE):
                text, _, gram, _, _ = sampled([t.encode() for t in texts.slice(a, b - a).to_pylist()], span)
                order = np.lexsort((gram, text))
                text, gram = text[order], gram[order]
                new = np.ones(len(gram), dtype=bool)
                new[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])
                held.append((gram[new], ids[a:b][text[new]]))
                n += int(new.sum())
                if n >= PACK:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    return docs.select("doc_id", F.col("text").alias("t")).mapInArrow(run, PACKED)


PACKED = "bucket int, grams binary, docs binary"


def _packed_rows(bucket: np.ndarray, grams: list[np.ndarray], docs: list[np.ndarray]) -> pa.RecordBatch:
    raw = lambda parts: pa.array([p.tobytes() for p in parts], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(bucket), raw(grams), raw(docs)], names=["bucket", "grams", "docs"])


def _unpacked(raw: bytes | None) -> np.ndarray:
    return np.frombuffer(raw or b"", dtype=np.int64)


def _firsts(gram: np.ndarray) -> np.ndarray:
    """The places in a sorted array where another value begins."""
    return np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, dtype=np.int64)


def _sorted(batches):
    """One row per bucket: its suffixes ordered by gram, then document. Rows of what is known stay as they are."""
    held: dict[int, tuple[list, list]] = {}
    for batch in batches:
        for bucket, grams, docs in zip(*(batch.column(c).to_pylist() for c in ("bucket", "grams", "docs")), strict=True):
            if bucket < 0:
                yield _packed_rows(np.array([bucket], dtype=np.int32), [_unpacked(grams)], [_unpacked(docs)])
                continue
            mine = held.setdefault(bucket, ([], []))
            mine[0].append(_unpacked(grams))
            mine[1].append(_unpacked(docs))
    for bucket, (grams, docs) in held.items():
        gram, doc = np.concatenate(grams), np.concatenate(docs)
        order = np.lexsort((doc, gram))
        yield _packed_rows(np.array([bucket], dtype=np.int32), [gram[order]], [doc[order]])


def _scanned(levels: int):
    """Merge-scan of an array with the levels beside it: (gram, doc_id) that two documents hold."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                gram, doc = _unpacked(row["grams"]), _unpacked(row["docs"])
                if row["bucket"] < 0:
                    yield from _pairs(gram, doc)
                    continue
                first = _firsts(gram)
                last = np.concatenate([first[1:], [len(gram)]]).astype(np.int64) - 1
                shared, found = doc[first] < doc[last], []
                for i in range(levels):
                    other, docs = _unpacked(row[f"grams{i}"]), _unpacked(row[f"docs{i}"])
                    if not len(other) or not len(first):
                        continue
                    at = np.minimum(np.searchsorted(other, gram[first]), len(other) - 1)
                    hit = other[at] == gram[first]
                    shared |= hit
                    found.append((gram[first[hit]], docs[at[hit]]))
                every = np.repeat(shared, last + 1 - first)
                found.append((gram[every], doc[every]))
                for g, d in found:
                    yield from _pairs(g, d)

    return run


def _pairs(gram: np.ndarray, doc: np.ndarray):
    for a in range(0, len(gram), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(gram[a : a + 100_000]), pa.array(doc[a : a + 100_000])], names=["gram", "doc_id"])


def _merged(batches):
    """The suffixes of two levels as one, with the first document of each gram."""
    for batch in batches:
        for row in batch.to_pylist():
            gram = np.concatenate([_unpacked(row["grams"]), _unpacked(row["grams0"])])
            doc = np.concatenate([_unpacked(row["docs"]), _unpacked(row["docs0"])])
            order = np.lexsort((doc, gram))
            gram, doc = gram[order], doc[order]
            first = _firsts(gram)
            yield _packed_rows(np.array([row["bucket"]], dtype=np.int32), [gram[first]], [doc[first]])


class Family:
    """Levels of suffix indexes; ``add`` takes batches whose ids rise from batch to batch."""

    def __init__(self, spark: SparkSession, buckets: int, span: int = SPAN):
        self.spark, self.buckets, self.span = spark, buckets, span
        self.name = f"suffixes_{uuid.uuid4().hex}"
        self.folder = f"{checkpoint_dir(spark)}/{self.name}"
        self.tables = 0
        self.levels: list[tuple[int, str]] = []  # (batches held, table), largest first
        self.found: list[str] = []  # folders of reported grams

    def _write(self, df: DataFrame) -> str:
        """A table of packed suffixes, bucketed alike; its files are in the checkpoint folder."""
        name = f"{self.name}_{self.tables}"
        df.write.bucketBy(self.buckets, "bucket").option("path", f"{self.folder}/{name}").option("parquet.enable.dictionary", "false").saveAsTable(name)
        self.tables += 1
        return name

    def _drop(self, name: str) -> None:
        """The table's entry and files: what it held is in a written table since."""
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, f"{self.folder}/{name}")

    def beside(self, array: str, levels: list[str], how: str) -> DataFrame:
        """An array's rows with those of the levels of the same bucket; tables bucketed alike meet without a shuffle."""
        out = self.spark.table(array)
        for i, level in enumerate(levels):
            other = self.spark.table(level).where("bucket >= 0").select("bucket", F.col("grams").alias(f"grams{i}"), F.col("docs").alias(f"docs{i}"))
            out = out.hint("merge").join(other.hint("merge"), "bucket", how)
        return out

    def add(self, docs: DataFrame, last: bool = False) -> str:
        """Index a batch (doc_id, text); gives the folder of (gram, doc_id) that it shares with others, theirs included."""
        packed = suffixes(docs, self.buckets, self.span).repartition(self.buckets, "bucket")
        array = self._write(packed.mapInArrow(_sorted, PACKED))
        path = f"{self.folder}/shared-{len(self.found)}"
        scan = self.beside(array, [level for _, level in self.levels], "left")
        scan.mapInArrow(_scanned(len(self.levels)), "gram bigint, doc_id bigint").write.parquet(path)
        self.found.append(path)
        if last:
            self._drop(array)
        else:
            self._push(array)
        free(self.spark)
        return path

    def _push(self, array: str) -> None:
        size, level = 1, array
        while self.levels and self.levels[-1][0] == size:
            _, other = self.levels.pop()
            merged = self._write(self.beside(level, [other], "full").where("bucket >= 0").mapInArrow(_merged, PACKED))
            self._drop(level)
            self._drop(other)
            size, level = size * 2, merged
        self.levels.append((size, level))

    def close(self) -> None:
        for _, level in self.levels:
            self._drop(level)
        self.levels = []


def surroundings(docs: DataFrame, shared: DataFrame, span: int) -> DataFrame:
    """(gram, doc_id, h, places, valid, around): the bytes around each reported gram of a table (doc_id, h, text), once
    per text with all its places.

    ``around`` holds as many bytes before and behind as a string of ``span`` bytes reaches; bit o of ``valid``
    tells whether the string that begins o bytes before the gram lies in the text.
    """
    size = gram_size(span)
    reach = span - size

    def run(batches):
        for batch in batches:
            for a, b in slices_of(pc.utf8_length(batch.column("t")).to_numpy(), SLICE):
                part = batch.slice(a, b - a)
                text, place, gram, data, bound = sampled([t.encode() for t in part.column("t").to_pylist()], span)
                wanted = part.column("grams")
                keep = np.zeros(len(gram), dtype=bool)
                first = np.searchsorted(text, np.arange(b - a + 1))
                for i in range(b - a):
                    keep[first[i] : first[i + 1]] = np.isin(gram[first[i] : first[i + 1]], np.asarray(wanted[i].values))
                text, place, gram = text[keep], place[keep], gram[keep]
                at = bound[text] + place
                padded = np.concatenate([np.zeros(reach, np.uint8), data, np.zeros(reach, np.uint8)])
                offsets = np.concatenate([np.arange(reach), np.arange(reach) + reach + size])
                around = padded[at[:, None] + offsets[None, :]]
                before, behind = np.minimum(place, reach), np.minimum(bound[text + 1] - at - size, reach)
                # bytes beyond the text are zeros, whatever stands in the next text
                cols = np.arange(reach)
                around[:, :reach][cols[None, :] < (reach - before)[:, None]] = 0
                around[:, reach:][cols[None, :] >= behind[:, None]] = 0
                o = np.arange(reach + 1)
                valid = ((o[None, :] <= before[:, None]) & (reach - o[None, :] <= behind[:, None])) @ (1 << o)
                around = np.ascontiguousarray(around)
                row, ends, places = _gathered(text, gram, place, valid, around)
                raw = around[row]
                cut = pa.array(np.arange(len(raw) + 1, dtype=np.int32) * (2 * reach)).buffers()[1]
                column = pa.Array.from_buffers(pa.binary(), len(raw), [None, cut, pa.py_buffer(raw)])
                take = pa.array(text[row])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[row]), part.column("doc_id").take(take), part.column("h").take(take), pa.ListArray.from_arrays(pa.array(ends), pa.array(places)), pa.array(valid[row].astype(np.int64)), column],
                    names=["gram", "doc_id", "h", "places", "valid", "around"],
                )

    of_doc = shared.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list("gram").alias("grams"))
    joined = docs.join(of_doc, F.col("doc_id") == F.col("of")).select("doc_id", "h", F.col("text").alias("t"), "grams")
    return joined.mapInArrow(run, "gram bigint, doc_id bigint, h bigint, places array<bigint>, valid bigint, around binary").where("valid <> 0")


def _gathered(text: np.ndarray, gram: np.ndarray, place: np.ndarray, valid: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of one text with equal gram and surroundings as one: (a row of each, bounds and values of its places)."""
    order = np.lexsort((place, gram, text))
    same = (text[order][1:] == text[order][:-1]) & (gram[order][1:] == gram[order][:-1])
    near = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(order) else np.zeros(0, dtype=bool)
    held: dict[tuple, list[int]] = {}
    for i in order[near].tolist():  # grams that a text repeats are few, but in periodic texts
        held.setdefault((text[i], gram[i], valid[i], around[i].tobytes()), []).append(i)
    groups = [[i] for i in order[~near].tolist()] + list(held.values())
    ends = np.concatenate([[0], np.cumsum([len(g) for g in groups])]).astype(np.int32)
    rows = np.array([g[0] for g in groups], dtype=np.int64)
    return rows, ends, place[np.array([i for g in groups for i in g], dtype=np.int64)]


def _compare(gram: np.ndarray, doc: np.ndarray, valid: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Per row the bits of the strings that a row of smaller document and equal gram holds too."""
    reach, out = around.shape[1] // 2, np.zeros(len(gram), dtype=np.int64)
    by_doc = np.argsort(doc, kind="stable")
    for o in range(reach + 1):
        rows = by_doc[(valid[by_doc] >> o) & 1 == 1]
        if len(rows) < 2:
            continue
        part = np.zeros((len(rows), -(-reach // 8) * 8), dtype=np.uint8)
        part[:, :reach] = around[rows, reach - o : 2 * reach - o]
        words = part.view(np.uint64)
        mixed = gram[rows].view(np.uint64) * np.uint64(MIX)
        for j in range(words.shape[1]):
            mixed = (mixed ^ words[:, j]) * np.uint64(BASE)
            mixed ^= mixed >> np.uint64(31)
        order = np.argsort(mixed, kind="stable")
        same = mixed[order][1:] == mixed[order][:-1]
        equal = (gram[rows][order][1:] == gram[rows][order][:-1]) & (words[order][1:] == words[order][:-1]).all(axis=1)
        if not np.array_equal(same, equal):  # digests collide: order by the bytes themselves
            order = np.lexsort((doc[rows], *words.T, gram[rows]))
            equal = (gram[rows][order][1:] == gram[rows][order][:-1]) & (words[order][1:] == words[order][:-1]).all(axis=1)
        new = np.concatenate([[True], ~equal])
        least = doc[rows][order][new][np.cumsum(new) - 1]  # rows are in the order of documents within a string
        out[rows[order]] |= (least < doc[rows][order]).astype(np.int64) << o
    return out


def _masks(rows: DataFrame, hot: int) -> DataFrame:
    """(doc_id, h, places, mask) of rows that are the first of their surroundings, compared within their gram."""
    sized = rows.withColumn("n", F.count("*").over(Window.partitionBy("gram")))

    def run(batches):
        held: list[pa.RecordBatch] = []

        def solve(table: pa.Table):
            cols = {c: table.column(c).combine_chunks() for c in table.column_names}
            around = cols["around"]
            ends = np.frombuffer(around.buffers()[1], dtype=np.int32)[around.offset : around.offset + len(around) + 1]
            data = np.frombuffer(around.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].reshape(len(around), -1)
            mask = _compare(*(cols[c].to_numpy() for c in ("gram", "doc_id", "valid")), data)
            out = pa.table([cols["doc_id"], cols["h"], cols["places"], pa.array(mask)], names=["doc_id", "h", "places", "mask"])
            return out.to_batches()

        # rows come sorted by gram: what is held is solved up to the last gram's begin
        for batch in batches:
            held.append(batch)
            if sum(len(b) for b in held) < hot:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            gram = table.column("gram").to_numpy()
            cut = int(np.flatnonzero(gram == gram[-1])[0])
            if cut:
                yield from solve(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held and sum(len(b) for b in held):
            yield from solve(pa.Table.from_batches(held))

    some = sized.where(F.col("n") <= hot).drop("n").sortWithinPartitions("gram")
    out = some.mapInArrow(run, "doc_id bigint, h bigint, places array<bigint>, mask bigint")
    # the others string by string: an aggregate per (gram, string), nothing is collected
    reach = F.octet_length("around") / 2
    each = sized.where(F.col("n") > hot).withColumn("o", F.explode(F.sequence(F.lit(0), reach.cast("int")))).where(F.getbit("valid", F.col("o")) == 1)
    each = each.withColumn("string", F.substring("around", (reach - F.col("o") + 1).cast("int"), reach.cast("int"))).drop("around", "n", "valid")
    least = each.groupBy(F.col("gram").alias("g"), F.col("o").alias("p"), F.col("string").alias("s")).agg(F.min("doc_id").alias("least"))
    met = each.join(least, (F.col("gram") == F.col("g")) & (F.col("o") == F.col("p")) & (F.col("string") == F.col("s"))).where("least < doc_id")
    return out.unionByName(met.groupBy("doc_id", "h", "places").agg(F.bit_or(F.expr("shiftleft(1L, o)")).alias("mask")))


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, batches: int = BATCHES, rounds: int = ROUNDS, hot: int = HOT) -> DataFrame:
    """(doc_id, h, starts): per id and text (its 64-bit digest) the places of strings that start in an earlier document,
    as (place << 32 | mask) around the sampled suffixes: bit o is the string that begins o bytes before."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).dropna().where(F.octet_length("text") >= span)
    rows = rows.withColumn("h", F.xxhash64("text"))
    family = Family(spark, 1, span)
    copies = _copies(rows, f"{family.folder}/copies")
    rows = rows.join(copies, ["doc_id", "h"], "left_anti")
    size, *cuts = rows.agg(F.sum(F.octet_length("text")), *[F.percentile_approx("doc_id", (i + 1) / batches, 10_000) for i in range(batches - 1)]).first()
    family.buckets = max(1, -(-int(size or 0) // BUCKET_BYTES))
    cuts = sorted({c for c in cuts if c is not None})
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        batch = rows if low is None else rows.where(F.col("doc_id") > low)
        family.add(batch if high is None else batch.where(F.col("doc_id") <= high), last=high is None)
    family.close()
    shared = spark.read.parquet(*family.found)
    out = None
    for r in range(rounds):
        folder = f"{family.folder}/first-{r}"
        part = _verified(rows, shared.where(F.pmod(F.col("gram"), F.lit(rounds)) == r), span, hot, folder)
        remove(spark, folder)
        free(spark)
        out = part if out is None else out.unionByName(part)
    whole = copies.select("doc_id", "h", F.array(F.lit(WHOLE).cast("bigint")).alias("starts"))
    return out.unionByName(whole).groupBy("doc_id", "h").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def _copies(rows: DataFrame, folder: str) -> DataFrame:
    """(doc_id, h) of the texts that a smaller id holds as a whole. Written, so that Spark knows its size when it joins."""
    held = rows.select("doc_id", "h", F.sha2(F.col("text").cast("binary"), 256).alias("digest")).distinct()
    first = held.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    held.join(first, "digest").where("doc_id > first").select("doc_id", "h").write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def _verified(docs: DataFrame, shared: DataFrame, span: int, hot: int, folder: str) -> DataFrame:
    """(doc_id, h, starts): the reported grams whose strings are in an earlier document, as ``repeated`` gives them."""
    around = surroundings(docs, shared, span)
    first = F.min("doc_id").over(Window.partitionBy("gram", "valid", "around"))
    later = F.col("doc_id") > first
    # written once: what follows reads the few columns of the later ones and the bytes of the first ones
    around.withColumn("later", later).withColumn("around", F.when(~F.col("later"), F.col("around"))).write.parquet(folder)
    free(docs.sparkSession)
    around = docs.sparkSession.read.parquet(folder)
    masks = _masks(around.where("not later").drop("later"), hot).unionByName(around.where("later").select("doc_id", "h", "places", F.col("valid").alias("mask")))
    starts = F.transform("places", lambda p: F.shiftleft(p, 32).bitwiseOR(F.col("mask"))).alias("starts")
    masks.where("mask <> 0").select("doc_id", "h", starts).write.parquet(f"{folder}-starts")  # columns: a tenth of a checkpoint's rows
    return docs.sparkSession.read.parquet(f"{folder}-starts")


def _covered(raw: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """Which bytes of a text are covered by the strings listed."""
    if len(starts) and starts[0] == WHOLE:
        return np.ones(len(raw), dtype=bool)
    reach = span - gram_size(span)
    place, mask = starts >> 32, starts & 0xFFFFFFFF
    o = np.arange(reach + 1)
    row, bit = np.nonzero((mask[:, None] >> o[None, :]) & 1)
    begin = place[row] - o[bit]
    edge = np.zeros(len(raw) + 1, dtype=np.int64)
    begin = np.unique(begin)
    edge[begin] += 1
    edge[begin + span] -= 1
    return np.cumsum(edge[:-1]) > 0


def kept(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row: the bytes that stay, as binary."""
    return _cut(docs, key, text, span, False, **options)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    return _cut(docs, key, text, span, True, **options)


def _cut(docs: DataFrame, key: str, text: str, span: int, digest: bool, **options) -> DataFrame:
    if not 8 <= span <= 62:
        raise ValueError("strings of 8 to 62 bytes")
    found = repeated(docs, key, text, span, **options).withColumnRenamed("doc_id", "of")

    result = (lambda raw: hashlib.sha256(raw).hexdigest()) if digest else bytes

    def cut(k, t, starts):
        raw = (t or "").encode()
        if starts is None or not len(starts):
            return k, len(raw), 0, 0, result(raw)
        data = np.frombuffer(raw, dtype=np.uint8)
        gone = _covered(data, np.asarray(starts, dtype=np.int64), span)
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        return k, len(raw), int(gone.sum()), spans, result(data[~gone].tobytes())

    def run(batches):
        for batch in batches:
            for a, b in slices_of(batch["t"].str.len().fillna(0).to_numpy(dtype="int64"), SLICE_OUT):
                part = batch.iloc[a:b]
                rows = [cut(*row) for row in zip(part["id"], part["t"], part["starts"], strict=True)]
                yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"), F.xxhash64(text).alias("mine"))
    joined = rows.join(found, (F.col("id") == F.col("of")) & (F.col("mine") == F.col("h")), "left").select(F.col("id").cast("string").alias("id"), "t", "starts")
    name, kind = ("kept_sha256", "string") if digest else ("kept", "binary")
    out = joined.mapInPandas(run, f"doc_id string, n_bytes bigint, n_removed bigint, n_spans bigint, kept {kind}")
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumnRenamed("kept", name)
