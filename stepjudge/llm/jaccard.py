"""Near duplicates: a Jaccard join on word shingles with Bayesian pruning of candidates.

Every distinct text is a set of shingles of five words (fewer words: one shingle of them all) with
MinHash values in bands. Texts that agree in a band are candidates. Their values are compared step by
step, and a pair is dropped as soon as the posterior probability that its similarity reaches the
threshold falls below a tolerance (uniform prior, so the posterior is a binomial tail). What remains
is verified exactly on whole shingle sets.

A band's bucket may hold very many texts, so pairs are never listed per bucket. First every text of a
bucket is compared with the bucket's least; the pairs that stay connect texts into groups. Only texts
of a bucket that are still in different groups are compared with each other, in blocks. Then all pairs
within a group are verified in blocks as a product of shingle matrices, giving each text's number of
links and few edges, whose components are the classes. Copies of one text stand for each other.

A pair at the threshold misses all 32 bands with probability (1 - 0.8^5)^32 = 3e-6, and the pruning
loses less than the tolerance. Distinct texts are told apart by a 64-bit hash.

White space separates words; case matters. Texts without a word have no shingles and are like copies of
themselves alone; a null text counts as empty. Rows without an id get no class (null) and no links.
Repeated rows are copies. An empty table gives no rows. Columns other than those named aren't used.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepjudge.llm.chunking import _mixed
from stepjudge.llm.common import SPACES, checkpoint, free_name, slices
from stepjudge.llm.components import components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
TOLERANCE = 1e-4
STEP = 32  # MinHash values compared at a time
BLOCK = 64  # texts of a block; a task meets two blocks at a time

_FACTOR = _mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).astype(np.uint32) | np.uint32(1)
_SHIFT = (_mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)) >> np.uint64(32)).astype(np.uint32)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def word_digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit digest of every word, in order, and the number of words of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    b = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    inside = ~np.isin(b, np.frombuffer(SPACES.encode(), dtype=np.uint8))
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power = np.full(len(b), _BASE, dtype=np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[b] * power, out=total[1:])
    back = np.full(len(b), _INVERSE, dtype=np.uint64)
    back[0] = 1
    back = np.cumprod(back)
    word = _mixed((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
    stop = np.cumsum(size + 1)
    return word, np.diff(np.concatenate([[0], np.searchsorted(start, stop)]))


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each text, side by side (repeated ones too), and their number per text."""
    word, n = word_digests(texts)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    first = np.cumsum(n) - n
    at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    length = np.repeat(np.minimum(n, words), count)
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(words):
        more = k < length
        out[more] = _mixed(out[more] * np.uint64(0xD6E8FEB86659FD93) + word[at[more] + k])
    return out, count


def signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """MinHash values (16 bits of each) and band keys of each text, and its number of shingles."""
    s, n = shingles(texts)
    sig = np.zeros((len(texts), BANDS * ROWS), dtype=np.uint32)
    some = np.flatnonzero(n)
    if len(some):
        low = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
        at = (np.cumsum(n) - n)[some]
        h = np.empty_like(low)
        for k in range(BANDS * ROWS):
            np.multiply(low, _FACTOR[k], out=h)
            h ^= _SHIFT[k]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            sig[some, k] = np.minimum.reduceat(h, at)
    keys = np.zeros((len(texts), BANDS), dtype=np.uint64)
    for k in range(ROWS):
        keys = _mixed(keys * np.uint64(0xD6E8FEB86659FD93) + sig[:, k::ROWS].astype(np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64))
    return (sig >> np.uint32(8)).astype(np.uint16), keys.astype(np.int64), n


def least_matches(total: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The least number of agreeing values, of ``total``, at which the pair may still reach the threshold."""
    tail = 0.0
    for s in range(total + 1):
        # P(similarity >= t | s of total agree) = P(Binomial(total + 1, t) <= s)
        tail += comb(total + 1, s) * threshold**s * (1 - threshold) ** (total + 1 - s)
        if tail >= tolerance:
            return s
    return total


_LEAST = [(m, least_matches(m)) for m in range(STEP, BANDS * ROWS + 1, STEP)]


def promising(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows survive the pruning."""
    alive = np.arange(len(a))
    same = np.zeros(len(a), dtype=np.int32)
    for m, least in _LEAST:
        same[alive] += (a[alive, m - STEP : m] == b[alive, m - STEP : m]).sum(axis=1, dtype=np.int32)
        alive = alive[same[alive] >= least]
        if not len(alive):
            break
    out = np.zeros(len(a), dtype=bool)
    out[alive] = True
    return out


def _unpacked(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint16).reshape(len(column), BANDS * ROWS)


def texts_table(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(k, v) of each row with an id, and one row per distinct text: v, its least id, values, band keys."""
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).where("k is not null")
    rows = rows.withColumn("v", F.xxhash64("t"))

    def run(batches):
        for batch in batches:
            for a, z in slices(batch["t"], 2_000_000):
                part = batch.iloc[a:z]
                sig, keys, n = signatures(part["t"].tolist())
                out = part[["k", "v"]].reset_index(drop=True)
                out["n"] = n
                out["sig"] = pd.Series([r.tobytes() for r in sig], dtype=object)
                out["bands"] = pd.Series(list(keys), dtype=object)
                yield out

    found = checkpoint(rows.select("k", "v", "t").mapInPandas(run, "k bigint, v bigint, n int, sig binary, bands array<bigint>"))
    members = found.select("k", "v")
    least = members.groupBy("v").agg(F.min("k").alias("rep"))
    return members, found.join(least.withColumnRenamed("rep", "k"), ["k", "v"]).dropDuplicates(["v"]).withColumnRenamed("k", "rep")


def _compare_with_least(buckets: DataFrame, values: DataFrame) -> DataFrame:
    """Edges (a, b): texts of a bucket that may be near the bucket's least text."""
    least = buckets.groupBy("key").agg(F.min("v").alias("b"))
    pairs = buckets.join(least, "key").where("v <> b").select(F.col("v").alias("a"), "b").distinct()
    pairs = pairs.join(values.select(F.col("v").alias("a"), F.col("sig").alias("sig_a")), "a")
    pairs = pairs.join(values.select(F.col("v").alias("b"), F.col("sig").alias("sig_b")), "b")

    def run(batches):
        for batch in batches:
            if len(batch):
                yield batch[promising(_unpacked(batch["sig_a"]), _unpacked(batch["sig_b"]))][["a", "b"]]

    return pairs.select("a", "b", "sig_a", "sig_b").mapInPandas(run, "a bigint, b bigint")


def _groups(batches, keys: list[str]):
    """Whole groups of rows from batches sorted by ``keys``; a group is small by construction."""
    held = None
    for batch in batches:
        batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        k = batch[keys].to_numpy()
        new = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        if len(new):
            for a, z in zip(np.concatenate([[0], new[:-1]]), new, strict=True):
                yield batch.iloc[a:z]
            held = batch.iloc[new[-1] :]
        else:
            held = batch
    if held is not None and len(held):
        yield held


def _compare_rest(buckets: DataFrame, values: DataFrame, group: DataFrame) -> DataFrame:
    """Edges between texts of a bucket that are in different groups so far, bucket by bucket in blocks.

    Texts outside the group of the bucket's least text meet all texts of the bucket; blocks of the
    former and of the latter are paired, so a task sees two blocks however large the bucket is.
    """
    rows = buckets.join(group, "v", "left").withColumn("g", F.coalesce("root", "v")).drop("root")
    main = rows.groupBy("key").agg(F.min(F.struct("v", "g")).alias("m"), F.min("g").alias("g0"), F.max("g").alias("g1"), F.count("*").alias("n")).where("g0 <> g1").select("key", F.col("m.g").alias("main"), "n")
    rows = rows.join(main, "key").withColumn("out", F.col("g") != F.col("main"))
    outside = rows.where("out").groupBy("key").agg(F.count("*").alias("n_out"))
    rows = rows.join(outside, "key").join(values.select("v", "sig"), "v")
    many, few = F.ceil(F.col("n") / BLOCK).cast("int"), F.ceil(F.col("n_out") / BLOCK).cast("int")
    at = lambda n: F.pmod(F.xxhash64("v", F.lit(1)), n).cast("int")
    inner = F.transform(F.sequence(F.lit(0), few - 1), lambda i: F.struct(i.alias("i"), at(many).alias("j"), F.lit(1).alias("side")))
    outer = F.transform(F.sequence(F.lit(0), many - 1), lambda j: F.struct(at(few).alias("i"), j.alias("j"), F.lit(0).alias("side")))
    places = F.concat(inner, F.when(F.col("out"), outer).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>")))
    rows = rows.select("key", "v", "g", "sig", F.explode(places).alias("p")).select("key", "p.i", "p.j", "p.side", "v", "g", "sig")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        for part in _groups(batches, ["key", "i", "j"]):
            sig, v, g, side = _unpacked(part["sig"]), part["v"].to_numpy(), part["g"].to_numpy(), part["side"].to_numpy()
            x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            a, b = np.repeat(x, len(y)), np.tile(y, len(x))
            apart = g[a] != g[b]
            a, b = a[apart], b[apart]
            ok = promising(sig[a], sig[b])
            if ok.any():
                yield pd.DataFrame({"a": v[a[ok]], "b": v[b[ok]]}).drop_duplicates()

    return rows.mapInPandas(run, "a bigint, b bigint").distinct()


def _verify(docs: DataFrame, key: str, text: str, reps: DataFrame, group: DataFrame) -> DataFrame:
    """(kind, a, b): number of links b of text a in a pair of blocks (0), and edges that span the links (1)."""
    sizes = group.groupBy("root").agg(F.count("*").alias("n"))
    wanted = group.join(sizes, "root").join(reps.select("v", "rep"), "v")
    rows = docs.select(F.col(key).cast("bigint").alias("rep"), F.col(text).alias("t"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("v"))
    rows = rows.join(wanted, ["rep", "v"]).dropDuplicates(["v", "rep"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("v", F.lit(2)), blocks).cast("int")
    places = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j"), mine.alias("own")))
    rows = rows.select("root", "v", "t", F.explode(places).alias("p")).select("root", "p.i", "p.j", "p.own", "v", "t")
    rows = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")

    def run(batches):
        for part in _groups(batches, ["root", "i", "j"]):
            v, own = part["v"].to_numpy(), part["own"].to_numpy()
            near = similarities(part["t"].tolist()) >= THRESHOLD - 1e-12
            np.fill_diagonal(near, False)
            if part["i"].iloc[0] != part["j"].iloc[0]:
                near &= own[:, None] != own[None, :]
            links = near.sum(axis=1)
            a = np.flatnonzero(links)
            if len(a):
                x, y = spanning(near)
                yield pd.DataFrame({"kind": np.repeat([0, 1], [len(a), len(x)]), "a": np.concatenate([v[a], v[x]]), "b": np.concatenate([links[a], v[y]])})

    return rows.mapInPandas(run, "kind int, a bigint, b bigint")


def similarities(texts: list[str]) -> np.ndarray:
    """Exact Jaccard similarity of the shingle sets of all pairs of a few texts."""
    s, n = shingles(texts)
    row = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    fresh = np.ones(len(s), dtype=bool)
    fresh[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    s, row = s[fresh], row[fresh]
    size = np.bincount(row, minlength=len(texts)).astype(np.float64)
    _, col, times = np.unique(s, return_inverse=True, return_counts=True)
    kept = times[col] > 1  # a shingle of one text is in no intersection
    _, col = np.unique(col[kept], return_inverse=True)
    row = row[kept]
    shared = np.zeros((len(texts), len(texts)), dtype=np.float32)
    for a in range(0, int(col.max()) + 1 if len(col) else 0, 1 << 14):
        part = (col >= a) & (col < a + (1 << 14))
        m = np.zeros((len(texts), min(1 << 14, int(col.max()) + 1 - a)), dtype=np.float32)
        m[row[part], col[part] - a] = 1
        shared += m @ m.T
    union = size[:, None] + size[None, :] - shared
    return np.divide(shared, union, out=np.zeros_like(union), where=union > 0)


def spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (child, parent) of a forest that connects what a symmetric relation connects."""
    left = near.any(axis=1)
    x, y = [], []
    while left.any():
        front = np.array([np.flatnonzero(left)[0]])
        left[front] = False
        while len(front):
            reach = near[front] & left[None, :]
            new = np.flatnonzero(reach.any(axis=0))
            x.append(new)
            y.append(front[reach[:, new].argmax(axis=0)])
            left[new] = False
            front = new
    return np.concatenate(x), np.concatenate(y)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, v, class_id, chosen, n_copies, n_links) of each row.

    ``class_id`` is the least id of the class; ``chosen`` tells whether this row's text is the one that
    stands for it; ``n_copies`` counts the rows with the same text, this one included, and ``n_links``
    the other distinct texts whose similarity reaches the threshold.
    """
    members, reps = texts_table(docs, key, text)
    reps = checkpoint(reps)
    values = reps.select("v", "sig")
    rows = reps.where("n > 0").select("v", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = checkpoint(rows.join(shared, "key"))
    edges = checkpoint(_compare_with_least(buckets, values))
    group = components(edges)
    more = checkpoint(_compare_rest(buckets, values, group))
    if not more.isEmpty():
        group = components(edges.union(more))
    found = checkpoint(_verify(docs, key, text, reps, group))
    links = found.where("kind = 0").groupBy(F.col("a").alias("v")).agg(F.sum("b").alias("n_links"))
    group = components(found.where("kind = 1").select("a", "b"))
    texts = reps.select("v", "rep").join(group, "v", "left").join(links, "v", "left").withColumn("root", F.coalesce("root", "v"))
    first = texts.groupBy("root").agg(F.min(F.struct("rep", "v")).alias("m")).select("root", F.col("m.rep").alias("class_id"), F.col("m.v").alias("first_v"))
    texts = texts.join(first, "root").select("v", "class_id", (F.col("v") == F.col("first_v")).alias("first"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    copies = members.groupBy("v").agg(F.count("*").alias("n_copies"))
    texts = texts.join(copies, "v")
    out = members.join(texts, "v").select(F.col("k").alias("doc_id"), "v", "class_id", (F.col("first") & (F.col("k") == F.col("class_id"))).alias("chosen"), "n_copies", "n_links")
    lost = docs.where(F.col(key).isNull()).select(F.lit(None).cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("v"), F.lit(None).cast("bigint"), F.lit(True), F.lit(1).cast("bigint"), F.lit(0).cast("bigint"))
    return out.union(lost)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one row per class (that of least id); rows without an id all stay."""
    mine, v = free_name(docs, "_key"), free_name(docs, "_v")
    chosen = near_duplicates(docs, key, text).where("chosen and doc_id is not null").select(F.col("doc_id").alias(mine), F.col("v").alias(v)).distinct()
    rows = docs.withColumn(v, F.xxhash64(F.coalesce(F.col(text), F.lit("")))).withColumn(mine, F.col(key).cast("bigint"))
    kept = rows.join(chosen, [mine, v], "left_semi").dropDuplicates([mine, v])
    return kept.select(*docs.columns).union(docs.where(F.col(key).isNull()))


#: The same result over the table documents by brute force over shared shingles.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents WHERE doc_id IS NOT NULL),
u AS (SELECT t, MIN(doc_id) AS rep, COUNT(*) AS n_copies FROM d GROUP BY t),
w AS (SELECT rep, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM u),
s AS (SELECT DISTINCT rep, CASE WHEN len(w) < 5 THEN list_slice(w, 1, 5) ELSE list_slice(w, i, i + 4) END AS s
      FROM (SELECT rep, w, unnest(range(1, GREATEST(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT rep, COUNT(*) AS n FROM s GROUP BY rep),
p AS (SELECT a.rep AS a, b.rep AS b, COUNT(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.rep <> b.rep GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE c / (x.n + y.n - c)::DOUBLE >= 0.8 - 1e-12),
r(v, low) AS (SELECT rep, rep FROM u UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.v AND r.low < e.b),
c AS (SELECT v, MIN(low) AS class_id FROM r GROUP BY v),
k AS (SELECT a AS v, COUNT(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, c.class_id, u.n_copies, COALESCE(k.n_links, 0) AS n_links
FROM d JOIN u USING (t) JOIN c ON c.v = u.rep LEFT JOIN k ON k.v = u.rep
"""
