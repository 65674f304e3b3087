"""Runs of words that repeat with a period, by scale-tiled search.

A run is a stretch of words with smallest period q (words q apart are equal) and length of at least
max(6, 4 q) that no neighbour extends. Its matches (i with word[i] = word[i + q]) form an interval of at least
three periods, and that interval is what is searched and stitched:

1. Tiles. Every document is dealt into overlapping tiles per octave of periods [2^k, 2^(k+1)): a core and a halo
   of six times 2^k words, so that some tile sees two whole periods of each run's matches from their first on.
   The octaves below ``LOW`` share their tiles, since these are long enough for all of them.
2. Boundaries. Within a tile boundaries lie 2^k words apart. At a boundary c the Z-function (for each period q
   of the octave, how far the words from c on equal those from c + q on) is read off prefix digests, forwards and
   backwards, for the periods whose first words agree. Matches over a whole period with a primitive root (no
   divisor of q is a period) give a fragment; digests only propose, the words themselves confirm.
3. Stitching. A fragment that ends within its tile is as long as it can be and is kept if it makes a run. Those
   cut by a tile's edge continue in the next tile: fragments are shuffled by document and period, and those that
   touch or overlap become one.

A primitive root and four periods make q the smallest period. Only fragments and the documents that hold one
travel; all others are finished where they are read. A document's tiles are slices of one array in the task that
holds its text, so a very long text costs that task n log n steps; a run costs the shuffle one row per tile.

A null text counts as empty and has no runs, as has an empty one. ``planted`` repeats words by id before the
search (the query's rule); rows without an id aren't changed by it. Repeated rows are searched one by one and
give equal results. Ties of the largest exponent go to the smallest start, then period. An empty table gives no
rows. Further columns aren't used.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepjudge.llm.common import checkpoint, slices

LOW = 9  # periods below 2^LOW share tiles
CORE = 8192  # words of a tile's core there; above, 16 times 2^k
PRIMES = (2**31 - 1, 2**31 - 19)
BASES = (1_000_003, 998_244_353)
EMPTY = hashlib.sha256(b"").hexdigest()


def planted(key: int | None, words: list) -> list:
    """The query's rule: in every tenth document the words from some place on repeat the first few there."""
    h = -1 if key is None else zlib.crc32(str(int(key)).encode())
    n, g = len(words), h // 10
    if h < 0 or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    repeated = words[a : a + p]
    return words[:a] + (repeated * (-(-(n - a) // max(len(repeated), 1))))[: n - a]


class Stream:
    """Words as numbers, tiles one behind the other, each followed by a number of its own; with prefix digests."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.n = len(x)
        self.power, self.sums = [], []
        for p, base in zip(PRIMES, BASES, strict=True):
            power = np.ones(max(self.n, 2), dtype=np.uint64)
            done, step = 1, base
            while done < len(power):  # powers by doubling: base^(done + i) = base^done * base^i
                more = min(done, len(power) - done)
                power[done : done + more] = power[:more] * np.uint64(step) % np.uint64(p)
                step, done = step * step % p, done + more
            value = (x.astype(np.uint64) * np.uint64(2_654_435_761 % p) + np.uint64(97)) % np.uint64(p)
            self.sums.append(np.concatenate([[0], np.cumsum(value * power[: self.n] % np.uint64(p)) % np.uint64(p)]).astype(np.uint64))
            self.power.append(power)

    def same(self, a: np.ndarray, q: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Whether the m words from a on have the digest of those from a + q on."""
        out = np.ones(len(a), dtype=bool)
        for p, power, sums in zip(PRIMES, self.power, self.sums, strict=True):
            p = np.uint64(p)
            left = (sums[a + m] + p - sums[a]) % p * power[q] % p
            out &= left == (sums[a + q + m] + p - sums[a + q]) % p
        return out

    def reach(self, c: np.ndarray, q: np.ndarray, back: bool) -> np.ndarray:
        """The Z values: how many words from c on (``back``: before c) equal those q further on."""
        low, high = np.zeros(len(c), dtype=np.int64), c.copy() if back else self.n - c - q
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = self.same(c - mid if back else c, q, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low


def _primitive(s: Stream, c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the q words from c on are no repetition: no prime divisor of q shortens the period."""
    keep, rest, d = np.ones(len(q), dtype=bool), q.copy(), 2
    while (rest > 1).any():
        prime = np.where(rest % d == 0, d, np.where((d * d > rest) & (rest > 1), rest, 0))  # what is left is prime
        hit = np.flatnonzero((prime > 0) & keep)
        if len(hit):
            shift = q[hit] // prime[hit]
            keep[hit] = ~s.same(c[hit], shift, q[hit] - shift)
        rest = np.where(prime == rest, 1, rest)
        while (again := (prime > 1) & (rest > 1) & (rest % np.maximum(prime, 1) == 0)).any():
            rest = np.where(again, rest // np.maximum(prime, 1), rest)
        d += 1
    return keep


def solve(s: Stream, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, first, last + 1) of the matches around the boundaries of octave k that hold two periods or more."""
    width, x = 1 << k, s.x
    none = (np.zeros(0, dtype=np.int64),) * 3
    if s.n < 3 * width:
        return none
    grid = np.concatenate([x, np.full(-s.n % width, -1, dtype=x.dtype)]).reshape(-1, width)
    block, offset = np.nonzero(grid[1:] == grid[:-1, :1])
    c, q = block.astype(np.int64) * width, offset.astype(np.int64) + width
    fits = c + 2 * q <= s.n
    c, q = c[fits], q[fits]
    for probe in (lambda q: q - 1, lambda q: q // 2):  # most are told apart by one more word
        same = x[c + probe(q)] == x[c + probe(q) + q]
        c, q = c[same], q[same]
    whole = s.same(c, q, q)
    c, q = c[whole], q[whole]
    root = _primitive(s, c, q)
    c, q = c[root], q[root]
    first, last = c - s.reach(c, q, True), c + s.reach(c, q, False)
    long = last - first >= 2 * q
    q, first, last, c = q[long], first[long], last[long], c[long]
    _, one = np.unique(np.stack([q, first]), axis=1, return_index=True)
    out = []
    for i in one:  # the words themselves: digests that collide would only make a fragment too long
        a, b, p = int(first[i]), int(last[i]), int(q[i])
        wrong = np.flatnonzero(x[a:b] != x[a + p : b + p])
        if len(wrong):
            at = np.searchsorted(wrong, c[i] - a)
            a, b = a + (int(wrong[at - 1]) + 1 if at else 0), a + int(wrong[at]) if at < len(wrong) else b
        if b - a >= 2 * p:
            out.append((p, a, b))
    return tuple(np.array(v, dtype=np.int64) for v in zip(*out, strict=True)) if out else none


def tiles(n: int, k: int) -> list[tuple[int, int]]:
    """The tiles (start, end) of n words for the octaves up to k below ``LOW`` together, or for octave k."""
    scale = max(k, LOW - 1)
    core, halo = (CORE if k < LOW else 16 << k), 6 << scale
    starts = range(0, max(n - halo, 1), core)
    return [(a, min(a + core + halo, n)) for a in starts]


def fragments(docs: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Per document (numbers of its words) the fragments (period, first, last + 1) of its tiles."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    longest = max((len(d) for d in docs), default=0)
    octaves = [k for k in range(max(longest // 4, 0).bit_length()) if 4 << k <= longest]
    for band in ([[k for k in octaves if k < LOW]] if octaves else []) + [[k] for k in octaves if k >= LOW]:
        if not band:
            continue
        where = [(i, a, b) for i, d in enumerate(docs) if len(d) >= max(6, 4 << band[0]) for a, b in tiles(len(d), band[0])]
        if not where:
            continue
        # a number of its own behind each tile: no match reaches across
        parts = [p for t, (i, a, b) in enumerate(where) for p in (docs[i][a:b], [-2 - t])]
        stream = Stream(np.concatenate(parts).astype(np.int64) + len(where) + 2)
        begin = np.concatenate([[0], np.cumsum([b - a + 1 for _, a, b in where])])
        for k in band:
            q, first, last = solve(stream, k)
            tile = np.searchsorted(begin, first, side="right") - 1
            for p, lo, hi, t in zip(q.tolist(), (first - begin[tile]).tolist(), (last - begin[tile]).tolist(), tile.tolist(), strict=True):
                i, a, b = where[t]
                cut = (lo == 0 and a > 0) or (a + hi + p == b and b < len(docs[i]))
                if cut or hi - lo + p >= max(6, 4 * p):
                    out[i].append((p, a + lo, a + hi))
    return out


def searched(docs: DataFrame, key: str, text: str, change: Callable | None) -> DataFrame:
    """One row per document: its fragments and words where it has any, else the digest of its words."""

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch["t"]):
                part = batch.iloc[lo:hi]
                words = [(t or "").encode().split() for t in part["t"]]  # bytes split at the six white characters alone
                if change:
                    words = [change(None if missing else k, w) for k, missing, w in zip(part["id"], part["id"].isna(), words, strict=True)]
                flat = np.empty(sum(map(len, words)), dtype=object)
                flat[:] = [w for ws in words for w in ws]
                ids = pd.factorize(flat)[0].astype(np.int64)
                ends = np.cumsum([len(w) for w in words])
                found = fragments(np.split(ids, ends[:-1]))
                yield pd.DataFrame(
                    {
                        "row": part["row"].to_numpy(),
                        "doc_id": part["id"].to_numpy(),
                        "words": [b" ".join(w).decode() if f else None for w, f in zip(words, found, strict=True)],
                        "digest": [None if f else hashlib.sha256(b" ".join(w)).hexdigest() for w, f in zip(words, found, strict=True)],
                        "fragments": [[{"period": p, "first": a, "last": b} for p, a, b in f] for f in found],
                    }
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"))
    rows = rows.withColumn("id", F.col("id").cast("string"))  # ids stay exact where some are null
    out = rows.mapInPandas(run, "row bigint, doc_id string, words string, digest string, fragments array<struct<period:bigint,first:bigint,last:bigint>>")
    return checkpoint(out.withColumn("doc_id", F.col("doc_id").cast("bigint")))


def stitched(found: DataFrame) -> DataFrame:
    """(row, start, length, period) of the runs: fragments of one document and period that touch become one."""
    parts = found.select("row", F.explode("fragments").alias("f")).select("row", "f.*")
    by = Window.partitionBy("row", "period").orderBy("first", "last")
    before = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("new", F.coalesce(F.col("first") > before, F.lit(True)).cast("int"))
    parts = parts.withColumn("part", F.sum("new").over(by))
    runs = parts.groupBy("row", "period", "part").agg(F.min("first").alias("start"), F.max("last").alias("last"))
    length = F.col("last") - F.col("start") + F.col("period")
    return runs.select("row", "start", length.alias("length"), "period").where(F.col("length") >= F.greatest(F.lit(6), F.col("period") * 4))


def _collapsed(words: Column, runs: Column) -> Column:
    """Per document the run of greatest exponent, the digest of all runs and that of the words kept."""

    @F.pandas_udf("start bigint, length bigint, period bigint, runs_sha256 string, collapsed_sha256 string")
    def collapse(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
        rows = []
        for text, listed in zip(texts, lists, strict=True):
            of = [(int(r["start"]), int(r["length"]), int(r["period"])) for r in listed]
            best, kept = None, text.split(" ")
            drop = np.zeros(len(kept), dtype=bool)
            for a, n, q in of:
                drop[a + q : a + n] = True
                if best is None or n * best[2] > best[1] * q:  # greater length / period; sorted, so ties keep the first
                    best = (a, n, q)
            left = " ".join([w for w, d in zip(kept, drop.tolist(), strict=True) if not d])
            lines = "".join(f"{a},{n},{q}\n" for a, n, q in of)
            rows.append((*(best or (None,) * 3), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest()))
        out = pd.DataFrame(rows, columns=["start", "length", "period", "runs_sha256", "collapsed_sha256"])
        return out.astype({c: "Int64" for c in ("start", "length", "period")})

    return collapse(words, runs)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", change: Callable | None = None) -> DataFrame:
    """(row, doc_id, start, length, period): every run of every document; ``row`` tells repeated rows apart."""
    found = searched(docs, key, text, change)
    return stitched(found).join(found.select("row", "doc_id"), "row").select("row", "doc_id", "start", "length", "period")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", change: Callable | None = None) -> DataFrame:
    """Per document the number of runs, the run of greatest exponent and the digests of runs and kept words."""
    found = searched(docs, key, text, change)
    runs = stitched(found).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    held = found.where("words IS NOT NULL").select("row", "doc_id", "words").join(runs, "row", "left")
    none = F.array().cast("array<struct<start:bigint,length:bigint,period:bigint>>")
    held = held.withColumn("runs", F.coalesce("runs", F.transform(F.sort_array(none), lambda r: r)))
    held = held.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), _collapsed(F.col("words"), F.col("runs")).alias("o"))
    ratio = F.expr("o.length * 1000 div o.period").cast("bigint")
    held = held.select("doc_id", "n_runs", "o.start", "o.length", "o.period", ratio.alias("exponent_milli"), "o.runs_sha256", "o.collapsed_sha256")
    null = F.lit(None).cast("bigint")
    free = found.where("words IS NULL").select(
        "doc_id", F.lit(0).cast("bigint").alias("n_runs"), *[null.alias(c) for c in ("start", "length", "period", "exponent_milli")], F.lit(EMPTY).alias("runs_sha256"), F.col("digest").alias("collapsed_sha256")
    )
    return free.unionByName(held)
