"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Rotations are learned on a bounded sample (iterative quantisation: the rotation whose signs lose least),
several from different starts, 64 bits or so each. A code is split into substrings of 16 bits, and every
block of rows has an index per substring: its distinct values and the rows of each. If two codes differ
in at most r bits, some substring differs in at most r // substrings of them (pigeonhole), so probing
all values that near retrieves every code within r; these are compared in full and the rest by the
original vectors in double precision.

All rows are indexed, in blocks by a hash of the id; a block of queries meets a block of rows, and each
such pair gives at most k rows per query, whatever the distances. The radius is what the sample's own
neighbours need (``KEEP`` of them; in the whole table neighbours are nearer). Queries with less than k
found are searched again with the radius of the whole code, which retrieves everything.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components
take no part, nor do rows without an id. Of several rows with one id the least vector counts. Ties go to
the smaller id. Fewer rows than k give all candidates; an empty table gives no rows. Columns other than
those named aren't used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepjudge.llm.common import checkpoint

SAMPLE = 4096  # vectors to learn rotations and radius from
ROTATIONS = 4
BITS = 16  # of a substring
KEEP = 0.985  # of the sample's neighbours lie within the radius
ROW_BLOCK, QUERY_BLOCK = 32_768, 2048


@dataclass
class Codes:
    mean: np.ndarray
    rotations: np.ndarray  # dimensions x bits
    radius: int

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Substrings (uint16) of each vector's code."""
        bits = (x - self.mean) @ self.rotations > 0
        return np.packbits(bits, axis=1).view(np.uint16)


def learn(x: np.ndarray, k: int = 10, seed: int = 5) -> Codes:
    """Rotations and radius from sampled vectors."""
    rng = np.random.default_rng(seed)
    mean = x.mean(axis=0)
    c = x - mean
    d = x.shape[1]
    found = []
    for _ in range(ROTATIONS):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(25):
            u, _, v = np.linalg.svd(np.sign(c @ r).T @ c)
            r = (u @ v).T
        found.append(r)
    rotations = np.hstack(found)
    rotations = np.hstack([rotations, rng.standard_normal((d, -rotations.shape[1] % BITS))])
    codes = Codes(mean, rotations, rotations.shape[1])
    some = x[:512]
    far = np.sqrt(np.maximum(0, (some**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * some @ x.T))
    far[np.arange(len(some)), np.arange(len(some))] = np.inf
    near = np.argsort(far, axis=1)[:, : min(k, max(1, len(x) - 1))]
    own = codes.encode(x)
    apart = np.bitwise_count(own[: len(some), None, :] ^ own[near]).sum(axis=2, dtype=np.int64)
    codes.radius = int(np.ceil(np.quantile(apart, KEEP)))
    return codes


class Index:
    """The rows of a block by the value of each substring of their codes."""

    def __init__(self, code: np.ndarray):
        self.code = code
        self.values = [np.unique(code[:, j], return_inverse=True) for j in range(code.shape[1])]

    def within(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs of all codes within the radius."""
        parts = self.code.shape[1]
        hit = np.zeros((len(code), len(self.code)), dtype=bool)
        for j, (values, row_value) in enumerate(self.values):
            probed = np.bitwise_count(values[None, :] ^ code[:, j, None]) <= radius // parts
            hit |= probed[:, row_value]
        q, r = np.nonzero(hit)
        apart = np.zeros(len(q), dtype=np.int32)
        for j in range(parts):
            apart += np.bitwise_count(code[q, j] ^ self.code[r, j])
        near = apart <= radius
        return q[near], r[near]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _search(rows: DataFrame, queries: DataFrame, codes: Codes, radius: int, k: int, n_rows: int, n_queries: int) -> DataFrame:
    n = max(-(-n_rows // ROW_BLOCK), min(32, -(-n_rows // 256)))
    m = -(-n_queries // QUERY_BLOCK)
    block = lambda c, size: F.pmod(F.xxhash64(c), F.lit(size)).cast("int")
    rows = rows.select("id", "x", block("id", n).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"))
    queries = queries.select("id", "x", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), block("id", m).alias("j"))

    def meet(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(asked):
            x, ids = _matrix(own["x"]), own["id"].to_numpy()
            index = Index(codes.encode(x))
            for a in range(0, len(asked), 64):
                part = asked.iloc[a : a + 64]
                y, mine = _matrix(part["x"]), part["id"].to_numpy()
                q, r = index.within(codes.encode(y), radius)
                other = mine[q] != ids[r]
                q, r = q[other], r[other]
                far = np.concatenate([np.sqrt(((x[r[z : z + 65_536]] - y[q[z : z + 65_536]]) ** 2).sum(axis=1)) for z in range(0, len(q), 65_536)] or [np.zeros(0)])
                order = np.lexsort((ids[r], far, q))
                q, r, far = q[order], r[order], far[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                top = rank < k
                out.append(pd.DataFrame({"query_id": mine[q[top]], "vec_id": ids[r[top]], "score": far[top]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})

    met = rows.groupBy("i", "j").cogroup(queries.groupBy("i", "j")).applyInPandas(meet, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row that ``is_query`` holds for."""
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("x"), is_query.alias("q"))
    rows = rows.where(F.col("id").isNotNull() & F.forall("x", good) & F.exists("x", lambda v: v != 0))
    size = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    empty = rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if size is None:
        return empty
    rows = checkpoint(rows.where(F.size("x") == size["d"]).groupBy("id").agg(F.min("x").alias("x"), F.max("q").alias("q")))
    queries = rows.where("q")
    n_rows, n_queries = rows.count(), queries.count()
    if not n_queries or n_rows < 2:
        return empty
    sample = rows.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(SAMPLE).select("x").collect()
    codes = learn(np.array([r["x"] for r in sample]), k)
    found = checkpoint(_search(rows, queries, codes, codes.radius, k, n_rows, n_queries))
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, n_rows - 1)).select(F.col("query_id").alias("id"))
    short = checkpoint(queries.join(full, "id", "left_anti"))
    n_short = short.count()
    if not n_short:
        return found
    again = _search(rows, short, codes, codes.rotations.shape[1], k, n_rows, n_short)
    return found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").select(*found.columns).union(again)
