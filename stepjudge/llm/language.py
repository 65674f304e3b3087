"""Language identification as a mixture: each document holds unknown proportions of languages.

Learning counts hashed byte trigrams of letters per language over all labelled documents (a Spark
aggregation to at most languages x ``BUCKETS`` rows). For a document, expectation-maximisation
estimates the proportions from the trigram likelihoods of its segments; the language set is the one
with the best likelihood less a penalty per further language, and the prediction is the set's largest.

A null text, or one without a letter, gives ``und`` and score 0. Texts of one letter are scored from
their single trigram. Ties go to the smaller language name. Nothing learned (an empty table): ``und``.
Repeated rows are learned and predicted each on their own; columns other than those named aren't used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepjudge.llm.common import slices

BUCKETS = 1 << 15
SEGMENT = 48  # trigrams that share a language
STEPS = 12  # of expectation-maximisation
PENALTY = 4.0  # of the logarithm of a document's segments, for each further language
UNDETERMINED = "und"

_KEEP = np.full(256, 32, dtype=np.uint8)  # everything but letters counts as a space
for _b in range(256):
    if chr(_b).isascii() and chr(_b).isalpha() or _b >= 0x80:
        _KEEP[_b] = _b


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram that holds a letter, and the number of them per text."""
    raw = [f" {t.lower()} ".encode("utf-8", "surrogatepass") for t in texts]
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    b = _KEEP[np.frombuffer(b"".join(raw), dtype=np.uint8)].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(len(raw), dtype=np.int64)
    ends = np.cumsum(size)
    ok = np.ones(len(b) - 2, dtype=bool)
    for k in (1, 2):  # a trigram doesn't cross from one text to the next
        cut = ends[:-1] - k
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    blank = b == 32
    ok &= ~((blank[:-2] & blank[1:-1]) | (blank[1:-1] & blank[2:]))
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)
    row = np.repeat(np.arange(len(raw)), size)[:-2][ok]
    return bucket[ok], np.bincount(row, minlength=len(raw))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, bucket, n): trigram counts over all given documents with a text and a language."""

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for frame in batches:
            for name, part in frame.groupby("lang"):
                mine = held.setdefault(name, np.zeros(BUCKETS, dtype=np.int64))
                for a, b in slices(part["text"]):
                    mine += np.bincount(_trigrams(part["text"].iloc[a:b].tolist())[0], minlength=BUCKETS)
        for name, n in held.items():
            some = np.flatnonzero(n)
            yield pd.DataFrame({"lang": pd.Series([name] * len(some), dtype=object), "bucket": some.astype(np.int32), "n": n[some]})

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    return rows.mapInPandas(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def weights(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names, and log probability by bucket and language. Bounded: languages x BUCKETS numbers."""
    found = counts.toPandas()
    names = sorted(found["lang"].unique())
    n = np.zeros((BUCKETS, len(names)))
    col = {name: i for i, name in enumerate(names)}
    n[found["bucket"].to_numpy(dtype=np.int64), found["lang"].map(col).to_numpy(dtype=np.int64)] = found["n"]
    p = n + 0.5
    return names, np.log(p / p.sum(axis=0)).astype(np.float32)


def _mixture(ll: np.ndarray, row: np.ndarray, n_rows: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood of each row, over the languages allowed for it."""
    theta = allowed / allowed.sum(axis=1, keepdims=True)
    top = ll.max(axis=1, keepdims=True)
    p = np.exp(ll - top)
    seg = np.bincount(row, minlength=n_rows).clip(1)[:, None]
    for _ in range(STEPS):
        r = theta[row] * p
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
        theta = np.stack([np.bincount(row, weights=r[:, k], minlength=n_rows) for k in range(ll.shape[1])], axis=1) / seg
        theta = np.where(allowed > 0, theta + 1e-9, 0)
        theta /= theta.sum(axis=1, keepdims=True)
    like = np.log(np.maximum((theta[row] * p).sum(axis=1), 1e-300)) + top[:, 0]
    return theta, np.bincount(row, weights=like, minlength=n_rows)


def infer(texts: list[str], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: proportions over all languages, the chosen set as a mask, and its number of trigrams."""
    bucket, size = _trigrams(texts)
    n, langs = len(texts), logp.shape[1]
    doc = np.repeat(np.arange(n), size)
    within = np.arange(len(bucket)) - np.repeat(np.cumsum(size) - size, size)
    fresh = within % SEGMENT == 0
    if not len(bucket):
        return np.full((n, langs), 1 / langs), np.ones((n, langs), dtype=bool), size
    ll = np.add.reduceat(logp[bucket], np.flatnonzero(fresh), axis=0).astype(np.float64)
    row = doc[fresh]
    theta, _ = _mixture(ll, row, n, np.ones((n, langs)))
    order = np.argsort(-theta, axis=1, kind="stable")
    segments = np.bincount(row, minlength=n)
    best, chosen = np.full(n, -np.inf), np.zeros((n, langs), dtype=bool)
    most = np.bincount(row, weights=ll.max(axis=1), minlength=n)  # no set's likelihood is higher
    for k in range(1, langs + 1):
        penalty = PENALTY * (k - 1) * np.log(segments + 1.0)
        some = np.flatnonzero(most - penalty > best)  # of the others, no set of k or more can be better
        if not len(some):
            break
        at = np.full(n, -1)
        at[some] = np.arange(len(some))
        mine = at[row] >= 0
        allowed = np.zeros((len(some), langs))
        np.put_along_axis(allowed, order[some, :k], 1.0, axis=1)
        _, like = _mixture(ll[mine], at[row[mine]], len(some), allowed)
        value = like - penalty[some]
        better = value > best[some]
        best[some] = np.where(better, value, best[some])
        chosen[some[better]] = allowed[better] > 0
    return theta, chosen, size


def predict(text: str | Column, names: list[str], logp: np.ndarray) -> Column:
    """Struct lang_pred, score (the language's share), langs (the chosen set, largest share first)."""

    @F.pandas_udf("struct<lang_pred:string,score:double,langs:array<string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for a, b in slices(texts):
                part = [t or "" for t in texts.iloc[a:b]]
                if not names:
                    out += [(UNDETERMINED, 0.0, [])] * len(part)
                    continue
                theta, chosen, _ = infer(part, logp)
                share = np.where(chosen, theta, -1)
                first = share.argmax(axis=1)
                for i, t in enumerate(part):
                    if not any(map(str.isalpha, t)):
                        out.append((UNDETERMINED, 0.0, []))
                        continue
                    ranked = sorted(np.flatnonzero(chosen[i]), key=lambda j: (-share[i, j], j))
                    out.append((names[first[i]], float(min(1.0, theta[i, first[i]])), [names[j] for j in ranked]))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "langs"], dtype=object)

    return run(text)
