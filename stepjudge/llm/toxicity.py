"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two words counts the common subsequences of three characters (word ends included), each
weighted by ``DECAY`` to the power of its span in either word, normalised to 1 for equal words. Gaps
cost little, so ``id-iot``, ``idxiot`` or ``i d i o t`` stay near ``idiot``. Landmarks are words of the
labelled sentences; the kernel to them, whitened (Nyström), is what the linear machine sees. Because
the machine is linear in the kernel and the kernel in its subsequences, a trained machine is one weight
per subsequence: a word is scored exactly without visiting the landmarks.

A text is a bag of spans (its distinct words without other characters, the letter parts of compounds,
and runs of single characters); it is toxic if some span is. Learning is therefore over words: those
that label 1 favours by a likelihood ratio against words of documents with label 0, hard negatives
added once. The largest span values, their number and the text's length give a calibrated probability.

Learning takes at most ``MAX_ROWS`` labelled documents (smallest seeded hash first), whatever the table.
A null or empty text has no span and gets the probability of a text without one. Several labels of one
id count as their largest; null labels and null ids teach nothing. With one class only (or no labels),
every text scores that class's share (0 without labels). Rows are scored one by one, so repeated rows
get the same score; columns other than those named aren't used.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepjudge.llm.common import checkpoint, free_name, slices

MAX_ROWS = 8000  # labelled documents to learn from
MAX_POSITIVE, MAX_POOL = 2000, 100_000  # words of either label brought to the driver
LANDMARKS = 256
DECAY = 0.6
ORDER = 3  # characters of a subsequence
WIDTH = 24  # longer words are seen through windows of this width
CODES = 64
PART = 4000  # words that the driver handles at once
RATIO = 12.0  # log-likelihood ratio from which a word teaches label 1
TABLE_WORDS = 300_000  # distinct words a task remembers
TOXIC = 0.7

_OTHER = re.compile(r"[\W\d_]+")
_SINGLES = re.compile(r"(?<!\S)\S(?:[ \t]\S){3,}(?!\S)")
FEATURES = 4


def spans(word: str) -> list[str]:
    """A token's letters joined, and its letter parts where there are several."""
    if word.isalpha():
        return [word]
    parts = [p for p in _OTHER.split(word) if p]
    return [] if not parts else parts if len(parts) == 1 else ["".join(parts), *[p for p in parts if len(p) > 3]]


def tokens(text: str | None) -> set[str]:
    """Distinct lower-case tokens; runs of single characters count as one token more."""
    if not text:
        return set()
    low = text.lower()
    return set(low.split()) | {m.group(0) for m in _SINGLES.finditer(low)}


def _code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 29 + ord(c) % 35


def _encoded(word: str) -> np.ndarray:
    return np.array([27, *map(_code, word), 28], dtype=np.int32)


def _windows(word: str) -> list[np.ndarray]:
    x = _encoded(word)
    return [x] if len(x) <= WIDTH else [x[i : i + WIDTH] for i in range(0, len(x) - WIDTH // 2, WIDTH // 2)]


def subsequences(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For equally long words (rows): the code of every subsequence, and the weight of its span."""
    at = np.array(list(combinations(range(x.shape[1]), ORDER)), dtype=np.int64).reshape(-1, ORDER)
    code = np.zeros((len(x), len(at)), dtype=np.int64)
    for k in range(ORDER):
        code = code * CODES + x[:, at[:, k]]
    return code, (DECAY ** (at[:, -1] - at[:, 0] + 1)).astype(np.float32) if len(at) else np.zeros(0, dtype=np.float32)


def self_kernel(x: np.ndarray) -> np.ndarray:
    """The kernel of each row with itself, by the recursion over prefixes."""
    w, n = x.shape
    match = np.ascontiguousarray((x[:, :, None] == x[:, None, :]).transpose(1, 2, 0)).astype(np.float32) * np.float32(DECAY**2)
    ending = match
    for _ in range(ORDER - 1):
        upto = np.zeros((n + 1, n + 1, w), dtype=np.float32)
        for i in range(n):
            for j in range(n):
                upto[i + 1, j + 1] = ending[i, j] + DECAY * (upto[i, j + 1] + upto[i + 1, j]) - DECAY**2 * upto[i, j]
        ending = match * upto[:n, :n]
    return ending.sum(axis=(0, 1))


def _by_length(words: list[str], whole: bool):
    """Words of one length at a time: their numbers and their codes. ``whole``: every window of long ones."""
    groups: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, w in enumerate(words):
        for x in _windows(w) if whole else _windows(w)[:1]:
            groups.setdefault(len(x), []).append((i, x))
    for n, rows in groups.items():
        step = max(1, 1_500_000 // max(n * n, n * (n - 1) * (n - 2) // 6))
        for a in range(0, len(rows) if n >= ORDER else 0, step):
            yield np.array([i for i, _ in rows[a : a + step]]), np.stack([r for _, r in rows[a : a + step]])


@dataclass
class Landmarks:
    """Normalised subsequence weights of a few words: a row for each subsequence that occurs in them."""

    row: np.ndarray  # of each subsequence; 0: in none of them
    weight: np.ndarray  # rows x words; row 0 is zero

    @staticmethod
    def of(words: list[str]) -> Landmarks:
        parts = [(at, *subsequences(x)) for at, x in _by_length(words, False)]
        seen = np.unique(np.concatenate([code.ravel() for _, code, _ in parts]))
        row = np.zeros(CODES**ORDER, dtype=np.int32)
        row[seen] = np.arange(1, len(seen) + 1)
        out = np.zeros((len(seen) + 1, len(words)), dtype=np.float32)
        for at, code, weight in parts:
            np.add.at(out, (row[code], at[:, None]), np.broadcast_to(weight, code.shape))
        out /= np.maximum(np.linalg.norm(out, axis=0, keepdims=True), 1e-12)
        return Landmarks(row, out)

    def combined(self, factor: np.ndarray) -> np.ndarray:
        """One weight per subsequence: the landmarks' weights, each times its factor."""
        return (self.weight @ factor).astype(np.float32)[self.row]


def kernel(words: list[str], landmarks: Landmarks) -> np.ndarray:
    """Normalised kernel of each word (its first window) to the landmarks."""
    out = np.zeros((len(words), landmarks.weight.shape[1]), dtype=np.float32)
    for at, x in _by_length(words, False):
        code, weight = subsequences(x)
        row = landmarks.row[code]
        norm = np.sqrt(np.maximum(self_kernel(x), 1e-12))
        step = max(1, 4_000_000 // max(1, code.shape[1] * out.shape[1]))
        for a in range(0, len(x), step):
            out[at[a : a + step]] = np.einsum("wsl,s->wl", landmarks.weight[row[a : a + step]], weight) / norm[a : a + step, None]
    return out


@dataclass
class Machine:
    weight: np.ndarray  # of each subsequence
    bias: float
    calibration: np.ndarray  # of the features and 1

    def values(self, words: list[str]) -> np.ndarray:
        """The decision value of each word (its largest over windows)."""
        out = np.full(len(words), self.bias, dtype=np.float64)
        seen = np.full(len(words), -np.inf)
        for at, x in _by_length(words, True):
            code, weight = subsequences(x)
            value = self.weight[code] @ weight / np.sqrt(np.maximum(self_kernel(x), 1e-12)) + self.bias
            np.maximum.at(seen, at, value)
        return np.where(np.isfinite(seen), seen, out)

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.calibration[:-1] + self.calibration[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Reader:
    """Text features with a memory of word values."""

    def __init__(self, machine: Machine):
        self.machine, self.value = machine, {}

    def features(self, texts: list[str | None]) -> np.ndarray:
        bags = [tokens(t) for t in texts]
        new = set().union(*bags) - self.value.keys()
        if len(self.value) + len(new) > TABLE_WORDS:
            self.value, new = {}, set().union(*bags)
        parts = {t: spans(t) for t in new}
        words = list({w for p in parts.values() for w in p})
        value = dict(zip(words, self.machine.values(words).tolist(), strict=True))
        for t, p in parts.items():
            self.value[t] = max(map(value.__getitem__, p), default=-1.5)
        out = np.zeros((len(texts), FEATURES))
        for i, bag in enumerate(bags):
            v = np.fromiter(map(self.value.__getitem__, bag), dtype=np.float64, count=len(bag))
            top = np.sort(np.concatenate([v, [-1.5] * 3]) if len(v) < 3 else np.partition(v, len(v) - 3)[-3:])[-3:]
            out[i] = (top[-1], top.mean(), np.log1p((v > 0).sum()), np.log1p(len(v)))
        return out


def features(text: str | Column, machine: Machine) -> Column:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(machine)
        for texts in batches:
            out = [f for a, b in slices(texts) for f in reader.features(texts.iloc[a:b].tolist()).tolist()]
            yield pd.Series(out, dtype=object)

    return run(text)


def score(text: str | Column, machine: Machine) -> Column:
    """The probability of label 1."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(machine)
        for texts in batches:
            parts = [machine.probability(reader.features(texts.iloc[a:b].tolist())) for a, b in slices(texts)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return run(text)


def _fit_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 1000, cost: float = 20_000.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    weight = weight / weight.sum()
    for side in (1, -1):
        weight[y == side] *= 0.5 / max(weight[y == side].sum(), 1e-12)
    keep = np.append(np.ones(x.shape[1] - 1), 0.0) / cost
    size = 2 * np.linalg.eigvalsh(x.T @ (x * weight[:, None]))[-1] + keep.max()
    w, look, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ look))
        step = look - (keep * look - 2 * x.T @ (weight * slack * y)) / size
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = step + (t - 1) / t2 * (step - w), step, t2
    return w[:-1], w[-1]


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled texts: (text, y). The bound makes the labels' side safe to broadcast."""
    some = (
        labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).dropna().groupBy("k").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("k"), "k").limit(rows)
    )
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    return checkpoint(texts.join(F.broadcast(some), "k").select("text", "y"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n1, n0): documents of either label that hold the word."""

    def count(batches):
        n: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for t, y in zip(batch["text"], batch["y"], strict=True):
                n[int(y > 0)].update({w for token in tokens(t) for w in spans(token)})
        words = list(n[0].keys() | n[1].keys())
        yield pd.DataFrame({"word": pd.Series(words, dtype=object), "n1": [n[1][w] for w in words], "n0": [n[0][w] for w in words]})

    return rows.mapInPandas(count, "word string, n1 bigint, n0 bigint").groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = MAX_ROWS) -> Machine:
    """``labels``: only those to learn from."""
    sample = labelled(docs, labels, key, text, label, rows)
    n = {bool(r["y"]): r["n"] for r in sample.groupBy((F.col("y") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        share = 30.0 if n.get(True) else -30.0
        return Machine(np.zeros(CODES**ORDER, dtype=np.float32), -1.0, np.array([0.0] * FEATURES + [share]))
    counts = checkpoint(word_counts(sample))
    share1, share0 = (F.col("n1") + 0.5) / (n[True] + 1), (F.col("n0") + 0.5) / (n[False] + 1)
    both = (F.col("n1") + F.col("n0") + 1) / (n[True] + n[False] + 2)
    ratio = 2 * (F.col("n1") * F.log(share1 / both) + F.col("n0") * F.log(share0 / both))
    toxic = (share1 > 4 * share0) & (F.col("n1") >= 2) & (ratio >= RATIO)
    counts = counts.withColumn("ratio", ratio).withColumn("toxic", toxic)
    pos = counts.where("toxic").orderBy(F.desc("ratio"), "word").limit(MAX_POSITIVE).select("word", "n1", "ratio").toPandas()
    pool = counts.where("not toxic and n0 > 0").orderBy(F.xxhash64("word"), "word").limit(MAX_POOL).select("word", "n0").toPandas()
    common = counts.where("not toxic and n0 > 0").orderBy(F.desc("n0"), "word").limit(4000).select("word", "n0").toPandas()
    if not len(pos) or not len(common):
        machine = Machine(np.zeros(CODES**ORDER, dtype=np.float32), -1.0, np.zeros(FEATURES + 1))
    else:
        machine = _words_machine(pos, common, pool)
    found = sample.select(features("text", machine).alias("f"), "y").toPandas()
    x, y = np.array(found["f"].tolist()), (found["y"].to_numpy() > 0).astype(float)
    machine.calibration = _fit_logistic(x, y)
    return machine


def spoiled(words: list[str], seed: int = 7) -> list[str]:
    """Each word with a random letter inserted at a random inner place, and with a letter doubled."""
    rng = np.random.default_rng(seed)
    out = []
    for w in words:
        if len(w) >= 4:
            i, j = rng.integers(1, len(w), 2)
            out += [w[:i] + chr(97 + rng.integers(26)) + w[i:], w[:j] + w[j - 1] + w[j:]]
    return out


def _words_machine(pos: pd.DataFrame, common: pd.DataFrame, pool: pd.DataFrame) -> Machine:
    half = LANDMARKS // 2
    landmarks = pos["word"].tolist()[:half] + common["word"].tolist()[:: max(1, len(common) // half)][:half]
    base = Landmarks.of(landmarks)
    values, vectors = np.linalg.eigh((base.weight.T @ base.weight).astype(np.float64))
    kept = values > 1e-6 * values.max()
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    negative = pd.concat([common, pool.iloc[:6000]]).drop_duplicates("word")
    strong = pos[pos["ratio"] >= 2 * RATIO]  # words that surely insult are learned with inserted characters too
    close = pd.DataFrame({"word": pd.Series([v for _ in range(3) for v in spoiled(strong["word"].tolist(), 7 + _)], dtype=object)})
    close["n1"] = pos["n1"].median()
    pos = pd.concat([pos, close], ignore_index=True).drop_duplicates("word")
    machine = None
    for last in (False, True):
        words = pos["word"].tolist() + negative["word"].tolist()
        y = np.array([1.0] * len(pos) + [-1.0] * len(negative))
        weight = np.sqrt(np.concatenate([pos["n1"].to_numpy(), negative["n0"].to_numpy()]).astype(float))
        seen = np.concatenate([kernel(words[a : a + PART], base) @ whiten for a in range(0, len(words), PART)])
        w, bias = _fit_machine(seen, y, weight)
        machine = Machine(base.combined(whiten @ w), float(bias), np.zeros(FEATURES + 1))
        if not last:  # the pool's words that come out highest are the hard negatives
            value = np.concatenate([machine.values(pool["word"].iloc[a : a + PART].tolist()) for a in range(0, len(pool), PART)])
            hard = pool.iloc[np.argsort(-value, kind="stable")[:3000]]
            negative = pd.concat([negative, hard]).drop_duplicates("word")
    return machine
