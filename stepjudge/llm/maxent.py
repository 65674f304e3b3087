"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

P(word | history) = P(class | history) P(word | class). The most frequent tokens are classes of their
own, every other token falls into the class of a hash of its last two bytes; inside a class a word has
its smoothed share of the training tokens, with one place for all unseen words. The class is predicted
by a softmax over weights of four features: a bias, the class before (n-gram), the class two before
(skip) and a hash of both. So the probabilities of all words and the unseen place sum to 1.

Token counts cover all training documents. The softmax is trained on the counts of (history, class),
summed over all training documents too: each step sends the weights to the partitions of that table,
and adds up their gradients (a table of at most features x classes numbers) by feature.

Scoring reads texts in batches as sparse arrays of class numbers. A task holds the ``HEAD`` most
frequent tokens; the rest of a text's tokens meet their counts in a join by token.

Tokens: words between white space with A-Z in lower case, then one end. A null text counts as empty and
has the end alone. Without training documents all counts are 0 and classes are equally likely. Every row
is scored on its own (repeated rows, or a null id, too); null ids are never learned from, and columns
other than those named aren't used.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepjudge.llm.common import checkpoint

SINGLES, SUFFIXES = 80, 48
CLASSES = SINGLES + SUFFIXES
SYMBOLS = CLASSES + 1  # the last stands for the time before the text
HASHED = 4096
HEAD = 1 << 17
FLUSH = 300_000  # distinct tokens a task counts before it passes them on
STEPS = 8
END = b""


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split() + [END]


def suffix_class(token: bytes) -> int:
    return SINGLES + zlib.crc32(token[-2:]) % SUFFIXES


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, cls, c): how often each token occurs, and the class of its ending."""

    def rows(n: Counter) -> pd.DataFrame:
        keys = list(n)
        return pd.DataFrame({"token": pd.Series(keys, dtype=object), "cls": [suffix_class(k) for k in keys], "c": list(n.values())})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for batch in batches:
            for t in batch["text"]:
                n.update(words(t))
                if len(n) > FLUSH:
                    yield rows(n)
                    n = Counter()
        yield rows(n)

    found = docs.select(F.col(text).alias("text")).mapInPandas(count, "token binary, cls int, c bigint")
    return found.groupBy("token", "cls").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What a task needs to know about tokens: the frequent ones, and totals of classes."""

    tokens: int  # N
    distinct: int  # V
    head: dict  # token: number
    count: np.ndarray  # of each head token
    cls: np.ndarray  # of each head token
    inside: np.ndarray  # log10 of (count + 1) / class total of each head token
    total: np.ndarray  # log10 of each class's training tokens + distinct tokens + 1

    def classes(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1: not in the head) and class of each token."""
        at = np.array([self.head.get(t, -1) for t in tokens], dtype=np.int64)
        cls = self.cls[at] if len(self.cls) else np.zeros(len(at), dtype=np.int64)
        tail = np.flatnonzero(at < 0)
        cls[tail] = [suffix_class(tokens[i]) for i in tail]
        return at, cls


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """``counts``: a checkpointed table of ``token_counts``. At most ``head`` tokens come to the driver."""
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    by_count = counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(head).toPandas()
    fits = by_count[by_count["n"].cumsum() <= head]
    least = int(fits["c"].min()) if len(fits) else None
    top = counts.where(F.col("c") >= least).toPandas() if least is not None else pd.DataFrame({"token": [], "cls": [], "c": []})
    top["token"] = top["token"].map(bytes)
    top = top.sort_values(["c", "token"], ascending=[False, True], kind="stable").reset_index(drop=True)
    cls = top["cls"].to_numpy(dtype=np.int64).copy()
    c = top["c"].to_numpy(dtype=np.int64)
    single = min(SINGLES, len(top))
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        n[r["cls"]], v[r["cls"]] = r["n"], r["v"]
    np.subtract.at(n, cls[:single], c[:single])
    np.subtract.at(v, cls[:single], 1)
    cls[:single] = np.arange(single)
    total = np.log10(n + v + 1)
    inside = np.log10(c + 1.0) - total[cls] if len(top) else np.zeros(0)
    inside[:single] = 0.0  # the only word of its class
    return Vocabulary(int(sums["n"]), int(sums["v"]), dict(zip(top["token"], range(len(top)), strict=True)), c, cls, inside, total)


def _histories(cls: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For texts side by side, the number of (class two before, class before) at each token."""
    first = np.cumsum(n) - n
    one, two = np.full(len(cls), CLASSES, dtype=np.int64), np.full(len(cls), CLASSES, dtype=np.int64)
    one[1:], two[2:] = cls[:-1], cls[:-2]
    one[first] = CLASSES
    two[first] = CLASSES
    two[(first + 1)[n > 1]] = CLASSES
    return two * SYMBOLS + one


def history_counts(docs: DataFrame, vocab: Vocabulary, text: str = "text") -> DataFrame:
    """(history, cls, n), summed over all training documents; bounded by SYMBOLS^2 x CLASSES rows."""

    def count(batches):
        n = np.zeros(SYMBOLS * SYMBOLS * CLASSES, dtype=np.int64)
        for batch in batches:
            for part in _parts(batch["text"]):
                rows = [words(t) for t in part]
                _, cls = vocab.classes([t for r in rows for t in r])
                code = _histories(cls, np.fromiter(map(len, rows), dtype=np.int64)) * CLASSES + cls
                some, times = np.unique(code, return_counts=True)
                n[some] += times
        some = np.flatnonzero(n)
        yield pd.DataFrame({"history": (some // CLASSES).astype(np.int32), "cls": (some % CLASSES).astype(np.int32), "n": n[some]})

    found = docs.select(F.col(text).alias("text")).mapInPandas(count, "history int, cls int, n bigint")
    return found.groupBy("history", "cls").agg(F.sum("n").alias("n"))


def _parts(texts: pd.Series, chars: int = 2_000_000) -> Iterator[list]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size > chars:
            yield held
            held, size = [], 0
    if held:
        yield held


#: First weight row of each kind of feature: bias, class before, class two before, both hashed.
_AT = (0, 1, 1 + SYMBOLS, 1 + 2 * SYMBOLS)
FEATURES = 1 + 2 * SYMBOLS + HASHED


def features(history: np.ndarray) -> np.ndarray:
    """The four weight rows of each history."""
    two, one = history // SYMBOLS, history % SYMBOLS
    mixed = (history.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
    return np.stack([np.zeros_like(one), _AT[1] + one, _AT[2] + two, _AT[3] + mixed.astype(np.int64) % HASHED], axis=1)


def log_softmax(weights: np.ndarray, history: np.ndarray) -> np.ndarray:
    z = weights[features(history)].sum(axis=1)
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(counts: DataFrame, steps: int = STEPS) -> np.ndarray:
    """Weights (features x classes) from a table of ``history_counts``, by distributed gradient steps."""
    parts = 8
    table = checkpoint(counts.repartition(parts, "history").sortWithinPartitions("history"))

    def gradient(weights: np.ndarray):
        def run(batches):
            seen = np.zeros(FEATURES, dtype=bool)
            step, mass = np.zeros((FEATURES, CLASSES)), np.zeros((FEATURES, CLASSES))
            for batch in batches:  # a history may be split over batches: both halves count with their own total
                history, row = np.unique(batch["history"].to_numpy(dtype=np.int64), return_inverse=True)
                n = np.zeros((len(history), CLASSES))
                np.add.at(n, (row, batch["cls"].to_numpy()), batch["n"].to_numpy(dtype=np.float64))
                expected = np.exp(log_softmax(weights, history)) * n.sum(axis=1, keepdims=True)
                for f in features(history).T:
                    np.add.at(step, f, n - expected)
                    np.add.at(mass, f, expected)
                    seen[f] = True
            f = np.flatnonzero(seen)
            yield pd.DataFrame({"f": f.astype(np.int32), "g": pd.Series([np.concatenate([step[i], mass[i]]).tobytes() for i in f], dtype=object)})

        def add(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for f, g in zip(batch["f"], batch["g"], strict=True):
                    sums[f] = sums.get(f, 0) + np.frombuffer(g)
            yield pd.DataFrame({"f": pd.Series(list(sums), dtype="int32"), "g": pd.Series([g.tobytes() for g in sums.values()], dtype=object)})

        out = table.mapInPandas(run, "f int, g binary").repartition(parts, "f").mapInPandas(add, "f int, g binary").collect()
        return {r["f"]: np.frombuffer(bytes(r["g"])).reshape(2, CLASSES) for r in out}

    weights = np.zeros((FEATURES, CLASSES))
    for k in range(steps):
        found = gradient(weights)
        if not found:
            break
        if k == 0:  # from equal classes, the shares of the bias and of the class before are known at once
            share = {f: np.log((g[0] + g[1] + 0.1) / (g[0] + g[1] + 0.1).sum()) for f, g in found.items()}
            weights[0] = share[0]
            for f in range(_AT[1], _AT[2]):
                if f in share:
                    weights[f] = np.clip(share[f] - share[0], -5, 5)
            continue
        for f, (step, mass) in found.items():
            weights[f] += np.clip(step / (2.0 * (mass + 2.0)), -1, 1)
    return weights


def score(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, weights: np.ndarray, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    table = np.log10(np.e) * log_softmax(weights, np.arange(SYMBOLS * SYMBOLS))
    table = table.astype(np.float32)
    seen = np.log10(vocab.count + 1.0)

    def run(batches):
        for batch in batches:
            at_row = 0
            for part in _parts(batch["text"]):
                mine = batch.iloc[at_row : at_row + len(part)]
                at_row += len(part)
                rows = [words(t) for t in part]
                n = np.fromiter(map(len, rows), dtype=np.int64)
                tokens = [t for r in rows for t in r]
                at, cls = vocab.classes(tokens)
                doc = np.repeat(np.arange(len(part)), n)
                known = at >= 0
                add = lambda x, where=slice(None): np.bincount(doc[where], weights=x, minlength=len(part))
                value = table[_histories(cls, n), cls].astype(np.float64)
                value[known] += vocab.inside[at[known]]
                value[~known] -= vocab.total[cls[~known]]
                r = mine["r"].to_numpy()
                tails = [Counter(tokens[i] for i in part_of) for part_of in np.split(np.flatnonzero(~known), np.searchsorted(doc[~known], np.arange(1, len(part))))]
                yield _rows(
                    r, mine["doc_id"], mine["held_out"], [b" %d" % x for x in r], np.ones(len(part), dtype=np.int64), n,
                    add(np.ones(known.sum()), known).astype(np.int64), add(seen[at[known]], known), add(value),
                )
                m = np.fromiter(map(len, tails), dtype=np.int64)
                zero = np.zeros(m.sum())
                yield _rows(
                    np.repeat(r, m), None, None, [t for c in tails for t in c], np.array([k for c in tails for k in c.values()], dtype=np.int64),
                    zero.astype(np.int64), zero.astype(np.int64), zero, zero,
                )

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), held_out.alias("held_out"), F.monotonically_increasing_id().alias("r"))
    schema = "r bigint, doc_id bigint, held_out boolean, token binary, times bigint, n_tokens bigint, n_known bigint, seen double, value double"
    found = rows.mapInPandas(run, schema).join(counts.select("token", "c"), "token", "left")
    more = F.sum(F.when(F.col("c").isNotNull(), F.col("times") * F.log10(F.col("c") + 1.0)).otherwise(0.0))
    sums = found.groupBy("r").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0))).alias("n_known"),
        (F.sum("seen") + more).alias("seen"), (F.sum("value") + more).alias("score"),
    )
    each = float(np.log10(vocab.tokens + vocab.distinct + 1))
    return sums.select(
        "doc_id", "held_out", "n_tokens", F.col("n_known").cast("bigint").alias("n_known"), F.lit(vocab.tokens).cast("bigint").alias("train_tokens"),
        (F.col("seen") - F.col("n_tokens") * F.lit(each)).alias("base_score"), "score",
    )


def _rows(r, doc_id, held_out, token, times, n_tokens, n_known, seen, value) -> pd.DataFrame:
    none = pd.Series([None] * len(r), dtype=object)
    return pd.DataFrame(
        {
            "r": r,
            "doc_id": none if doc_id is None else doc_id.to_numpy(),
            "held_out": none if held_out is None else held_out.to_numpy(),
            "token": pd.Series(token, dtype=object),
            "times": times,
            "n_tokens": n_tokens,
            "n_known": n_known,
            "seen": seen,
            "value": value,
        }
    ).astype({"doc_id": "Int64", "held_out": "boolean"})


def score_documents(docs: DataFrame, training: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Count, train on ``training`` and score all of ``docs``."""
    counts = checkpoint(token_counts(training, text))
    vocab = vocabulary(counts)
    weights = train(history_counts(training, vocab, text))
    return score(docs, counts, vocab, weights, held_out, key, text)
