"""Scoring surface: the batched scorer plug-in (U1), tokenizer plug-in (U3), log-probability
confidences (H37, K7), candidate scoring (K6) and verifier scaling (K8).

A scorer is ``fn(pdf) -> pdf``: it receives a pandas batch with the key columns and an
``steps`` array column and returns the keys plus ``step_scores``. ``apply_batched`` runs it with
``mapInPandas`` — the model (or any state) is built once per task by ``factory`` and the rows
reach it in batches of ``batch_size`` over Arrow; nothing passes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepjudge.functions.answers import split_steps
from stepjudge.functions.verdicts import step_label_from_score
from stepjudge.operators.ranking import number_within, running, tasks_for
from stepjudge.session import checkpoint_dir

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def apply_batched(df: DataFrame, factory: Callable[[], Scorer], schema: str, batch_size: int = 16) -> DataFrame:
    """Run a batched row function; ``factory`` is called once per task (model load)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = factory()
        for b in batches:
            for start in range(0, len(b), batch_size):
                yield fn(b.iloc[start:start + batch_size].reset_index(drop=True))
    return df.mapInPandas(run, schema)


#: Lengths of one class differ by this factor at most, so padding to the class costs an eleventh.
CLASS_RATIO = 1.1


def length_class(length: Column) -> Column:
    """The class of a length: 0 for none, then lengths within a factor of ``CLASS_RATIO``."""
    return F.when(length <= 0, 0).otherwise(1 + F.floor(F.log(length.cast("double")) / math.log(CLASS_RATIO) + 1e-9)).cast("int")


def batch_by_length(df: DataFrame, length: str, budget: int) -> DataFrame:
    """``batch_id`` and ``batch_size`` such that a batch's rows are of similar length and take at most ``budget``
    tokens once padded (a row longer than that is a batch of its own).

    Rows are numbered within their class of lengths, which any number of tasks share (``number_within``), and
    every class has batches of as many rows as fit: no row moves for the sake of another class."""
    checkpoint_dir(df.sparkSession)
    d = df.withColumn("_rid", F.monotonically_increasing_id()).withColumn("_class", length_class(F.col(length))).checkpoint(eager=True)
    longest = F.ceil(F.pow(F.lit(CLASS_RATIO), F.col("_class")))
    rows = F.greatest(F.floor(F.lit(int(budget)) / F.greatest(longest, F.lit(1))), F.lit(1))
    n = number_within(d.select("_rid", "_class"), ["_class"], ["_rid"], "_rn", base=0).drop("_class")
    place = F.floor(F.col("_rn") / rows)
    return d.join(n, "_rid").withColumn("batch_id", F.struct(F.col("_class").alias("length_class"), place.alias("place"))).withColumn("batch_size", rows.cast("bigint")).drop("_rid", "_class", "_rn")


def apply_by_length(df: DataFrame, factory: Callable[[], Scorer], schema: str, length: str, budget: int) -> DataFrame:
    """U1 with batches by length: the function sees each batch of ``batch_by_length`` as a whole, wherever Arrow's batches
    end. Rows come back in no order; their keys tell them apart."""
    cols = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn, held = factory(), None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            mark = held["_b"].to_numpy()
            cuts = [0, *(i + 1 for i in range(len(mark) - 1) if mark[i] != mark[i + 1])]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                yield fn(held.iloc[start:stop][cols].reset_index(drop=True))
            held = held.iloc[cuts[-1]:]
        if held is not None and len(held):
            yield fn(held[cols].reset_index(drop=True))

    batched = batch_by_length(df, length, budget).withColumn("_b", F.concat_ws("-", "batch_id.length_class", "batch_id.place"))
    # batches lie in no order of length: were the longest texts neighbours, Arrow's batches of them would be many times the others
    return batched.select(*cols, "_b").repartition("_b").sortWithinPartitions(F.xxhash64("_b"), "_b").mapInPandas(run, schema)


def padding_share(df: DataFrame, length: str, batch: str = "batch_id") -> DataFrame:
    """The share of tokens that are padding when every batch is padded to its longest row."""
    of_batch = df.groupBy(batch).agg(F.max(length).alias("m"), F.count(F.lit(1)).alias("n"), F.sum(length).alias("s"))
    return of_batch.agg((1 - F.sum("s") / F.sum(F.col("m") * F.col("n"))).alias("share"), F.max(F.col("m") * F.col("n")).alias("largest"))


def length_scorer() -> Scorer:
    """A deterministic test scorer: step score = (characters % 100) / 100."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.drop(columns=["steps"]).copy()
        out["step_scores"] = [[(len(s) % 100) / 100.0 for s in steps] for steps in pdf["steps"]]
        return out
    return fn


def score_candidates(df: DataFrame, keys: Sequence[str], text: str, factory: Callable[[], Scorer] = length_scorer,
                     batch_size: int = 16, how: str = "newline", threshold: float = 0.5) -> DataFrame:
    """K6: split each candidate into steps, score the steps with the plug-in, and return the step
    scores, the solution score (last step) and the step labels (score > threshold)."""
    keys = list(keys)
    prepared = df.select(*keys, split_steps(F.col(text), how).alias("steps"))
    key_types = ", ".join(f"{k} {t}" for k, t in prepared.select(*keys).dtypes)
    scored = apply_batched(prepared, factory, f"{key_types}, step_scores array<double>", batch_size)
    return scored.select(
        *keys, "step_scores",
        F.try_element_at("step_scores", F.lit(-1)).alias("score"),
        F.transform("step_scores", lambda x: step_label_from_score(x, threshold).cast("int")).alias("step_labels"),
    )


def hash_tokenize(text: str | Column, vocab: int = 50000) -> Column:
    """U3 default tokenizer: whitespace pieces mapped to ids by a hash (a plug-in may replace it)."""
    pieces = F.filter(F.split(_c(text), r"\s+", -1), lambda x: x != "")
    return F.transform(pieces, lambda w: F.pmod(F.xxhash64(w), F.lit(vocab)).cast("int"))


def confidence(pos: str | Column, neg: str | Column, temperature: float = 1.0) -> Column:
    """Softmax probability of the positive option from two log-probabilities, computed as
    1 / (1 + exp((neg - pos) / T)) so that very negative log-probs never divide by zero."""
    return 1.0 / (1.0 + F.exp((_c(neg) - _c(pos)) / F.lit(float(temperature))))


def softmax(arr: str | Column, temperature: float = 1.0) -> Column:
    """H37, general form: softmax over an array with the maximum subtracted first."""
    a = F.transform(_c(arr), lambda x: x / F.lit(float(temperature)))
    m = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / s)


def pivot_options(df: DataFrame, key: str, pos: str, token: str, rank: str, logprob: str,
                  pos_token: str = "Yes", neg_token: str = "No") -> DataFrame:
    """(key, pos, top, yes, no): a table with one row per listed token (key, pos, token, rank, logprob)
    turned into one row per position: its top-ranked token and the log-probabilities of both options,
    NULL for an option that isn't listed. Spaces around tokens are ignored; of an option listed twice
    the larger counts.

    Rows are counted, dealt to their positions' tasks and grouped there alone: with a text among the results, Spark
    would sort every split it reads to group it before the shuffle as well, and that sort grows with the split."""
    t, lp = F.trim(F.col(token)), F.col(logprob)
    of = lambda option: F.when(t == option, lp)
    listed = df.select(key, pos, F.when(F.col(rank) == 1, F.col(token)).alias("top"), of(pos_token).alias("yes"), of(neg_token).alias("no"))
    dealt = listed.repartition(tasks_for(df.count()), key, pos)
    return dealt.groupBy(key, pos).agg(F.min("top").alias("top"), F.max("yes").alias("yes"), F.max("no").alias("no"))


def scores_from_logprobs(df: DataFrame, key: str, pos_col: str, yes: str, no: str, top: str,
                         pos_token: str = "Yes", neg_token: str = "No", temperature: float = 1.0,
                         steps: DataFrame | None = None, n_steps: str = "n_steps") -> DataFrame:
    """K7: (key, step_idx, pos, confidence), one row per decision.

    Decision positions are those whose top-ranked token is the yes or the no token (surrounding spaces
    ignored). A position that lacks either option (NULL log-probability) is skipped; the others give a
    confidence each and are numbered from 0 in position order (``step_idx``). With ``steps`` (key,
    ``n_steps``: one row per verified prefix), a key without any decision gives NULL for each of its
    steps; a key whose decisions are all skipped has no rows.
    """
    given = F.col(yes).isNotNull() & F.col(no).isNotNull()
    decisions = df.filter(F.trim(F.col(top)).isin(pos_token, neg_token))
    if steps is None:
        d = decisions.filter(given).select(key, pos_col, confidence(yes, no, temperature).alias("confidence"))
        d = number_within(d, [key], [pos_col], "step_idx", base=0, by_rows=True)
        return d.select(key, "step_idx", pos_col, "confidence")
    # a key's row of ``steps`` comes after its decisions, so it sees how many there are: nothing is joined
    d = decisions.select(key, pos_col, confidence(yes, no, temperature).alias("confidence"), given.cast("int").alias("_given"))
    last = steps.filter(F.col(n_steps) > 0).select(key, F.col(n_steps).cast("bigint").alias("_n"))
    both = d.unionByName(last, allowMissingColumns=True)
    both = running(both, [key], [F.col("_n").isNotNull(), F.col(pos_col)], {
        "_place": ("sum", F.coalesce("_given", F.lit(0))),
        "_seen": ("sum", F.when(F.col("_given").isNotNull(), 1).otherwise(0)),
    }, by_rows=True)
    # as in a join, a NULL key has no decisions
    none = F.col("_n").isNotNull() & (F.col(key).isNull() | (F.col("_seen") == 0))
    idx = F.when(F.col("_given") == 1, F.array(F.col("_place") - 1)).when(none, F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1))
    return both.select(key, F.explode(idx).alias("step_idx"), pos_col, "confidence")


def combine_verifications(df: DataFrame, by: Sequence[str], round_col: str, decision: str, text: str | None = None,
                          mode: str = "parallel", phrase: str = "\n\nLet's check again.\n\n") -> DataFrame:
    """K8: parallel scaling = mean decision over K verifications; sequential scaling = the rounds
    joined with a phrase, the last round's decision counts."""
    by = list(by)
    if mode == "parallel":
        return df.groupBy(*by).agg(F.avg(F.col(decision).cast("double")).alias("score"), F.count(F.lit(1)).alias("k"))
    if mode == "sequential":
        last = F.max_by(F.col(decision).cast("double"), F.col(round_col)).alias("score")
        aggs = [last, F.count(F.lit(1)).alias("k")]
        if text is not None:
            aggs.append(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(round_col).alias("r"), F.col(text).alias("t")))),
                                                 lambda x: x["t"]), phrase).alias("transcript"))
        return df.groupBy(*by).agg(*aggs)
    raise ValueError(f"unknown verifier scaling mode {mode!r}")
