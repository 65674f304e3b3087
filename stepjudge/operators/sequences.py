"""Training sequences (P10–P13): token arrays with step labels and loss masks, answer-only labels,
evaluation rows, and batch padding.

Tokens come from the tokenizer plug-in (default: ``scoring.hash_tokenize``). A solution's
sequence is built from its steps in the long table — one explode-free ``transform`` per step
and one ordered regroup per solution (a sink-side regroup: the output is one row per solution).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepjudge.functions.verdicts import step_label
from stepjudge.operators.ranking import number_within
from stepjudge.operators.scoring import hash_tokenize
from stepjudge.session import checkpoint_dir

IGNORE_INDEX = -100


def step_sequences(steps: DataFrame, questions: DataFrame, by: Sequence[str] = ("problem_id",), step_idx: str = "step_idx",
                   step: str = "step", label: str = "gt_label", question: str = "question",
                   tokenize: Callable[[Column], Column] = hash_tokenize, sep_id: int = 1, pos_id: int = 2, neg_id: int = 3,
                   pad_id: int = 0, max_length: int | None = None, last_only: bool = False,
                   solution_label: str | None = None) -> DataFrame:
    """P10: question tokens, then per step the tokens of ``\\nStep i: text`` and a separator that
    carries the step label; loss mask 1 on separators (only the last with ``last_only``); a mask
    that keeps separators through the first error; attention mask; truncation to ``max_length``;
    with ``solution_label`` (a column of ``questions``) every loss position takes the solution's label."""
    by = list(by)
    # a solution's steps and its questions meet in one grouping, a step as its tokens and one mark alone; labels and
    # masks are written from the grouped steps. Steps of one place go by tokens, then by label id: the lesser is not marked
    marks_ok = pos_id > neg_id
    tokens = tokenize(F.concat(F.lit("\nStep "), (F.col(step_idx) + 1).cast("string"), F.lit(": "), F.col(step)))
    per = steps.select(*by, F.col(step_idx).alias("_at"), F.concat(tokens, F.array(F.lit(sep_id))).alias("_ids"), (step_label(label) == F.lit(marks_ok)).alias("_mark"))
    ok = lambda x: x["_mark"] if marks_ok else ~x["_mark"]
    asked = questions.select(*by, tokenize(F.col(question)).alias("_q"), *([] if solution_label is None else [step_label(solution_label).alias("_sol_ok")]))
    packs = {"_s": ["_at", "_ids", "_mark"], "_questions": asked.columns[len(by):]}
    rows = per.select(*by, F.struct(*packs["_s"]).alias("_s")).unionByName(asked.select(*by, F.struct(*packs["_questions"]).alias("_questions")), allowMissingColumns=True)
    for b in by:
        rows = rows.filter(F.col(b).isNotNull())
    packed = rows.groupBy(*by).agg(F.array_sort(F.collect_list("_s")).alias("_s"), F.collect_list("_questions").alias("_questions"))
    packed = packed.filter(F.size("_s") > 0).withColumn("_question", F.explode("_questions"))
    fe = F.array_min(F.transform(F.filter("_s", lambda x: ~ok(x)), lambda x: x["_at"]))
    last = F.array_max(F.transform("_s", lambda x: x["_at"]))
    j = packed.select(*by, "_s", "_question.*", fe.alias("_fe"), last.alias("_last"))
    loss = lambda x: F.when(x["_at"] == F.col("_last"), 1).otherwise(0) if last_only else F.lit(1)
    keep = lambda x: F.when(F.col("_fe").isNull() | (x["_at"] <= F.col("_fe")), 1).otherwise(0)

    def marked(fill, separator):
        """``fill`` on every token, but ``separator`` at the end of each step."""
        of_step = lambda x: F.concat(F.array_repeat(F.lit(fill), F.size(x["_ids"]) - 1), F.array(separator(x)))
        return F.concat(F.array_repeat(F.lit(fill), F.size("_q")), F.flatten(F.transform("_s", of_step)))

    out = j.select(*by, F.concat("_q", F.flatten(F.transform("_s", lambda x: x["_ids"]))).alias("input_ids"),
                   marked(pad_id, lambda x: F.when(ok(x), pos_id).otherwise(neg_id)).alias("labels"),
                   marked(0, loss).alias("loss_mask"), marked(0, keep).alias("loss_mask_with_first_error_only"),
                   *([] if solution_label is None else ["_sol_ok"]))
    out = out.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    if solution_label is not None:
        # "same label everywhere": every loss position carries the solution's label (an explicit
        # option here; the reference's switch never takes effect)
        out = out.withColumn("labels", F.zip_with(
            "labels", "loss_mask", lambda l, m: F.when(m == 1, F.when(F.col("_sol_ok"), pos_id).otherwise(neg_id)).otherwise(l))
        ).drop("_sol_ok")
    if max_length is not None:
        for c in ["input_ids", "labels", "loss_mask", "loss_mask_with_first_error_only", "attention_mask"]:
            out = out.withColumn(c, F.slice(c, 1, max_length))
    return out


def answer_only_labels(prompt_ids: str | Column, answer_ids: str | Column, max_length: int | None = None) -> Column:
    """Ignore-index over the prompt, the answer's token ids after it (optionally truncated)."""
    p, a = F.col(prompt_ids) if isinstance(prompt_ids, str) else prompt_ids, F.col(answer_ids) if isinstance(answer_ids, str) else answer_ids
    lab = F.concat(F.array_repeat(F.lit(IGNORE_INDEX), F.size(p)), a)
    return F.slice(lab, 1, max_length) if max_length is not None else lab


def evaluation_rows(df: DataFrame, steps: str = "steps", labels: str = "labels") -> DataFrame:
    """Evaluation rows from labelled steps: the numbered solution text next to the lists."""
    return df.withColumn("solution", F.array_join(F.transform(steps, lambda x, i: F.concat(
        F.lit("Step "), (i + 1).cast("string"), F.lit(": "), x)), "\n"))


def pad_batches(df: DataFrame, order_by: Sequence[str], size: int, cols: dict[str, int | str]) -> DataFrame:
    """Pad array columns to the longest in each batch of ``size`` rows (W11 numbering). The
    pad value is a number, or ``"last"`` to repeat the last element. Batch maxima are an
    aggregate joined back. Every row is kept once: rows of equal or null order keys are told apart by
    a row id (in no promised order)."""
    # only the order columns and the row id are numbered; the arrays meet their batch in a join on the
    # row id, which both sides read from the checkpoint
    checkpoint_dir(df.sparkSession)
    df = df.withColumn("_rid", F.monotonically_increasing_id()).checkpoint(eager=True)
    keys = number_within(df.select(*order_by, "_rid"), [], [*order_by, "_rid"], "_rn", base=0)
    b = df.join(keys.select("_rid", F.floor(F.col("_rn") / size).alias("batch_id")), "_rid").drop("_rid")
    mx = b.groupBy("batch_id").agg(*[F.max(F.size(c)).alias(f"_mx_{c}") for c in cols])
    j = b.join(mx, "batch_id")
    for c, pad in cols.items():
        missing = F.greatest(F.col(f"_mx_{c}") - F.size(c), F.lit(0))
        fill = F.try_element_at(c, F.lit(-1)) if pad == "last" else F.lit(pad)
        j = j.withColumn(c, F.concat(F.col(c), F.array_repeat(fill, missing)))
    return j.drop(*[f"_mx_{c}" for c in cols])
