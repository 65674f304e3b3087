"""Benchmark fields (B13, B14): the question text and the gold answer of each benchmark layout.

``LAYOUTS`` says, per benchmark, how a question is put together from its columns and where its gold answer
stands. A question is a template: ``{column}`` is a column's text, ``{a|b}`` the first of these columns that the
table has, ``{column:form}`` a column put into one of ``FORMS``, and a part in double brackets is left out
where its column is empty. A gold answer is the first of its columns that holds something, read by one of
``READINGS``. Gold answers are then normalised per distinct value (``normalize_answers``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepjudge.functions.answers import let, normalize_answers, raw_answer, strip_ws


@dataclass(frozen=True)
class Layout:
    gold: str  # columns, the preferred one first
    read: str = "text"
    ask: str = "{question|problem|Question|input}"


# ---- fixed values that must equal the reference's ------------------------------------------------
# names, columns and words of the benchmarks
LAYOUTS = {
    "aime24": Layout("answer"),
    "amc23": Layout("answer"),
    "aqua": Layout("correct", ask="{question:trimmed}\nAnswer Choices: {options:joined}"),
    "asdiv": Layout("answer", "without brackets", "{body:trimmed} {question:trimmed}"),
    "carp_en": Layout("answer", ask="{content}"),
    "cmath": Layout("answer"),
    "cn_middle_school": Layout("choice_answer answer"),
    "college_math": Layout("answer", "without dollars"),
    "gaokao2023en": Layout("answer", "without dollars"),
    "gaokao2024_I": Layout("answer"),
    "gaokao2024_II": Layout("answer"),
    "gaokao2024_mix": Layout("choice_answer answer"),
    "gaokao_math_cloze": Layout("answer", "without dollars"),
    "gaokao_math_qa": Layout("label", ask="{question:trimmed}\n选项: {options:entries}"),
    "gsm8k": Layout("answer", "behind hashes"),
    "imo2024": Layout("answer"),
    "math": Layout("solution", "solution"),
    "mawps": Layout("target"),
    "minerva_math": Layout("solution", "solution"),
    "mmlu_stem": Layout("answer", "letter of place", "{question:trimmed}\nAnswer Choices: {choices:lettered}"),
    "olympiadbench": Layout("final_answer", "first without dollars"),
    "sat_math": Layout("Answer", ask="{question:trimmed}\nAnswer Choices: {options:bracketed}"),
    "svamp": Layout("Answer", ask="{Body:sentence} {Question:trimmed}"),
    "tabmwp": Layout("answer", "number by ans_type", 'Read the following table [[regarding "{table_title}" ]]and answer a question:\n'
                     "{table}\n{question}[[ Please select from the following options: {choices:listed}]]"),
}
LETTERS = "ABCD"
NUMBER_KINDS = ("integer_number", "decimal_number")
# benchmarks whose gold answer is not normalised, but for these commands
EXEMPT, EXEMPT_COMMANDS = ("carp_en", "minerva_math"), {"\\neq": "\\ne", "\\leq": "\\le", "\\geq": "\\ge"}
# hints that a gold answer gives
HINTS = {" (True or False)": ("true", "false"), " (Yes or No)": ("yes", "no")}
# columns of rows that carry a prepared solution and answer
PREPARED = ("gt_cot", "gt")
# --------------------------------------------------------------------------------------------------


def _letter(place: Column) -> Column:
    return F.substring(F.lit(LETTERS), place.cast("int") + 1, 1)


def _lettered(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.lit("("), _letter(i), F.lit(") "), strip_ws(o.cast("string")))), " ")


def _joined(options: Column) -> Column:
    """Options that bring their letter and a closing bracket."""
    return strip_ws(F.replace(F.concat(F.lit(" ("), F.array_join(F.transform(options, lambda o: F.replace(o, F.lit("("), F.lit(" ("))), " (")), F.lit(")"), F.lit(") ")))


def _quoted(text: Column) -> Column:
    """A text as Python writes it in a list."""
    plain = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    double = text.contains("'") & ~text.contains('"')
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


#: Ways to put a column into a question.
FORMS: dict[str, Callable[[Column], Column]] = {
    "trimmed": strip_ws,
    "sentence": lambda c: let(strip_ws(c), lambda s: F.when(s.endswith("."), s).otherwise(F.concat(s, F.lit(".")))),
    "lettered": _lettered,
    "joined": _joined,
    "bracketed": lambda c: F.regexp_replace(F.concat(F.lit("("), strip_ws(c)), r" ([BCD])\) ", " ($1) "),
    "entries": lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(F.lit("("), e["key"], F.lit(") "), e["value"])), " "),
    "listed": lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, _quoted), ", "), F.lit("]")),
}


def _number(text: Column) -> Column:
    """The value of a ratio, a number with commas, a percentage or a plain number."""
    side = lambda mark, i: F.get(F.split(text, mark), F.lit(i)).try_cast("double")
    value = F.coalesce(side("/", 0) / F.nullif(side("/", 1), F.lit(0.0)), F.replace(text, F.lit(","), F.lit("")).try_cast("double"), side("%", 0) / 100)
    return value.cast("string")


#: Ways to read a gold answer off its column.
READINGS: dict[str, Callable[[Column, str], Column]] = {
    "text": lambda c, _: c.cast("string"),
    "solution": raw_answer,
    "behind hashes": lambda c, _: F.substring_index(c, "####", -1),
    "without brackets": lambda c, _: F.regexp_replace(c, r"\(.*?\)", ""),
    "without dollars": lambda c, _: strip_ws(F.replace(c, F.lit("$"), F.lit(""))),
    "first without dollars": lambda c, _: F.btrim(F.get(c, F.lit(0)), F.lit("$")),
    "letter of place": lambda c, _: _letter(c),
    "number by ans_type": lambda c, _: F.when(F.col("ans_type").isin(*NUMBER_KINDS), _number(c)).otherwise(c),
}


def layout(benchmark: str) -> Layout:
    if benchmark not in LAYOUTS:
        raise NotImplementedError(f"benchmark {benchmark!r}; known are {', '.join(LAYOUTS)}")
    return LAYOUTS[benchmark]


def _filled(df: DataFrame, template: str) -> Column:
    """A template over the table's columns; empty optional parts are left out."""
    pieces = []
    for i, part in enumerate(re.split(r"\[\[(.*?)\]\]", template, flags=re.DOTALL)):
        used, texts = [], []
        for j, piece in enumerate(re.split(r"\{([^}]*)\}", part)):
            if j % 2 == 0:
                texts.append(F.lit(piece))
                continue
            names, _, form = piece.partition(":")
            name = next((n for n in names.split("|") if n in df.columns), None)
            if name is not None:
                used.append(name)
            text = F.lit("") if name is None else F.col(name)
            # a list that a table holds as text is shown as it is
            listed = name is not None and isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType))
            as_text = form in ("listed", "") and not listed
            texts.append(text.cast("string") if as_text else FORMS[form](text))
        filled = F.concat(*texts)
        if i % 2:
            holds = [F.coalesce((F.size(n) if isinstance(df.schema[n].dataType, T.ArrayType) else F.length(F.col(n).cast("string"))) > 0, F.lit(False)) for n in used]
            filled = F.when(reduce(lambda x, y: x & y, holds, F.lit(bool(used))), filled).otherwise("")
        pieces.append(filled)
    return F.concat(*pieces)


def gold_answer(df: DataFrame, benchmark: str, out: str = "gold", normalize: bool = True, read_only: bool = False) -> DataFrame:
    """The gold answer of each row for a benchmark, then normalised (H12) unless exempt. With ``read_only`` an
    answer that is to be normalised stays as it was read, so that those of several benchmarks can be normalised at once.

    Rows that carry a prepared solution and answer (``gt_cot``, ``gt``) give that answer; for a benchmark that
    reads its answers off solutions and normalises them, the prepared solution is read."""
    how = layout(benchmark)
    exempt = benchmark in EXEMPT
    if all(c in df.columns for c in PREPARED):
        solution, answer = map(F.col, PREPARED)
        raw = raw_answer(solution, benchmark) if how.read == "solution" and not exempt else answer.cast("string")
    else:
        first, *others = how.gold.split()
        raw = READINGS[how.read](F.col(first), benchmark)
        for other in others:
            raw = F.when(F.length(raw) > 0, raw).otherwise(READINGS[how.read](F.col(other), benchmark))
    d = df.withColumn("_gold_raw", raw)
    if exempt:
        text = F.col("_gold_raw")
        for command, short in EXEMPT_COMMANDS.items():
            text = F.replace(text, F.lit(command), F.lit(short))
        return d.withColumn(out, text).drop("_gold_raw")
    if read_only:
        return d.withColumnRenamed("_gold_raw", out) if out not in df.columns else d.withColumn(out, F.col("_gold_raw")).drop("_gold_raw")
    if not normalize:
        return d.withColumn(out, strip_ws(F.col("_gold_raw"))).drop("_gold_raw")
    return normalize_answers(d, "_gold_raw", out).drop("_gold_raw")


def question_text(df: DataFrame, benchmark: str, out: str = "question", gold: str | None = None, strip: bool = True) -> DataFrame:
    """The question text per benchmark layout, with the hints the gold answer implies (when a ``gold`` column is given).
    Without ``strip`` the text is left for ``with_hints``."""
    question = _filled(df, layout(benchmark).ask)
    if gold is not None:
        question = with_hints(question, F.col(gold))
    return df.withColumn(out, strip_ws(question) if strip else question)


def with_hints(question: Column, gold: Column) -> Column:
    for hint, answers in HINTS.items():
        question = F.concat(question, F.when(F.lower(gold).isin(*answers), hint).otherwise(""))
    return question


def questions_and_answers(tables: dict[str, DataFrame], keep: Sequence[str]) -> DataFrame:
    """B13 + B14 over tables of several benchmarks: (layout, keep…, question, gold).

    Questions are put together first, so rows take no other column along to their answers, and an answer that
    benchmarks share is normalised once. Rows of exempt benchmarks stay where they are."""
    rows: dict[bool, DataFrame] = {}
    for name, table in tables.items():
        part = gold_answer(question_text(table, name, "_asked", strip=False), name, "_read", read_only=True)
        part = part.select(F.lit(name).alias("layout"), *keep, "_asked", "_read")
        done = name in EXEMPT
        rows[done] = rows[done].unionByName(part) if done in rows else part
    parts = [df.withColumn("gold", F.col("_read")) if done else normalize_answers(df, "_read", "gold") for done, df in rows.items()]
    asked = strip_ws(with_hints(F.col("_asked"), F.col("gold"))).alias("question")
    return reduce(DataFrame.unionByName, [p.select("layout", *keep, asked, "gold") for p in parts])
