"""Column functions over verification texts: verdict parsing, chain cleaning and completion.

All are Catalyst expressions over one row's text (regex, split, higher-order array functions);
the table jobs in ``plans.curate`` run them over whole columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values that must equal the reference's (phrases and tokens of the verification format)
CORRECT = "correct"
INCORRECT = "incorrect"
YES_MARK = "correct? yes"
NO_MARK = "correct? no"
QUESTION_MARK = "correct?"
FOLLOWS_ERROR_LINE = "Follows an incorrect step. Correct? No."
PREDECISION = "Is the solution correct?"
ANSWER_PHRASE = "The answer is"
THINK_OPEN = "<think>"
THINK_CLOSE = "</think>"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lines(text: str | Column) -> Column:
    """Split on newline, keeping empty lines (as Python's ``str.split('\\n')``)."""
    return F.split(_c(text), "\n", -1)


def step_label(col: str | Column) -> Column:
    """'+' or 1 is a correct step; anything else (NULL included) is not."""
    c = _c(col).cast("string")
    return F.coalesce((c == "+") | (c == "1"), F.lit(False))


def boxed_verdicts(text: str | Column) -> Column:
    """H2: verdicts in ``\\boxed{...}`` in order, ``\\text{}`` unwrapped; only exactly
    ``correct`` / ``incorrect`` count. ARRAY<BOOLEAN> (true = correct)."""
    unwrapped = F.regexp_replace(_c(text), r"\\text\{([^}]*)\}", "$1")
    found = F.regexp_extract_all(unwrapped, F.lit(r"\\boxed\{([^}]*)\}"), 1)
    kept = F.filter(found, lambda x: x.isin(CORRECT, INCORRECT))
    return F.transform(kept, lambda x: x == CORRECT)


def line_verdicts(text: str | Column) -> Column:
    """H3: lines holding ``correct? yes`` / ``correct? no`` (any case), as ARRAY<BOOLEAN>."""
    ls = F.filter(lines(text), lambda s: F.lower(s).contains(YES_MARK) | F.lower(s).contains(NO_MARK))
    return F.transform(ls, lambda s: F.lower(s).contains(YES_MARK))


def question_lines(text: str | Column) -> Column:
    """Non-blank lines that ask ``correct?`` (the strict form used for preference pairs)."""
    return F.filter(lines(text), lambda s: (F.trim(s) != "") & F.lower(s).contains(QUESTION_MARK))


def all_answered(qlines: Column) -> Column:
    """Every question line carries a yes or a no."""
    return F.forall(qlines, lambda s: F.lower(s).contains(YES_MARK) | F.lower(s).contains(NO_MARK))


def step_verdicts(text: str | Column, pos: str = "Yes", neg: str = "No", boxed: bool = False) -> Column:
    """H4: verdict lines with 1/0 labels — ``Correct? Yes/No`` lines, or boxed lines with a token.
    ARRAY<STRUCT<line STRING, label INT>>."""
    if boxed:
        ls = F.filter(lines(text), lambda s: s.contains("\\boxed{"))
        return F.transform(ls, lambda s: F.struct(s.alias("line"), F.when(s.contains(pos), 1).otherwise(0).alias("label")))
    ls = F.filter(lines(text), lambda s: s.contains(f"Correct? {pos}") | s.contains(f"Correct? {neg}"))
    return F.transform(ls, lambda s: F.struct(s.alias("line"), F.when(s.contains(f"Correct? {pos}"), 1).otherwise(0).alias("label")))


def matches_through(decisions: Column, n_keep: Column, last_plus: Column) -> Column:
    """C5 + W2 on arrays: the first ``n_keep`` decisions equal the repaired labels, which are
    correct exactly up to ``last_plus`` (compared over the shorter of the two lists)."""
    head = F.slice(decisions, 1, F.greatest(n_keep, F.lit(0)))
    return F.forall(
        F.transform(head, lambda d, i: d == F.coalesce(i <= last_plus, F.lit(False))), lambda x: x
    )


def mismatches_through(decisions: Column, n_keep: Column, last_plus: Column) -> Column:
    """Number of decisions that differ from the repaired labels within the first ``n_keep``."""
    head = F.slice(decisions, 1, F.greatest(n_keep, F.lit(0)))
    return F.aggregate(
        F.transform(head, lambda d, i: F.when(d == F.coalesce(i <= last_plus, F.lit(False)), 0).otherwise(1)),
        F.lit(0), lambda a, x: a + x,
    )


def pad_after_error(text: str | Column, n_keep: Column, n_steps: Column) -> Column:
    """H9: lines starting ``Step`` through the first error, then ``Step i: Follows an incorrect
    step. Correct? No.`` up to the step count. ARRAY<STRING>.

    ``sequence(a, b)`` counts down when a > b, so the filler is guarded by a ``when``."""
    kept = F.slice(F.filter(lines(text), lambda s: s.startswith("Step")), 1, F.greatest(n_keep, F.lit(0)))
    start = F.size(kept) + 1
    filler = F.when(
        n_steps >= start,
        F.transform(F.sequence(start, n_steps), lambda i: F.concat(F.lit("Step "), i.cast("string"), F.lit(": " + FOLLOWS_ERROR_LINE))),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(kept, filler)


def chain_variant(cot_steps: Column, how: str | None, is_correct: Column | None = None) -> Column:
    """``incorrect_only`` blanks the reasoning of correct steps, ``direct`` of all steps,
    ``single_label`` drops per-step verdicts and adds one final verdict line."""
    if how is None:
        return cot_steps
    if how == "incorrect_only":
        return F.transform(cot_steps, lambda s: F.regexp_replace(s, r"(Step .*:).*?(Correct\? Yes)", "$1 $2"))
    if how == "direct":
        return F.transform(cot_steps, lambda s: F.regexp_replace(s, r"(Step .*:).*?(Correct\? (Yes|No))", "$1 $2"))
    if how == "single_label":
        stripped = F.transform(cot_steps, lambda s: F.replace(F.replace(s, F.lit("Correct? Yes."), F.lit("")),
                                                             F.lit("Correct? No."), F.lit("")))
        final = F.when(is_correct, F.lit(PREDECISION + " Yes")).otherwise(F.lit(PREDECISION + " No"))
        return F.concat(stripped, F.array(final))
    raise ValueError(f"unknown chain variant {how!r}")


def normalize_boxed_text(text: str | Column) -> Column:
    """``\\boxed{\\text{correct}}`` → ``\\boxed{correct}`` (and incorrect)."""
    t = F.replace(_c(text), F.lit("\\boxed{\\text{correct}}"), F.lit("\\boxed{correct}"))
    return F.replace(t, F.lit("\\boxed{\\text{incorrect}}"), F.lit("\\boxed{incorrect}"))


def truncate_after_last_verdict(text: str | Column) -> Column:
    """H8: cut the text right after the last ``\\boxed{…}`` whose content mentions correct/incorrect
    (case-blind); unchanged when there is none."""
    t = normalize_boxed_text(text)
    cut = F.regexp_extract(t, r"(?s)^(.*\\boxed\{[^}]*(?i:correct)[^}]*\})", 1)
    return F.when(cut == "", t).otherwise(cut)


def strip_thinking(text: str | Column, legacy: bool = False) -> Column:
    """H7: keep the answer part of a chain.

    ``</think>`` present: text before it. ``<think>`` present: the text after it (``legacy=True``
    keeps the text *through* ``<think>`` instead, as the reference's long-chain filter does)."""
    t = _c(text)
    if legacy:
        t = F.when(t.contains(THINK_OPEN), F.concat(F.substring_index(t, THINK_OPEN, 1), F.lit(THINK_OPEN))).otherwise(t)
    else:
        t = F.when(t.contains(THINK_OPEN), F.substr(t, F.instr(t, THINK_OPEN) + F.lit(len(THINK_OPEN)))).otherwise(t)
    return F.when(t.contains(THINK_CLOSE), F.substring_index(t, THINK_CLOSE, 1)).otherwise(t)


def cut_after_kth_verdict(text: str | Column, k: Column) -> Column:
    """W7 on one text: the lines up to and including the k-th line holding a boxed verdict;
    NULL when the text has fewer than k of them."""
    ls = lines(text)
    vpos = F.filter(
        F.transform(ls, lambda s, i: F.when(s.contains("\\boxed{") & F.lower(s).contains(CORRECT), i + 1)),
        lambda x: x.isNotNull(),
    )
    pos_k = F.try_element_at(vpos, k)
    return F.when(pos_k.isNotNull(), F.array_join(F.slice(ls, 1, pos_k), "\n"))


def max_step_number(text: str | Column) -> Column:
    """The largest ``Step N`` number mentioned (numerically)."""
    nums = F.regexp_extract_all(_c(text), F.lit(r"Step (\d+)"), 1)
    return F.array_max(F.transform(nums, lambda x: x.cast("int")))


def decision(label: str | Column, token: str = "correct") -> Column:
    """The chosen label contains the correct token (and is not the incorrect one)."""
    lab = F.lower(_c(label))
    return lab.contains(token) & ~lab.contains("in" + token)


def step_label_from_score(score: str | Column, threshold: float = 0.5) -> Column:
    """A step is correct when its score is strictly above the threshold."""
    return _c(score) > F.lit(threshold)
