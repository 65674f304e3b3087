"""Prompt text as Column functions (P1–P9) and the chat layout of conversations.

A chat template is a plug-in (``role_template``); the default tags each message with its role.
"""

from __future__ import annotations

import re

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values that must equal the reference's (prompt texts) --------------------------------
VERIFY_INSTRUCTION = ("Review and critique each step in the proposed solution to determine whether each step is "
                      "correct. If the solution is incomplete, only verify the provided steps.")
VERIFY_TEMPLATE = ("You are given a math problem and a proposed step-by-step solution:\n\n[Math Problem]\n\n{problem}"
                   "\n\n[Solution]\n\n{solution}\n\n{instruction}")
VERIFY_LEAD = "Let's verify step by step:"
ANALYSIS_INSTRUCTION = ("Given a math question and partial solution steps, analyze each step in the solution, then "
                        "determine whether it is correct. Provide the analysis for each step first, then indicate with "
                        "'Yes' or 'No' whether it is correct.")
CODE_PREAMBLE = ("You will be given a question (problem specification) and will generate a correct Python program that "
                 "matches the specification and passes all tests. You will NOT return anything except for the program.")
STEP_TAG = "<extra_0>"
# -------------------------------------------------------------------------------------------------


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def render_template(template: str, fields: Mapping[str, str | Column]) -> Column:
    """The template with its ``{name}`` placeholders filled by columns. The template is split once,
    so placeholders inside a filled-in text stay as they are."""
    names = "|".join(re.escape(k) for k in fields) or "(?!)"
    parts = re.split(r"\{(" + names + r")\}", template)
    return F.concat(*[_c(fields[p]) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def role_template(role: str | Column, content: str | Column) -> Column:
    """Default chat layout of one message: ``<|role|>\\ncontent``."""
    return F.concat(F.lit("<|"), _c(role), F.lit("|>\n"), _c(content))


def verification_prompt(problem: str | Column, solution: str | Column, chain: str | Column | None = None,
                        instruction: str | None = None) -> Column:
    """The verification request. Inference form ends with the lead-in line; training form
    appends the chain as the assistant turn, adding the lead-in once when missing."""
    user = render_template(VERIFY_TEMPLATE.replace("{instruction}", instruction or VERIFY_INSTRUCTION),
                           {"problem": problem, "solution": solution})
    msg = role_template(F.lit("user"), user)
    if chain is None:
        return F.concat(msg, F.lit("\n" + VERIFY_LEAD))
    ch = _c(chain)
    ch = F.when(ch.contains(VERIFY_LEAD), ch).otherwise(F.concat(F.lit(VERIFY_LEAD + "\n"), ch))
    return F.concat(msg, F.lit("\n"), role_template(F.lit("assistant"), ch))


def training_prompt(problem: str | Column, solution: str | Column, chain: str | Column) -> Column:
    """Training form with a think block — the text after ``</think>`` is moved outside the message."""
    ch = _c(chain)
    inner = F.substring_index(ch, "</think>", 1)
    after = F.substr(ch, F.instr(ch, "</think>") + F.lit(len("</think>")))
    inner = F.when(inner.contains(VERIFY_LEAD), inner).otherwise(F.replace(inner, F.lit("<think>"), F.lit("<think>\n" + VERIFY_LEAD)))
    user = render_template(VERIFY_TEMPLATE.replace("{instruction}", VERIFY_INSTRUCTION), {"problem": problem, "solution": solution})
    body = F.concat(role_template(F.lit("user"), user), F.lit("\n"), role_template(F.lit("assistant"), inner), F.lit("</think>"), after)
    return F.when(ch.contains("</think>"), body).otherwise(verification_prompt(problem, solution, chain))


def analysis_prompt(problem: str | Column, solution: str | Column, analysis: str | Column | None = None) -> Column:
    """The plain analysis prompt, without or with an analysis turn."""
    user = F.concat(F.lit(ANALYSIS_INSTRUCTION + "\n\nQuestion: "), _c(problem), F.lit("\n\n"), _c(solution))
    if analysis is None:
        return F.concat(user, F.lit("\n\n"))
    return F.concat(user, F.lit("\n\nAnalysis:\n"), _c(analysis))


def code_prompt(question: str | Column, starter: str | Column, with_format: str = "Use the starter code.",
                without_format: str = "Read the inputs from stdin and write the answer to stdout.") -> Column:
    """A coding-question prompt with or without starter code."""
    st = _c(starter)
    fmt = F.when(st.isNotNull(), F.concat(F.lit(with_format + "\n```python\n"), st, F.lit("\n```\n\n"))).otherwise(
        F.lit(without_format + "\n```python\n# YOUR CODE HERE\n```\n\n"))
    return F.concat(F.lit(CODE_PREAMBLE + "\n\nQuestion: "), _c(question), F.lit("\n\n"), fmt)


def conversation(system: str | Column, prompt: str | Column, response: str | Column | None = None) -> Column:
    """System, user and (when not empty) assistant messages as ARRAY<STRUCT<role, content>>."""
    msgs = [F.struct(F.lit("system").alias("role"), _c(system).alias("content")),
            F.struct(F.lit("user").alias("role"), _c(prompt).alias("content"))]
    base = F.array(*msgs)
    if response is None:
        return base
    r = _c(response)
    return F.when(r != "", F.concat(base, F.array(F.struct(F.lit("assistant").alias("role"), r.alias("content"))))).otherwise(base)


def chat_text(df: DataFrame, by: Sequence[str], turn: str, role: str, text: str) -> DataFrame:
    """P7 on a long message table: one chat text per conversation, messages in turn order
    (a sink-side regroup: one row per conversation)."""
    msgs = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), role_template(F.col(role), F.col(text)).alias("m"))))
    g = df.groupBy(*by).agg(msgs.alias("_m"), F.count(F.lit(1)).alias("n_turns"))
    return g.select(*by, "n_turns", F.array_join(F.transform("_m", lambda x: x["m"]), "\n").alias("chat"))


def mark_steps(steps: str | Column, style: str = "tag") -> Column:
    """Step marks for a scorer — ``tag`` joins steps with a step tag and ends with one;
    ``numbered`` writes ``Step i: …`` with a mark at each step; ``blank`` marks each blank-line break."""
    arr = _c(steps)
    if style == "tag":
        return F.concat(F.array_join(arr, STEP_TAG), F.lit(STEP_TAG))
    if style == "numbered":
        return F.array_join(F.transform(arr, lambda x, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), x, F.lit(" ки"))), "\n")
    if style == "blank":
        return F.concat(F.array_join(arr, " ки\n\n"), F.lit(" ки"))
    raise ValueError(f"unknown mark style {style!r}")


def rewrite_answer_phrase(col: str | Column) -> Column:
    """P9: "The answer is" → "The final answer is" for scorers trained on that phrase."""
    return F.replace(_c(col), F.lit("The answer is"), F.lit("The final answer is"))


def attach_demos(df: DataFrame, demos: DataFrame, key: str, k: int, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """The first k demonstrations of a benchmark (demo table ``key, idx, input, output``) as
    ARRAY<STRUCT<input, output>> per row (at most k per benchmark: a bounded table AQE broadcasts);
    benchmark aliases map several names to one demo list."""
    d = demos
    if aliases:
        m = F.create_map(*[e for a, b in aliases.items() for e in (F.lit(a), F.lit(b))])
        df = df.withColumn("_demo_key", F.coalesce(m[F.col(key)], F.col(key)))
    else:
        df = df.withColumn("_demo_key", F.col(key))
    first = d.filter(F.col("idx") < k).groupBy(F.col(key).alias("_demo_key")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "input", "output"))),
                    lambda x: F.struct(x["input"].alias("input"), x["output"].alias("output"))).alias("demos"))
    return df.join(first, "_demo_key", "left").drop("_demo_key")


# ---- fixed values that must equal the reference's: few-shot templates (input, output, splitter) ----
FEW_SHOT_TEMPLATES: dict[str, tuple[str, ...]] = {
    "direct": ("Question: {input}\nAnswer: ", "{output}", "\n\n"),
    "cot": ("Question: {input}\nAnswer: ", "{output}", "\n\n\n"),
    "pal": ("Question: {input}\n\n", "{output}", "\n---\n"),
    "tool-integrated": ("Question: {input}\n\nSolution:\n", "{output}", "\n---\n"),
    "self-instruct": ("<|user|>\n{input}\n<|assistant|>\n", "{output}", "\n"),
    "tora": ("<|user|>\n{input}\n<|assistant|>\n", "{output}", "\n"),
    "wizard_zs": ("### Instruction:\n{input}\n\n### Response: Let's think step by step.", "{output}", "\n\n\n"),
    "platypus_fs": ("### Instruction:\n{input}\n\n### Response:\n", "{output}", "\n\n\n"),
    "deepseek-math": ("User: {input}\nPlease reason step by step, and put your final answer within \\boxed{}.\n\nAssistant:",
                      "{output}", "\n\n\n"),
    "kpmath": ('User: Please reason step by step and put your final answer at the end with "The answer is: ".\n\n{input}\n\nAssistant:',
               "{output}"),
    "jiuzhang": ("## Question\n{input}\n\n## Solution\n", "{output}", "\n\n\n"),
    "jiuzhang_tora": ("## Question\n{input}\n\n## Code Solution\n", "{output}", "\n\n\n"),
    "jiuzhang_nl": ("## Question\n{input}\n\n## Natural Language Solution\n", "{output}", "\n\n\n"),
    "mmiqc": ('Please solve the following problem and put your answer at the end with "The answer is: ".\n\n{input}\n\n',
              "{output}", "\n\n\n"),
    "abel": ("Question:\n{input}\nAnswer:\nLet's think step by step.\n", "{output}", "\n\n"),
    "shepherd": ("{input}\n", "{output}", "\n\n\n"),
    "qwen-boxed": ("<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\n{input}\nPlease reason step by "
                   "step, and put your final answer within \\boxed{}.<|im_end|>\n<|im_start|>assistant\n", "{output}", "\n\n"),
    "qwen25-math-cot": ("<|im_start|>system\nPlease reason step by step, and put your final answer within \\boxed{}.<|im_end|>\n"
                        "<|im_start|>user\n{input}<|im_end|>\n<|im_start|>assistant\n", "{output}", "\n\n"),
    "mathstral": ("{input}\nPlease reason step by step, and put your final answer within \\boxed{}.", "{output}", "\n\n"),
    "internlm-math-fs": ("Question:{input}\nAnswer:", "{output}", "\n"),
    "internlm-math-chat": ("<|im_start|>user\n{input}<|im_end|>\n<|im_start|>assistant\n", "{output}", "\n\n"),
    "mistral": ("[INST] {input}[/INST]", "{output}", "\n\n"),
    "numina": ("### Problem: {input}\n### Solution:", " {output}", "\n\n"),
}
PLATYPUS_WRAPPER = ("Below is an instruction that describes a task. Write a response that appropriately completes the "
                    "request.\n\n### Instruction:\n{instruction}\n\n### Response:\n")
TOOL_PREAMBLE = (
    "Integrate step-by-step reasoning and Python code to solve math problems using the following guidelines:\n\n"
    "- Analyze the question and write functions to solve the problem; the function should not take any arguments.\n"
    "- Present the final result in LaTeX using a `\\boxed{}` without any units.\n"
    "- Utilize the `pi` symbol and `Rational`` from Sympy for $\\pi$ and fractions, and simplify all fractions and square "
    "roots without converting them to decimal values.\n\nHere are some examples you may refer to:\n\n---\n\n"
)
# ------------------------------------------------------------------------------------------------------


def _fill(template: str, key: str, value: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{" + key + "}"), value)


def few_shot_prompt(question: str | Column, demos: str | Column, template: str) -> Column:
    """P5: the few-shot prompt for one template — demonstrations (ARRAY<STRUCT<input, output>>)
    rendered and joined by the template's splitter, then the question; no demos → the question
    alone; the instruction wrapper (``platypus_fs``) and the tool preamble (``tora``,
    ``tool-integrated``) applied; outer spaces stripped."""
    if template not in FEW_SHOT_TEMPLATES:
        raise ValueError(f"unknown prompt template {template!r}")
    parts = FEW_SHOT_TEMPLATES[template]
    if len(parts) < 3:
        raise ValueError(f"prompt template {template!r} has no splitter")
    inp, out, sep = parts
    q, d = _c(question), _c(demos)
    if template == "qwen25-math-cot":
        demo_text = F.array_join(F.transform(d, lambda x: F.concat(x["input"], F.lit("\n"), x["output"])), sep)
        with_demos = _fill(inp, "input", F.concat(demo_text, F.lit(sep), q))
    else:
        demo_text = F.array_join(F.transform(d, lambda x: F.concat(_fill(inp, "input", x["input"]), _fill(out, "output", x["output"]))), sep)
        with_demos = F.concat(demo_text, F.lit(sep), _fill(inp, "input", q))
    full = F.when(F.coalesce(F.length(demo_text), F.lit(0)) == 0, _fill(inp, "input", q)).otherwise(with_demos)
    if template == "platypus_fs":
        full = _fill(PLATYPUS_WRAPPER, "instruction", full)
    if template in ("tora", "tool-integrated"):
        full = F.concat(F.lit(TOOL_PREAMBLE), full)
    return F.regexp_replace(full, r"^ +| +$", "")
