"""Literal golden cases (FIXTURES §3), table-driven: input → expected output per function."""

import pytest
from pyspark.sql import functions as F

from stepjudge.functions import answers as A
from stepjudge.functions import verdicts as VD
from stepjudge.operators import metrics as M
from stepjudge.operators import steps as ST
from stepjudge.operators import votes as V

EXTRACT = [
    ("so \\boxed{\\frac{1}{2}}.", "\\frac{1}{2}"),
    ("The answer is 42.", "42"),
    ("Total 1,234 then 5,678", "5678"),
    ("no digits here", ""),
    ("\\boxed{3.00}", "3"),
    ("\\boxed{50\\%}", "50"),
    ("\\boxed{x=5}", "5"),
    ("\\boxed{3/4}", "\\frac{3}{4}"),
    ("\\boxed{\\dfrac12}", "\\frac{1}{2}"),
    ("\\boxed{5 cm}", "5"),
    ("\\boxed{}", ""),
    ("the final answer is $7$. I hope it is correct.", "7"),
]


def test_extract_answer(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(EXTRACT)], "i int, t string")
    got = {r.i: r.a for r in A.extract_answers(df, "t", "a").collect()}
    assert [got[i] for i in range(len(EXTRACT))] == [e for _, e in EXTRACT]


CHOICE = [("The answer is (B).", "B", "B"), ("so the choice is c", "C", "C")]


def test_choices(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in CHOICE], "t string")
    rows = df.select(A.clean_choice("t").alias("c"), A.extract_choice("t").alias("e")).collect()
    assert [(r.c, r.e) for r in rows] == [(c, e) for _, c, e in CHOICE]


def test_parse_number(spark):
    df = spark.createDataFrame([("1,234.5",), ("50%",), ("1/2",), ("1d",), ("12\\%",)], "t string")
    assert [r.n for r in df.select(A.parse_number("t").alias("n")).collect()] == [1234.5, 0.5, None, None, 0.12]


EQUAL = [("0.5", "50", True), ("(1,2)", "[1,2]", True), ("(A)", "A", True), ("3", "4", False),
         ("1/2", "0.5", True), ("\\frac{1}{2}", "0.5", True), (None, "1", False), ("", "0", False),
         ("x=5", "5", True), ("7", "y = 7.0", True), ("length=5", "5", False), ("(1/2,3)", "(0.5,3)", True), ("(1/2,3)", "(0.5,4)", False),
         ("\\begin{pmatrix}1 & 2\\\\3 & 1/2\\end{pmatrix}", "\\begin{pmatrix}1&2\\\\ 3&0.5\\end{pmatrix}", True),
         ("\\begin{pmatrix}1 & 2\\end{pmatrix}", "\\begin{pmatrix}1 & 3\\end{pmatrix}", False), ("(1,2)", "(1,2,3)", False)]


def test_answers_equal(spark):
    df = spark.createDataFrame([(a, b) for a, b, _ in EQUAL], "a string, b string")
    got = [r.e for r in df.select(A.answers_equal("a", "b").alias("e")).collect()]
    assert got == [e for _, _, e in EQUAL]


def test_pass_at_k(spark):
    df = spark.createDataFrame([(5, 0, 1), (5, 5, 1), (5, 2, 3)], "n int, c int, k int")
    got = [round(r.p, 6) for r in df.select(M.pass_at_k("n", "c", "k").alias("p")).collect()]
    assert got == [0.0, 1.0, 0.9]


def _steps(spark, labels):
    rows = [(p, i, lab) for p, seq in enumerate(labels) for i, lab in enumerate(seq)]
    return spark.createDataFrame(rows, "problem_id long, step_idx long, gt_label string")


def _as_lists(df, col):
    out = {}
    for r in df.orderBy("problem_id", "step_idx").collect():
        out.setdefault(r.problem_id, []).append(r[col])
    return [out[k] for k in sorted(out)]


def test_repair_labels(spark):
    s = _steps(spark, [list("-+-"), list("--"), list("+-+")])
    assert _as_lists(ST.repair_labels(s), "label") == [list("++-"), list("--"), list("+++")]


def test_until_first_error_and_propagate(spark):
    assert _as_lists(ST.until_first_error(_steps(spark, [list("+--"), list("++")])), "gt_label") == [list("+-"), list("++")]
    assert _as_lists(ST.propagate_error(_steps(spark, [list("+-+")])), "label") == [list("+--")]
    assert _as_lists(ST.first_error_mask(_steps(spark, [list("+--+")])), "mask") == [[1, 1, 0, 0]]


def test_aggregate_steps(spark):
    df = spark.createDataFrame([([0.9, 0.5, 0.8],)], "s array<double>")
    r = df.select(*[V.aggregate_steps("s", h).alias(h) for h in ("min", "prod", "last")]).first()
    assert (r["min"], round(r["prod"], 6), r["last"]) == (0.5, 0.36, 0.8)
    with pytest.raises(ValueError):
        V.aggregate_steps("s", "mean")


def test_vote_majority_first_on_ties(spark):
    rows = [(0, i, a, a, 1.0) for i, a in enumerate("abac")] + [(1, i, a, a, 1.0) for i, a in enumerate("ba")]
    df = spark.createDataFrame(rows, "problem_id long, idx long, answer string, answer_key string, score double")
    got = {r.problem_id: r.pred for r in V.vote_majority(df).collect()}
    assert got == {0: "a", 1: "b"}


def test_boxed_verdicts(spark):
    df = spark.createDataFrame([("\\boxed{\\text{correct}} then \\boxed{7} and \\boxed{incorrect}",)], "t string")
    assert df.select(VD.boxed_verdicts("t").alias("v")).first().v == [True, False]


def test_retrieve_gold_truncate_middle(spark):
    df = spark.createDataFrame([("so ... #### 72", "abcdefgh")], "g string, t string")
    r = df.select(A.retrieve_gold("g").alias("g"), A.truncate_middle("t", 4).alias("t")).first()
    assert (r.g, r.t) == ("72", "ab...gh")


def test_difficulty_level(spark):
    df = spark.createDataFrame([(0.1,), (0.4,), (0.9,)], "m double")
    cuts = F.array(*[F.lit(x) for x in (0.2, 0.4, 0.6, 0.8)])
    assert [r.l for r in df.select(M.difficulty_level("m", cuts).alias("l")).collect()] == [5, 3, 1]


def test_run_succeeded(spark):
    df = spark.createDataFrame([("ValueError: x",), ("good",)], "t string")
    assert [r.ok for r in df.select(A.run_succeeded("t").alias("ok")).collect()] == [False, True]


def test_trace_round_trip(spark):
    trace = "Let me compute.\n```python\nx = 1\nprint(x)\n```\n```output\n1\n```\nSo the answer is 1."
    df = spark.createDataFrame([(trace,)], "t string")
    r = df.select(A.segment_trace("t").alias("s")).select(F.col("s"), A.join_trace("s").alias("j")).first()
    assert [x.role for x in r.s] == ["rationale", "program", "output", "rationale"]
    assert r.j == trace


def test_words_to_number(spark):
    df = spark.createDataFrame([("twenty one",), ("one hundred and five",), ("five apples",)], "t string")
    assert [r.n for r in df.select(A.words_to_number("t").alias("n")).collect()] == ["21", "105", "five apples"]


def test_pad_after_error_and_cut(spark):
    text = "Step 1: a. Correct? Yes.\nStep 2: b. Correct? No.\nStep 3: c. Correct? Yes."
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(VD.pad_after_error(F.col("t"), F.lit(2), F.lit(3)).alias("p")).first().p
    assert r == ["Step 1: a. Correct? Yes.", "Step 2: b. Correct? No.", "Step 3: Follows an incorrect step. Correct? No."]
    boxed = "x \\boxed{correct}\ny\nz \\boxed{incorrect}\nw"
    df2 = spark.createDataFrame([(boxed,)], "t string")
    assert df2.select(VD.cut_after_kth_verdict(F.col("t"), F.lit(2)).alias("c")).first().c == "x \\boxed{correct}\ny\nz \\boxed{incorrect}"
    assert df2.select(VD.truncate_after_last_verdict(F.col("t")).alias("c")).first().c == "x \\boxed{correct}\ny\nz \\boxed{incorrect}"


def test_conform_and_typed(spark):
    df = spark.createDataFrame([("x", "B", "The answer is (B)."), ("A,C", "AC", ""), ("7", "7", "")],
                               "p string, g string, t string")
    assert [r.c for r in df.select(A.conform_choice("p", "g", "t").alias("c")).collect()] == ["B", "AC", "7"]
    d2 = spark.createDataFrame([("Yes it is",), ("so x = 12 cm",), ("(b) is it",), ("\\boxed{3}",)], "t string")
    assert [r.a for r in d2.select(A.extract_typed_answer("t").alias("a")).collect()] == ["True", "12", "(b) is it", "3"]


def test_rough_match_and_loose(spark):
    df = spark.createDataFrame([("first 3\nso we get $12 apples", "12"), ("total: 5 + 7", "12"), ("x=12 at the end", "12")],
                               "t string, g string")
    assert [r.m for r in df.select(A.rough_match("t", "g").alias("m")).collect()] == [True, False, False]
    d2 = spark.createDataFrame([("$1,000", "1000"), ("50%", "0.5"), ("abc", "1")], "a string, b string")
    assert [r.c for r in d2.select(A.loose_numbers_close("a", "b").alias("c")).collect()] == [True, True, False]


def test_clean_expression(spark):
    df = spark.createDataFrame([("2**3 * x",), ("\\dfrac12",), ("sqrt(16)",)], "t string")
    assert [r.c for r in df.select(A.clean_expression("t").alias("c")).collect()] == ["2^3 \\times  x", "\\frac{1}{2}", "\\sqrt{16}"]


def test_programs_and_lines_after(spark):
    trace = ("a\n```python\nimport math\nprint(1)\n```\n```output\nTraceback: boom\n```\n"
             "b\n```python\nx = 2\nprint(x)\n```\n```output\n2\n```")
    df = spark.createDataFrame([(trace, "[action] go\nnext\n[action] stop\nlast")], "t string, a string")
    r = df.select(A.programs("t").alias("p"), A.lines_after("a").alias("l")).first()
    assert r.p == "import math\n\nx = 2\nprint(x)\n"  # that output names no error word
    assert r.l == ["next", "last"]


def test_last_or_mean_or(spark):
    df = spark.createDataFrame([([1.0, 2.0, 6.0],), ([],)], "a array<double>")
    r = df.select(A.last_or("a").alias("l"), A.mean_or("a").alias("m")).collect()
    assert [(x.l, x.m) for x in r] == [(6.0, 3.0), (0.0, 0.0)]


def test_beam_round_and_finish(spark):
    from stepjudge.operators import search as SE
    beams = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "problem_id long, beam_id long, text string")
    exp = spark.createDataFrame([(1, 0, 0, "x", None, 0.9), (1, 0, 1, "y", "EOS", 0.8), (1, 1, 0, "x", None, 0.7),
                                 (1, 1, 1, "", None, 0.95)],
                                "problem_id long, beam_id long, exp_idx long, next_text string, stop_reason string, score double")
    active, done = SE.beam_round(beams, exp, n=4, width=2)
    assert sorted(r.text for r in active.collect()) == ["ax", "ax", "bx", "bx"]
    assert sorted(r.text for r in done.collect()) == ["ay", "b"]
    fin = SE.beam_finish(done, 2).first()
    assert fin.pred == "b" and len(fin.completions) == 2
    tr = SE.tree_round(beams, exp, width=2).orderBy("beam_id").collect()
    assert [(r.text, r.stopped) for r in tr] == [("ax", False), ("b", True)]


def test_step_sequences_same_label(spark):
    from stepjudge.operators.sequences import step_sequences
    steps = spark.createDataFrame([(1, 0, "a b", "+"), (1, 1, "c", "-")], "problem_id long, step_idx long, step string, gt_label string")
    qs = spark.createDataFrame([(1, "q w e", "1")], "problem_id long, question string, sol string")
    r = step_sequences(steps, qs).first()
    assert len(r.input_ids) == 3 + 5 + 4 and r.labels.count(2) == 1 and r.labels.count(3) == 1
    assert r.loss_mask_with_first_error_only.count(1) == 2
    r2 = step_sequences(steps, qs, solution_label="sol").first()
    assert r2.labels.count(2) == 2 and r2.labels.count(3) == 0


def test_question_text_layouts(spark):
    from stepjudge.plans.benchmarks import gold_answer, question_text
    sat = spark.createDataFrame([(" What? ", "A) 1 B) 2 C) 3 D) 4", "B")], "question string, options string, Answer string")
    assert question_text(sat, "sat_math").first().question == "What?\nAnswer Choices: (A) 1 (B) 2 (C) 3 (D) 4"
    gk = spark.createDataFrame([("Q", {"A": "x", "B": "y"}, "A")], "question string, options map<string,string>, label string")
    assert question_text(gk, "gaokao_math_qa").first().question == "Q\n选项: (A) x (B) y"
    aq = spark.createDataFrame([("Q", ["A)1", "B)2"], "A")], "question string, options array<string>, correct string")
    assert question_text(aq, "aqua").first().question == "Q\nAnswer Choices: (A) 1 (B) 2"
    gs = spark.createDataFrame([("q", "steps #### 1,234")], "question string, answer string")
    assert gold_answer(gs, "gsm8k").first().gold == "1,234"  # commas stay; equality drops them
    mm = spark.createDataFrame([("q", ["a", "b", "c", "d"], 2)], "question string, choices array<string>, answer int")
    assert gold_answer(mm, "mmlu_stem").first().gold == "C"


def test_prompt_helpers(spark):
    from stepjudge.functions import prompts as P
    df = spark.createDataFrame([("Q", "S1\nS2", "<think>\nchk</think>\nIs the solution correct? Yes", None, ["a", "b"])],
                               "q string, s string, c string, starter string, steps array<string>")
    r = df.select(
        P.analysis_prompt("q", "s").alias("a"),
        P.training_prompt("q", "s", "c").alias("t"),
        P.code_prompt("q", "starter").alias("code"),
        P.conversation(F.lit("sys"), "q", F.lit("")).alias("conv"),
        P.mark_steps("steps", "tag").alias("m1"),
        P.mark_steps("steps", "numbered").alias("m2"),
        P.rewrite_answer_phrase(F.lit("The answer is 4")).alias("rw"),
    ).first()
    assert r.a.endswith("Question: Q\n\nS1\nS2\n\n")
    assert "<think>\nLet's verify step by step:\nchk" in r.t and r.t.endswith("</think>\nIs the solution correct? Yes")
    assert r.code.endswith("# YOUR CODE HERE\n```\n\n")
    assert [m.role for m in r.conv] == ["system", "user"]
    assert r.m1 == "a<extra_0>b<extra_0>"
    assert r.m2 == "Step 1: a ки\nStep 2: b ки"
    assert r.rw == "The final answer is 4"
    with pytest.raises(ValueError):
        P.few_shot_prompt(F.lit("q"), F.array(), "kpmath")


def test_confidence_extremes(spark):
    from stepjudge.operators import scoring as SC
    df = spark.createDataFrame([(-800.0, -900.0, [-800.0, -900.0, -1000.0])], "y double, n double, a array<double>")
    r = df.select(SC.confidence("y", "n").alias("c"), SC.softmax("a").alias("s")).first()
    assert abs(r.c - 1.0) < 1e-12
    assert abs(sum(r.s) - 1.0) < 1e-12 and r.s[0] > 0.999
    lp = spark.createDataFrame([(1, 0, -0.1, -2.3, " Yes"), (1, 1, -3.0, -0.05, "No "), (1, 2, -1.0, -1.0, " maybe")],
                               "gen_id long, pos long, yes double, no double, top string")
    got = SC.scores_from_logprobs(lp, "gen_id", "pos", "yes", "no", "top").orderBy("pos").collect()
    assert [g.pos for g in got] == [0, 1] and got[0].confidence > 0.9 and got[1].confidence < 0.1


def _one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_answer_keys_are_exact(spark):
    key = lambda t: _one(spark, A.answer_key(F.lit(t)))
    same = [("1/2", "0.5"), ("\\frac{-2}{4}", "-0.50"), ("50%", "1/2"), ("1,000", "1e3"), ("0", "-0.0"), ("007", "7"), ("-1/-2", "2/4")]
    assert all(key(a) == key(b) for a, b in same)
    apart = [("9007199254740993", "9007199254740992"), ("0.00000000001", "0"), ("1/3", "0.3333333333"), ("x", "y"), ("1" * 50, "1" * 49 + "2"), ("1/0", "1")]
    assert all(key(a) != key(b) for a, b in apart)
    assert key("3/6") == "n:1/2" and key("x+1") == "t:x+1" and key("1/0") == "t:1/0"


def test_judge_solved_percent_and_last_number(spark):
    judge = lambda a, b: _one(spark, A.judge_answer(F.lit(a), F.lit(b)))
    assert judge("007", "7") and judge("-0", "0") and judge("1.50", "1.5") and judge("a", "a")
    assert not judge("9" * 33, "9" * 32 + "8") and not judge("a", "b") and not judge(None, "1")
    solved = lambda a, b: _one(spark, A.is_solved(F.lit(a), F.lit(b)))
    assert solved("so ... The answer is $1,072", "x #### 1,072") and not solved("no phrase 72", "#### 72")
    pct = lambda t: _one(spark, A.percent_to_fraction(F.lit(t)))
    assert pct("12.5% of 50%") == "0.125 of 0.5" and pct("5 % and 0.02%") == "5 % and 0.0002"
    last = lambda t: _one(spark, A.last_number(F.lit(t)))
    assert [last(t) for t in ("about .5", "1,234.", "-3 to -4.50", "none")] == ["5", "1234.", "-4.50", ""]


def test_traces_and_failed_programs(spark):
    prog = lambda *lines: "```python\n" + "\n".join(lines) + "\n```\n"
    out = lambda t: "```output\n" + t + "\n```\n"
    ok, bad = prog("import a", "print(1)") + out("1"), prog("import b", "x = 1") + out("NameError")
    run = lambda t, last=False: _one(spark, A.programs(F.lit(t), last))
    assert run(ok + bad, True) == "import b\nimport a\nprint(1)\n" and run(bad + ok) == "import b\nimport a\nprint(1)\n"
    assert run(bad) == "import b\n" and run("text only") == "" and run(ok + "so\n" + prog("y = 2")[:-1]) == "import a\n\ny = 2\n"
    assert run("```python\n```\n") == A.INVALID_TRACE and run(prog("x")[:-4] + "```python\n") == A.INVALID_TRACE
    outs = lambda t, last=True: _one(spark, A.outputs(F.lit(t), last))
    assert outs(ok + bad) == "NameError" and outs("none") == "" and outs(ok + bad, False) == ["1", "NameError"]
    assert [_one(spark, A.run_succeeded(F.lit(t))) for t in ("cannot solve", "NaN", "Traceback", "...", "fine")] == [False, False, True, False, True]


def test_template_fields_are_not_filled_twice(spark):
    from stepjudge.functions import prompts as P
    assert _one(spark, P.render_template("{a}/{b}/{c}", {"a": F.lit("{b}"), "b": F.lit("x")})) == "{b}/x/{c}"


def test_votes_agree_on_close_scores(spark):
    rows = [(0, 0, "a", "a", 0.9999991, "b"), (0, 1, "b", "b", 0.9999994, "b")]
    df = spark.createDataFrame(rows, "problem_id long, idx long, answer string, answer_key string, score double, gold_key string")
    assert M.scaling_table(df, [2]).first().acc_naive == 100.0
    assert V.vote_best(df).first().pred == "b" and V.vote_sweep(df, [2]).first().key_naive == "b"


def test_unfinished_paths_are_returned(spark):
    from stepjudge.operators import search as SE
    tree = spark.createDataFrame([(1, i, None if i == 0 else i - 1, str(i), 0.5, None) for i in range(4)],
                                 "problem_id long, node_id long, parent_id long, text string, score double, stop_reason string")
    got = SE.best_paths(tree, keep=2, n=2, rounds=2).collect()
    assert [(r.path, r.completed) for r in got] == [("012", False)]
    assert [(r.path, r.completed) for r in SE.best_paths(tree, keep=2, n=2, rounds=5).collect()] == [("0123", True)]


def test_null_group_is_split_when_hot(spark):
    from stepjudge.operators import ranking as RK
    df = spark.range(3000).withColumn("g", F.when(F.col("id") < 2500, F.lit(None)).otherwise(F.col("id") % 3))
    got = {r.id: r.rn for r in RK.number_within(df, ["g"], ["id"], "rn", hot_rows=1000).collect()}
    assert len(got) == 3000 and all(got[i] == i + 1 for i in range(2500))
