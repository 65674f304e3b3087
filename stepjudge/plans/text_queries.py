"""Answer-text and prompt queries over the driver's text tables (documents, conversations).

Each query runs its Column functions over whole texts. The DuckDB oracles recompute the same
result with DuckDB string and regex functions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stepjudge.functions import answers as A
from stepjudge.functions import prompts as P
from stepjudge.functions import tables
from stepjudge.functions import verdicts as V
from stepjudge.plans.registry import query
from stepjudge.operators.ranking import top_k_within
from stepjudge.sources import fixtures as X

_DOC_PRED_SQL = """
WITH d AS (SELECT doc_id, n_chars,
    COALESCE(regexp_extract_all(replace(text, ',', ''), '-?[0-9]*\\.?[0-9]+')[-1], '') AS raw FROM documents),
p AS (SELECT doc_id, n_chars, regexp_replace(regexp_replace(raw, '([0-9]+)\\.0*$', '\\1'), '^\\.', '0.') AS pred FROM d)
"""


def _doc_preds(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    return A.extract_answers(d, "text", "pred")


@query("grade_documents", _DOC_PRED_SQL + """,
g AS (SELECT doc_id, pred, CAST(n_chars % 10 AS VARCHAR) AS gold, TRY_CAST(pred AS DOUBLE) AS pv, CAST(n_chars % 10 AS DOUBLE) AS gv FROM p)
SELECT doc_id, pred, CASE WHEN pred = '' THEN FALSE WHEN lower(pred) = gold THEN TRUE
  WHEN pv IS NOT NULL THEN (abs(pv - gv) <= 1e-4 * greatest(abs(pv), abs(gv)) OR abs(pv - gv / 100) <= 1e-4 * greatest(abs(pv), abs(gv / 100))
                            OR abs(pv - gv * 100) <= 1e-4 * greatest(abs(pv), abs(gv * 100)))
  ELSE FALSE END AS correct FROM g""")
def q_grade_documents(spark, sf):
    """Extract the final answer of every document, grade it against a gold derived from the row."""
    from stepjudge.plans.curate import grade_candidates
    d = X.table(spark, sf, "documents").select("doc_id", "text", (F.col("n_chars") % 10).cast("string").alias("gold"))
    return grade_candidates(d, "text", "gold", out="correct").select("doc_id", "pred", "correct")


@query("count_empty", _DOC_PRED_SQL + """
SELECT count(*) FILTER (WHERE pred = '') AS empty_samples, count(*) AS num_samples FROM p""")
def q_count_empty(spark, sf):
    from stepjudge.operators.metrics import count_empty
    return count_empty(_doc_preds(spark, sf), "pred")


@query("last_number", """
SELECT doc_id, COALESCE(regexp_extract_all(replace(text, ',', ''), '-?[0-9]+\\.?[0-9]*')[-1], '') AS last_number FROM documents""")
def q_last_number(spark, sf):
    d = X.table(spark, sf, "documents")
    return d.select("doc_id", A.last_number("text").alias("last_number"))


@query("split_steps", """
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS st FROM documents)
SELECT doc_id, CAST(len(st) AS BIGINT) AS n_steps,
  md5(array_to_string(list_transform(st, lambda x, i: 'Step ' || CAST(i AS VARCHAR) || ': ' || x), chr(10))) AS digest FROM s""")
def q_split_steps(spark, sf):
    """H5 + H6: every document split into steps and renumbered (the whole step list is digested)."""
    d = X.table(spark, sf, "documents").withColumn("st", A.number_steps(A.split_steps("text", "newline")))
    return d.select("doc_id", F.size("st").cast("bigint").alias("n_steps"), F.md5(F.array_join("st", "\n")).alias("digest"))


@query("truncate_middle", """
SELECT doc_id, CASE WHEN length(text) > 400 THEN substr(text, 1, 200) || '...' || substr(text, length(text) - 199, 200)
  ELSE text END AS short_text FROM documents""")
def q_truncate_middle(spark, sf):
    d = X.table(spark, sf, "documents")
    return d.select("doc_id", A.truncate_middle("text", 400).alias("short_text"))


@query("clean_trajectory", """
SELECT doc_id, trim(split_part(trim(text), chr(10) || chr(10), 1)) AS cleaned FROM documents""")
def q_clean_trajectory(spark, sf):
    d = X.table(spark, sf, "documents")
    return d.select("doc_id", A.clean_trajectory("text").alias("cleaned"))


@query("cut_at_stop_words", """
SELECT doc_id, CAST(length(split_part(split_part(text, chr(10) || chr(10) || chr(10), 1), 'Question:', 1)) AS BIGINT) AS kept_chars
FROM documents""")
def q_cut_at_stop_words(spark, sf):
    d = X.table(spark, sf, "documents")
    return d.select("doc_id", F.length(A.cut_at_stop_words("text", ["\n\n\n", "Question:"])).cast("bigint").alias("kept_chars"))


@query("render_template", """
SELECT doc_id, CAST(length('[' || lang || '/' || source || '] ' || text) AS BIGINT) AS n_chars_rendered,
  md5('[' || lang || '/' || source || '] ' || text) AS digest FROM documents""")
def q_render_template(spark, sf):
    d = X.table(spark, sf, "documents")
    r = P.render_template("[{lang}/{source}] {text}", {"lang": F.col("lang"), "source": F.col("source"), "text": F.col("text")})
    return d.select("doc_id", F.length(r).cast("bigint").alias("n_chars_rendered"), F.md5(r).alias("digest"))


@query("chat_text", """
SELECT conv_id, count(*) AS n_turns,
  CAST(length(string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY turn)) AS BIGINT) AS n_chars,
  md5(string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY turn)) AS digest
FROM conversations GROUP BY conv_id""")
def q_chat_text(spark, sf):
    c = X.table(spark, sf, "conversations")
    t = P.chat_text(c, ["conv_id"], "turn", "role", "text")
    return t.select("conv_id", "n_turns", F.length("chat").cast("bigint").alias("n_chars"), F.md5("chat").alias("digest"))


@query("rough_match", r"""
WITH l AS (SELECT doc_id, CAST(n_chars % 10 AS DOUBLE) AS gold, string_split(text, chr(10)) AS al,
                  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9]')) AS dl FROM documents),
w AS (SELECT doc_id, gold, list_filter(regexp_split_to_array(trim(COALESCE(dl[-1], al[1])), '\s+'), lambda x: x <> '') AS ws FROM l),
v AS (SELECT doc_id, gold, ws, list_transform(ws, lambda x: replace(replace(replace(x, '$', ''), ',', ''), '$', '')) AS cl FROM w)
SELECT doc_id, COALESCE(list_bool_or(list_transform(ws, lambda x, i:
    NOT (i > 1 AND list_contains(['+', '-', '*', '/', '^'], ws[i - 1]))
    AND NOT (i < len(ws) AND list_contains(['+', '-', '*', '/', '^'], ws[i + 1]))
    AND regexp_matches(x, '[0-9]')
    AND COALESCE(abs(CASE WHEN ends_with(cl[i], '%')
                          THEN CASE WHEN regexp_full_match(rtrim(cl[i], '%'), '\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*')
                                    THEN CAST(rtrim(cl[i], '%') AS DOUBLE) / 100 END
                          WHEN regexp_full_match(cl[i], '\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*')
                          THEN CAST(cl[i] AS DOUBLE) END - gold) < 1e-3, FALSE)
    AND NOT contains(substr(x, i), '='))), FALSE) AS matched
FROM v""")
def q_rough_match(spark, sf):
    """H29 (+H25): does the last line with a digit state the gold number (n_chars mod 10)?"""
    d = X.table(spark, sf, "documents")
    return d.select("doc_id", A.rough_match(F.col("text"), (F.col("n_chars") % 10).cast("string")).alias("matched"))


@query("few_shot_prompt", r"""
WITH b AS (SELECT item_id, text, replace(trim(split_part(text, '####', -1)), ',', '') AS gold FROM benchmark),
demo AS (SELECT string_agg('Question: ' || text || chr(10) || 'Answer: ' || gold, chr(10) || chr(10) || chr(10) ORDER BY item_id) AS dp
         FROM (SELECT * FROM b ORDER BY item_id LIMIT 2))
SELECT item_id, CAST(length(p) AS BIGINT) AS n_chars, md5(p) AS digest FROM
 (SELECT item_id, regexp_replace(demo.dp || chr(10) || chr(10) || chr(10) || 'Question: ' || b.text || chr(10) || 'Answer: ', '^ +| +$', '', 'g') AS p
  FROM b, demo)""")
def q_few_shot_prompt(spark, sf):
    """P5 + C3: every benchmark item as a 2-shot 'cot' prompt whose demonstrations are the first two
    items of the same benchmark (the gold after ``####`` as the demo answer)."""
    # the table holds one benchmark; its name is a column so demos attach by an equi-join
    b = X.table(spark, sf, "benchmark").withColumn("bench", F.when(F.col("item_id").isNotNull(), F.lit("benchmark")))
    demos = b.select(F.col("bench"), F.col("item_id"), F.col("text").alias("input"), A.retrieve_gold("text").alias("output"))
    # only the first two items are demonstrations: a two-level top-k, never a whole benchmark in one window
    ranked = top_k_within(demos, ["bench"], ["item_id"], 2, "_pos", salt_cols=["item_id"])
    ranked = ranked.select("bench", "input", "output", (F.col("_pos") - 1).alias("idx"))
    with_demos = P.attach_demos(b, ranked, "bench", 2)
    p = P.few_shot_prompt(F.col("text"), F.col("demos"), "cot")
    return with_demos.select("item_id", F.length(p).cast("bigint").alias("n_chars"), F.md5(p).alias("digest"))


@query("filter_by_length", r"""
SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) <= 300""")
def q_filter_by_length(spark, sf):
    """Documents of at most 300 tokens (default whitespace tokenizer)."""
    from stepjudge.plans.curate import filter_by_length
    return filter_by_length(X.table(spark, sf, "documents").select("doc_id", "text"), "text", 300).select("doc_id")


@query("answer_only_labels", r"""
WITH t AS (SELECT doc_id,
  len(list_filter(regexp_split_to_array(split_part(text, chr(10), 1), '\s+'), lambda x: x <> '')) AS np,
  len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS na FROM documents)
SELECT doc_id, CAST(least(np + na, 512) AS BIGINT) AS n_labels, CAST(least(np, 512) AS BIGINT) AS n_ignored FROM t""")
def q_answer_only_labels(spark, sf):
    """Labels over (first line as prompt, whole text as answer): ignore-index on the prompt,
    answer ids after it, truncated to 512."""
    from stepjudge.operators.scoring import hash_tokenize
    from stepjudge.operators.sequences import IGNORE_INDEX, answer_only_labels
    d = X.table(spark, sf, "documents").select("doc_id", hash_tokenize(F.substring_index("text", "\n", 1)).alias("p"),
                                                 hash_tokenize(F.col("text")).alias("a"))
    lab = answer_only_labels("p", "a", 512)
    return d.select("doc_id", F.size(lab).cast("bigint").alias("n_labels"),
                    F.size(F.filter(lab, lambda x: x == IGNORE_INDEX)).cast("bigint").alias("n_ignored"))


@query("answers_equal", r"""
WITH p AS (SELECT l_orderkey, l_linenumber, l_linenumber % 6 AS form, l_partkey % 7 AS a, l_suppkey % 7 AS b FROM lineitem)
SELECT form, a, b, a = b AS equal, count(*) AS n FROM p GROUP BY ALL""")
def q_answers_equal(spark, sf):
    """Pairs of answers that are equal exactly when two digits of the row are, one form per branch:
    tuple with a fraction, matrix, ``v = x``, brackets of another kind, fractions, decimals."""
    li = X.table(spark, sf, "lineitem")
    p = li.select((F.col("l_linenumber") % 6).alias("form"), (F.col("l_partkey") % 7).alias("a"), (F.col("l_suppkey") % 7).alias("b"))
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    up = lambda c: (F.col(c) + 1).cast("string")
    forms = [
        (F.concat(F.lit("(1/2,"), a, F.lit(")")), F.concat(F.lit("(0.5,"), b, F.lit(")"))),
        (F.concat(F.lit("\\begin{pmatrix}"), a, F.lit(" & 1\\\\2 & 3\\end{pmatrix}")), F.concat(F.lit("\\begin{pmatrix}"), b, F.lit("&1\\\\ 2&3\\end{pmatrix}"))),
        (F.concat(F.lit("x = "), a), b),
        (F.concat(F.lit("["), a, F.lit(",2]")), F.concat(F.lit("("), b, F.lit(", 2.0)"))),
        (F.concat(F.lit("\\frac{"), up("a"), F.lit("}{16}")), F.concat(up("b"), F.lit("/16"))),
        (a, F.concat(b, F.lit(".0"))),
    ]
    left, right = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (x, y) in enumerate(forms):
        left, right = F.when(F.col("form") == i, x).otherwise(left), F.when(F.col("form") == i, y).otherwise(right)
    pairs = p.groupBy("form", "a", "b").agg(F.count(F.lit(1)).alias("n"))  # every distinct pair of answers is judged once
    pairs = pairs.withColumn("equal", A.answers_equal(left, right))
    return pairs.select(F.col("form").cast("bigint").alias("form"), F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), "equal", "n")


@query("trace_programs", """
WITH t AS (SELECT o_orderkey, o_orderstatus = 'F' AS fail1, o_orderpriority LIKE '1%' AS fail2, CAST(o_custkey AS VARCHAR) AS c FROM orders),
p AS (SELECT *, 'import a' || chr(10) || 'x = ' || c || chr(10) AS p1, 'from b import c' || chr(10) || 'y = 2' || chr(10) AS p2 FROM t)
SELECT o_orderkey, CAST(6 AS BIGINT) AS n_segments,
  CASE WHEN fail1 AND fail2 THEN 'import a' || chr(10) || 'from b import c' || chr(10)
       WHEN fail1 THEN 'import a' || chr(10) || p2 || 'print(y)' || chr(10)
       WHEN fail2 THEN 'from b import c' || chr(10) || p1 || 'print(x)' || chr(10)
       ELSE p1 || chr(10) || p2 || 'print(y)' || chr(10) END AS program,
  CASE WHEN fail2 THEN 'some ERROR here' ELSE 'two' END AS last_output FROM p""")
def q_trace_programs(spark, sf):
    """Two programs per order, each of which may have failed; what is kept of them."""
    o = X.table(spark, sf, "orders")
    out1 = F.when(F.col("o_orderstatus") == "F", "ValueError: x").otherwise("1")
    out2 = F.when(F.col("o_orderpriority").startswith("1"), "some ERROR here").otherwise("two")
    t = F.concat(F.lit("Plan\n```python\nimport a\nx = "), F.col("o_custkey").cast("string"), F.lit("\nprint(x)\n```\n```output\n"), out1,
                 F.lit("\n```\nthen\n```python\nfrom b import c\ny = 2\nprint(y)\n```\n```output\n"), out2, F.lit("\n```\n"))
    return o.select("o_orderkey", F.size(A.segment_trace(t)).cast("bigint").alias("n_segments"), A.programs(t).alias("program"), A.outputs(t).alias("last_output"))


def _by_sql(spark, sf, table, statement):
    """A statement over a table's own view, with the SQL table functions."""
    tables.register(spark)
    view = f"v_{uuid.uuid4().hex}"
    X.table(spark, sf, table).createOrReplaceTempView(view)
    return spark.sql(statement.replace("{view}", view))


@query("sql_text_steps", """
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS st FROM documents)
SELECT doc_id, unnest(range(len(st))) AS step_idx, unnest(st) AS step FROM s""")
def q_sql_text_steps(spark, sf):
    """The steps of every document from SQL."""
    return _by_sql(spark, sf, "documents", "SELECT d.doc_id, s.step_idx, s.step FROM {view} d, LATERAL text_steps(d.text) s")


@query("sql_text_segments", """
SELECT item_id, unnest(range(len(string_split(text, '. ')))) AS segment_idx, unnest(string_split(text, '. ')) AS segment FROM benchmark""")
def q_sql_text_segments(spark, sf):
    """The segments of every benchmark item from SQL."""
    return _by_sql(spark, sf, "benchmark", "SELECT b.item_id, s.segment_idx, s.segment FROM {view} b, LATERAL text_segments(b.text, '. ') s")


@query("sql_sweep_sizes", """
SELECT c_custkey, unnest(list_filter([1, 2, 4, 8, 16, 32], lambda x: x <= c_custkey % 40))::BIGINT AS size FROM customer""")
def q_sql_sweep_sizes(spark, sf):
    """The sizes of a sweep from SQL."""
    return _by_sql(spark, sf, "customer", "SELECT c.c_custkey, s.size FROM {view} c, LATERAL sweep_sizes(c.c_custkey % 40) s")


@query("verdict_helpers", """
SELECT o_orderkey, o_orderkey % 10 AS max_step, o_orderkey % 3 = 0 AS decided, CASE WHEN o_orderkey % 2 = 0 THEN 'before ' ELSE 'plain' END AS kept FROM orders""")
def q_verdict_helpers(spark, sf):
    """H41, H39 and H7 over a table: the largest step number named, the decision of a label, the text before the think block ends."""
    n = F.col("o_orderkey")
    o = X.table(spark, sf, "orders").select("o_orderkey")
    text = F.concat(F.lit("Step 0 and Step "), (n % 10).cast("string"), F.lit(" of 99"))
    label = F.when(n % 3 == 0, F.lit("\\boxed{Correct}")).otherwise(F.lit("\\boxed{incorrect}"))
    think = F.when(n % 2 == 0, F.lit("before </think> after")).otherwise(F.lit("plain"))
    return o.select("o_orderkey", V.max_step_number(text).cast("bigint").alias("max_step"), V.decision(label).alias("decided"), V.strip_thinking(think).alias("kept"))


@query("number_words", """
WITH o AS (SELECT o_orderkey, o_orderkey % 100 AS n, (o_orderkey // 100) % 10 AS h, o_orderkey % 7 AS k, o_orderkey % 9 AS d FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN CAST(n AS VARCHAR) WHEN 1 THEN CAST((CASE WHEN h = 0 THEN 1 ELSE h END) * 100 + n AS VARCHAR) WHEN 2 THEN CAST(1000 * n + 100 AS VARCHAR)
  WHEN 3 THEN CASE WHEN d = 0 THEN CAST(n AS VARCHAR) ELSE n || '.' || d END WHEN 4 THEN CAST((h * 10 + d) * 100000 AS VARCHAR) WHEN 5 THEN CAST(n * 1000 AS VARCHAR) ELSE 'about ' || n END AS number FROM o""")
def q_number_words(spark, sf):
    """H13 over generated words: tens and units, hundreds, "a hundred", decimals, scales of decimals, digits beside words, and a text that isn't a number."""
    o = X.table(spark, sf, "orders").select("o_orderkey")
    key = F.col("o_orderkey")
    n, h, k, d = key % 100, F.floor(key / 100) % 10, key % 7, key % 9
    small = F.array(*[F.lit(w) for w in A.SMALL_NUMBERS])
    tens = F.array(*[F.lit(w) for w in A.TENS])
    unit = lambda c: F.get(small, c.cast("int"))
    words = F.when(n < 20, unit(n)).when(n % 10 == 0, F.get(tens, (n / 10 - 2).cast("int"))).otherwise(
        F.concat(F.get(tens, F.floor(n / 10 - 2).cast("int")), F.lit("-"), unit(n % 10)))
    text = (
        F.when(k == 0, F.initcap(words)).when(k == 1, F.concat(F.when(h == 0, F.lit("a")).otherwise(unit(h)), F.lit(" hundred and "), words))
        .when(k == 2, F.when(n == 0, F.lit("a hundred")).otherwise(F.concat(words, F.lit(" thousand one hundred")))).when(k == 3, F.concat(words, F.lit(" point "), unit(d)))
        .when(k == 4, F.when(h * 10 + d == 0, F.lit("zero")).otherwise(F.concat(unit(h), F.lit(" point "), unit(d), F.lit(" million"))))
        .when(k == 5, F.when(n == 0, F.lit("zero")).otherwise(F.concat(n.cast("string"), F.lit(" thousand")))).otherwise(F.concat(F.lit("about "), n.cast("string"))))
    return o.select("o_orderkey", A.words_to_number(text).alias("number"))
