"""Fixture views over the driver tables (the stand-ins for candidates, steps, verdicts, ...).

Each view is defined twice, as a Spark DataFrame and as DuckDB SQL, with the same columns and
values. The Spark side uses the skew-safe numbering of ``operators.ranking`` for ``idx``/``step_idx``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepjudge.operators.ranking import number_within
from stepjudge.session import checkpoint_dir

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# order of the lines of one order; unique together with l_orderkey at every scale factor
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _numbered_lines(spark: SparkSession, sf_dir: str, cols: list[str], name: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER, *cols)
    return number_within(li, ["l_orderkey"], LINE_ORDER, name, base=0)


def _build_cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAND(problem_id, idx, answer, answer_key, score DECIMAL(18,6), gold_key)."""
    li = _numbered_lines(spark, sf_dir, ["l_returnflag", "l_linestatus", "l_discount"], "idx")
    st = table(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.min("o_orderstatus").alias("st"))
    rl = F.concat(F.col("l_returnflag"), F.col("l_linestatus"))
    answer = (
        F.when(rl == "AF", "0.5").when(rl == "AO", "1/2").when(rl == "NF", "7")
        .when(rl == "NO", "7.0").when(rl == "RF", "12").otherwise("12.00")
    )
    key = F.when(F.col("l_returnflag") == "A", "1/2").when(F.col("l_returnflag") == "N", "7").otherwise("12")
    gold = F.when(F.col("st") == "F", "1/2").when(F.col("st") == "O", "7").otherwise("12")
    return li.join(st, li.l_orderkey == st.o_orderkey).select(
        F.col("l_orderkey").alias("problem_id"),
        F.col("idx"),
        answer.alias("answer"),
        key.alias("answer_key"),
        F.round(F.col("l_discount") * 10, 1).cast("decimal(18,6)").alias("score"),
        gold.alias("gold_key"),
    )


def _build_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STEPS(problem_id, step_idx, step, gt_label '+'/'-', score DECIMAL(18,6), k)."""
    li = _numbered_lines(spark, sf_dir, ["l_linestatus", "l_tax"], "step_idx")
    return li.select(
        F.col("l_orderkey").alias("problem_id"),
        "step_idx",
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("step"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("gt_label"),
        F.round(1 - F.col("l_tax") * 10, 1).cast("decimal(18,6)").alias("score"),
        F.col("l_partkey").alias("k"),
    )


def _other_verdict(gen_idx: Column, step_idx: Column, k: Column) -> Column:
    """Whether a chain's verdict is not the label; NULL without a part."""
    return F.pmod(k + 7 * gen_idx + step_idx, F.lit(5)) == 0


def _has_step(problem_id: Column, gen_idx: Column, step_idx: Column) -> Column:
    """The third chain of every eleventh solution lacks its first step."""
    return ~((gen_idx == 2) & (F.pmod(problem_id, F.lit(11)) == 0) & (step_idx == 0))


def _build_verd(spark: SparkSession, sf_dir: str, steps_df: DataFrame | None = None) -> DataFrame:
    """VERD(problem_id, gen_idx, step_idx, gt_label, verdict): three chains per solution."""
    s = steps_df if steps_df is not None else steps(spark, sf_dir)
    g = s.withColumn("gen_idx", F.explode(F.sequence(F.lit(0), F.lit(2))))
    flip = _other_verdict(F.col("gen_idx"), F.col("step_idx"), F.col("k"))
    other = F.when(F.col("gt_label") == "+", "-").otherwise("+")
    return g.filter(_has_step(F.col("problem_id"), F.col("gen_idx"), F.col("step_idx"))).select(
        "problem_id",
        F.col("gen_idx").cast("bigint").alias("gen_idx"),
        "step_idx",
        "gt_label",
        F.when(flip, other).otherwise(F.col("gt_label")).alias("verdict"),
    )


def _build_gen(spark: SparkSession, sf_dir: str, verd_df: DataFrame | None = None) -> DataFrame:
    """GEN(problem_id, gen_idx, boxed_text, line_text): one verification text per chain.

    The texts of a solution's chains differ by their verdicts alone, so the solution's labels are brought
    together, once, and every chain is written from them; from a table of verdicts, these are brought together."""
    if verd_df is not None:
        chains = verd_df.groupBy("problem_id", "gen_idx").agg(
            F.array_sort(F.collect_list(F.struct("step_idx", (F.col("verdict") == "+").alias("ok")))).alias("ls"))
    else:
        s = steps(spark, sf_dir).groupBy("problem_id").agg(
            F.array_sort(F.collect_list(F.struct("step_idx", (F.col("gt_label") == "+").alias("plus"), "k"))).alias("_s"))
        s = s.withColumn("gen_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))))
        problem, g = F.col("problem_id"), F.col("gen_idx")
        own = F.filter("_s", lambda x: _has_step(problem, g, x["step_idx"]))
        ok = lambda x: F.when(_other_verdict(g, x["step_idx"], x["k"]), ~x["plus"]).otherwise(x["plus"])
        chains = s.select("problem_id", "gen_idx", F.transform(own, lambda x: F.struct(x["step_idx"].alias("step_idx"), ok(x).alias("ok"))).alias("ls"))
        chains = chains.filter(F.size("ls") > 0)
    num = lambda x: (x["step_idx"] + 1).cast("string")
    boxed = lambda x: F.concat(F.lit("Step "), num(x), F.lit(": checked. The step is \\boxed{"), F.when(x["ok"], "correct").otherwise("incorrect"), F.lit("}"))
    line = lambda x: F.concat(F.lit("Step "), num(x), F.lit(": checked. Correct? "), F.when(x["ok"], "Yes.").otherwise("No."))
    return chains.select(
        "problem_id",
        "gen_idx",
        F.array_join(F.transform("ls", boxed), "\n").alias("boxed_text"),
        F.array_join(F.transform("ls", line), "\n").alias("line_text"),
    )


def conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CONF(doc_id, conf DOUBLE, correct INT)."""
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return lab.join(doc, "doc_id").select(
        "doc_id",
        (F.pmod(F.col("n_chars"), F.lit(101)).cast("double") / 100.0).alias("conf"),
        F.col("quality").alias("correct"),
    )


def _build_tree(spark: SparkSession, sf_dir: str, cand_df: DataFrame | None = None) -> DataFrame:
    """TREE(problem_id, node_id, parent_id, text, score, stop_reason): heap-shaped tree per problem."""
    c = cand_df if cand_df is not None else cand(spark, sf_dir)
    return c.select(
        "problem_id",
        F.col("idx").alias("node_id"),
        F.when(F.col("idx") == 0, F.lit(None).cast("bigint"))
        .otherwise(F.floor((F.col("idx") - 1) / 2.0).cast("bigint")).alias("parent_id"),
        F.concat(F.lit("s"), F.col("answer"), F.lit(" ")).alias("text"),
        "score",
        F.when((F.col("idx") > 2) & (F.col("answer_key") == "7"), F.lit("EOS"))
        .otherwise(F.lit(None).cast("string")).alias("stop_reason"),
    )


def _build_logp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOGP(gen_id, pos, yes_logprob, no_logprob, top_token)."""
    li = _numbered_lines(spark, sf_dir, ["l_tax", "l_discount"], "pos")
    return li.select(
        F.col("l_orderkey").alias("gen_id"),
        "pos",
        (F.lit(-10) * F.col("l_tax") - 0.1).alias("yes_logprob"),
        (F.lit(-10) * F.col("l_discount") - 0.1).alias("no_logprob"),
        F.when(F.col("l_tax") <= F.col("l_discount"), " Yes").otherwise(" No").alias("top_token"),
    )


def _build_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEEP(problem_id, node_id, parent_id, text, score, stop_reason): one tree per supplier over its lines,
    with paths of a hundred nodes and more."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", *[c for c in LINE_ORDER if c != "l_suppkey"], "l_discount", "l_quantity")
    li = number_within(li, ["l_suppkey"], ["l_orderkey", *[c for c in LINE_ORDER if c != "l_suppkey"]], "idx", base=0)
    back = F.col("idx") - 1 - F.pmod(F.col("idx") * 7 + F.col("l_partkey"), F.lit(4))
    text = F.when(F.pmod("l_partkey", F.lit(41)) == 0, F.concat(F.lit("boxed{"), F.col("l_partkey").cast("string"), F.lit("} "))).otherwise(
        F.concat(F.lit("s"), F.pmod("l_partkey", F.lit(97)).cast("string"), F.lit(" ")))
    return li.select(
        F.col("l_suppkey").alias("problem_id"),
        F.col("idx").alias("node_id"),
        F.when(F.col("idx") == 0, F.lit(None).cast("bigint")).otherwise(F.greatest(back, F.lit(0))).cast("bigint").alias("parent_id"),
        text.alias("text"),
        F.round(F.col("l_discount") * 10 + F.pmod(F.col("idx"), F.lit(3)), 1).cast("decimal(18,6)").alias("score"),
        F.when(F.pmod(F.col("l_partkey"), F.lit(29)) == 0, F.lit("EOS")).otherwise(F.lit(None).cast("string")).alias("stop_reason"),
    )


def _build_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOKENS(gen_id, pos, token, rank, logprob): the listed tokens of every position; some lack an option, some keys decide nothing."""
    lp = logp(spark, sf_dir)
    yes = F.struct(F.lit(" Yes").alias("token"), F.col("yes_logprob").cast("double").alias("logprob"))
    no = F.struct(F.lit("No").alias("token"), F.col("no_logprob").cast("double").alias("logprob"))
    first = F.when(F.trim("top_token") == "Yes", yes).otherwise(no)
    second = F.when(F.trim("top_token") == "Yes", no).otherwise(yes)
    other = F.struct(F.lit("The").alias("token"), F.lit(-0.05).alias("logprob"))
    kind = F.pmod(F.col("gen_id") + 3 * F.col("pos"), F.lit(5))
    listed = F.when((kind == 4) | (F.pmod(F.col("gen_id"), F.lit(7)) == 0), F.array(other, first, second)).when(kind == 3, F.array(first, other)).otherwise(F.array(first, second))
    return lp.select("gen_id", "pos", F.posexplode(listed).alias("r", "t")).select(
        "gen_id", "pos", F.col("t.token").alias("token"), (F.col("r") + 1).alias("rank"), F.col("t.logprob").alias("logprob"))


# ---------------------------------------------------------------- materialised fixture tables

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _stamp(spark: SparkSession, sf_dir: str) -> str | None:
    """Identity of an input folder: its path and the length and modification time of every table
    (through the Hadoop file system, so it works on cluster storage); None if it is not there."""
    parts = [FIXTURE_VERSION, sf_dir.rstrip("/")]
    for t in TABLES:
        fs, p = _fs(spark, f"{sf_dir.rstrip('/')}/{t}.parquet")
        if fs.exists(p):
            st = fs.getFileStatus(p)
            parts.append(f"{t}:{st.getLen()}:{st.getModificationTime()}")
    if len(parts) == 2:
        return None
    return hashlib.sha1("|".join(parts).encode()).hexdigest()[:16]


def _materialized(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived fixture table is written once per input folder into the shared checkpoint
    folder and read back by every later query (a complete write has a _SUCCESS marker)."""
    stamp = _stamp(spark, sf_dir) if MATERIALIZE else None
    if stamp is None:
        return build()
    root = f"{checkpoint_dir(spark).rstrip('/')}/stepjudge-fixtures/{NAMESPACE or spark.sparkContext.applicationId}/{stamp}/{name}"
    fs, done = _fs(spark, f"{root}/_SUCCESS")
    if not fs.exists(done):
        build().write.mode("overwrite").parquet(root)
    return spark.read.parquet(root)


MATERIALIZE = True
# bump when a fixture builder changes, so no earlier table is read back
FIXTURE_VERSION = "fixtures-v2"
# a run reads back only what it wrote itself: the default is the application id; a benchmark sets its own
NAMESPACE: str | None = None


def cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAND(problem_id, idx, answer, answer_key, score DECIMAL(18,6), gold_key)."""
    return _materialized(spark, sf_dir, "cand", lambda: _build_cand(spark, sf_dir))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STEPS(problem_id, step_idx, step, gt_label '+'/'-', score DECIMAL(18,6), k)."""
    return _materialized(spark, sf_dir, "steps", lambda: _build_steps(spark, sf_dir))


def verd(spark: SparkSession, sf_dir: str, steps_df: DataFrame | None = None) -> DataFrame:
    """VERD(problem_id, gen_idx, step_idx, gt_label, verdict): three chains per solution."""
    if steps_df is not None:
        return _build_verd(spark, sf_dir, steps_df)
    return _materialized(spark, sf_dir, "verd", lambda: _build_verd(spark, sf_dir))


def gen(spark: SparkSession, sf_dir: str, verd_df: DataFrame | None = None) -> DataFrame:
    """GEN(problem_id, gen_idx, boxed_text, line_text): one verification text per chain."""
    if verd_df is not None:
        return _build_gen(spark, sf_dir, verd_df)
    return _materialized(spark, sf_dir, "gen", lambda: _build_gen(spark, sf_dir))


def tree(spark: SparkSession, sf_dir: str, cand_df: DataFrame | None = None) -> DataFrame:
    """TREE(problem_id, node_id, parent_id, text, score, stop_reason): heap-shaped tree per problem."""
    if cand_df is not None:
        return _build_tree(spark, sf_dir, cand_df)
    return _materialized(spark, sf_dir, "tree", lambda: _build_tree(spark, sf_dir))


def logp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOGP(gen_id, pos, yes_logprob, no_logprob, top_token)."""
    return _materialized(spark, sf_dir, "logp", lambda: _build_logp(spark, sf_dir))


def deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEEP(problem_id, node_id, parent_id, text, score, stop_reason): a deep tree per supplier."""
    return _materialized(spark, sf_dir, "deep", lambda: _build_deep(spark, sf_dir))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOKENS(gen_id, pos, token, rank, logprob)."""
    return _build_tokens(spark, sf_dir)


# ---------------------------------------------------------------- DuckDB definitions (oracle side)

_LINE_RN = (
    "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, "
    "l_extendedprice, l_shipdate) - 1"
)

SQL_VIEWS: dict[str, str] = {
    "cand": f"""
SELECT l.l_orderkey AS problem_id,
  row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey,
                     l.l_extendedprice, l.l_shipdate) - 1 AS idx,
  CASE l.l_returnflag || l.l_linestatus WHEN 'AF' THEN '0.5' WHEN 'AO' THEN '1/2' WHEN 'NF' THEN '7'
       WHEN 'NO' THEN '7.0' WHEN 'RF' THEN '12' ELSE '12.00' END AS answer,
  CASE l.l_returnflag WHEN 'A' THEN '1/2' WHEN 'N' THEN '7' ELSE '12' END AS answer_key,
  CAST(round(l.l_discount * 10, 1) AS DECIMAL(18,6)) AS score,
  CASE o.st WHEN 'F' THEN '1/2' WHEN 'O' THEN '7' ELSE '12' END AS gold_key
FROM lineitem l JOIN (SELECT o_orderkey, min(o_orderstatus) AS st FROM orders GROUP BY o_orderkey) o
  ON o.o_orderkey = l.l_orderkey""",
    "steps": f"""
SELECT l_orderkey AS problem_id, {_LINE_RN} AS step_idx,
  'part ' || CAST(l_partkey AS VARCHAR) AS step,
  CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS gt_label,
  CAST(round(1 - l_tax * 10, 1) AS DECIMAL(18,6)) AS score, l_partkey AS k
FROM lineitem""",
    "verd": """
SELECT s.problem_id, g.gen_idx, s.step_idx, s.gt_label,
  CASE WHEN (s.k + 7 * g.gen_idx + s.step_idx) % 5 = 0
       THEN (CASE WHEN s.gt_label = '+' THEN '-' ELSE '+' END) ELSE s.gt_label END AS verdict
FROM steps s, (SELECT CAST(0 AS BIGINT) AS gen_idx UNION ALL SELECT 1 UNION ALL SELECT 2) g
WHERE NOT (g.gen_idx = 2 AND s.problem_id % 11 = 0 AND s.step_idx = 0)""",
    "gen": """
SELECT problem_id, gen_idx,
  string_agg('Step ' || CAST(step_idx + 1 AS VARCHAR) || ': checked. The step is \\boxed{'
             || CASE WHEN verdict = '+' THEN 'correct' ELSE 'incorrect' END || '}', chr(10) ORDER BY step_idx) AS boxed_text,
  string_agg('Step ' || CAST(step_idx + 1 AS VARCHAR) || ': checked. Correct? '
             || CASE WHEN verdict = '+' THEN 'Yes.' ELSE 'No.' END, chr(10) ORDER BY step_idx) AS line_text
FROM verd GROUP BY problem_id, gen_idx""",
    "conf": """
SELECT d.doc_id, CAST(d.n_chars % 101 AS DOUBLE) / 100.0 AS conf, l.quality AS correct
FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "tree": """
SELECT problem_id, idx AS node_id,
  CASE WHEN idx = 0 THEN NULL ELSE CAST(floor((idx - 1) / 2.0) AS BIGINT) END AS parent_id,
  's' || answer || ' ' AS text, score,
  CASE WHEN idx > 2 AND answer_key = '7' THEN 'EOS' ELSE NULL END AS stop_reason
FROM cand""",
    "logp": f"""
SELECT l_orderkey AS gen_id, {_LINE_RN} AS pos,
  -10 * l_tax - 0.1 AS yes_logprob, -10 * l_discount - 0.1 AS no_logprob,
  CASE WHEN l_tax <= l_discount THEN ' Yes' ELSE ' No' END AS top_token
FROM lineitem""",
    "deep": """
SELECT problem_id, idx AS node_id, CASE WHEN idx = 0 THEN NULL ELSE greatest(idx - 1 - (idx * 7 + pk) % 4, 0) END AS parent_id,
  CASE WHEN pk % 41 = 0 THEN 'boxed{' || pk || '} ' ELSE 's' || (pk % 97) || ' ' END AS text,
  CAST(round(disc * 10 + idx % 3, 1) AS DECIMAL(18,6)) AS score, CASE WHEN pk % 29 = 0 THEN 'EOS' END AS stop_reason
FROM (SELECT l_suppkey AS problem_id, l_partkey AS pk, l_discount AS disc,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) - 1 AS idx
      FROM lineitem)""",
}

_DEPS = {"verd": ["steps"], "gen": ["steps", "verd"], "tree": ["cand"]}


def with_views(body: str, *names: str) -> str:
    """Prefix a DuckDB statement with the fixture views it names (dependencies first)."""
    order: list[str] = []
    for n in names:
        for d in _DEPS.get(n, []) + [n]:
            if d not in order:
                order.append(d)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in order)
    b = body.lstrip()
    if b[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{b[15:]}"
    if b[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{b[5:]}"
    return f"WITH {ctes}\n{body}"
