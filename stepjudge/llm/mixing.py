"""Mixing sources to target weights by capped water-filling.

Every source has a weight and wants that share of the target total; no source may be repeated more than
``max_epochs`` times, and what a clamped source can't take goes to the others by weight until none is
above its cap. Sorted by cap per weight, the clamped sources are a prefix, so the level of the others has
a closed form over running sums of the source table (one row per source).

A source is then taken as whole repetitions of all its documents and one fractional repetition: its
documents in the order of a seeded digest of the id, then of the text's digest, until the remaining words are
reached (a document is taken if its middle word is). Where that is, is found from sums per digest prefix
(map-side), then from the documents of one prefix of 16 bits, so a source that holds a third of all rows costs
no task more than that. The level comes from running sums over range slices of the source table, and what is
taken of a document from one row per source, which Spark broadcasts while its size allows and else joins on
source and salt. Nothing but digests and sizes is shuffled.

Sizes are words between white space; a null text has none. Sources are ordered by code point, null last
(a source of its own). Rows with equal ids, or without one, are ordered by their texts; where the cut falls
among rows of one id and text, as many of them are taken as fit, in the order of a digest of all their columns.
Sources without words have target 0; an empty table gives no rows. A very long text is one document, so a
source's words miss its target by half a document at most. Further columns of the input aren't used by
``mixture`` and are kept by ``mixed``.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepjudge.llm.common import checkpoint, free_name
from stepjudge.operators.ranking import number_within, running
from stepjudge.session import checkpoint_dir

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mixture-1"
SALTS = 64  # tasks that a source is dealt to where the source table isn't broadcast


def words(text: str | Column) -> Column:
    """The number of words between white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def digest(key: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), key.cast("string")).cast("binary"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size), one row per source."""
    by_name = F.col("source").asc_nulls_last()
    out = number_within(sizes, [], [by_name], "rank", base=0)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    out = out.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    out = running(out.withColumn("ratio", F.col("cap") / F.col("w")), [], ["ratio", by_name], {"caps": ("sum", "cap"), "ws": ("sum", "w")})
    out = checkpoint(out)
    size, w = out.agg(F.sum("source_size"), F.sum("w")).first()
    clamped = F.col("caps") - F.col("cap")
    level = (F.lit(float(size or 0)) - clamped) / (F.lit(float(w or 1)) - F.col("ws") + F.col("w"))
    # levels rise while sources are clamped, so the first that its own source can bear is the largest of those borne
    final = out.agg(F.max(F.when(level <= F.col("ratio"), level))).first()[0]
    return out.select("source", "source_size", F.least("cap", F.col("w") * F.lit(float(final or 0.0))).alias("target"))


def _placed(docs: DataFrame, key: str, text: str, source: str, seed: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` and the place of each row in its source: _s (source), _n (words), _b, _d, _t (digests)."""
    d = digest(F.col(key), seed)
    rows = docs.select(*keep, F.col(source).cast("string").alias("_s"), words(F.col(text)).alias("_n"), d.alias("_d"), F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("")).alias("_t"))
    return rows.withColumn("_b", F.conv(F.substring("_d", 1, 4), 16, 10).cast("int"))


def _plan(rows: DataFrame, weights: Sequence[float], max_epochs: float) -> DataFrame:
    """(source, source_size, target, whole, cut): ``whole`` repetitions of every row, and one more of those before the
    cut (prefix, digest, text digest, rows of these that are taken, of so many)."""
    sums = rows.groupBy("_s", "_b").agg(F.sum("_n").alias("n"))
    goal = targets(sums.groupBy(F.col("_s").alias("source")).agg(F.sum("n").alias("source_size")), weights, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("whole", F.least(F.floor(ratio), F.lit(int(max_epochs))).cast("int"))
    goal = checkpoint(goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    same = F.col("_s").eqNullSafe(F.col("source"))

    def reached(parts: DataFrame, by: str, before: Column) -> DataFrame:
        """Per source the part in which the remaining words are reached, and the words before it."""
        upto = before + F.sum("n").over(Window.partitionBy("_s").orderBy(by))
        run = parts.withColumn("upto", upto).where(F.col("upto") >= F.col("rest"))
        return run.groupBy("_s").agg(F.min(F.struct(by, (F.col("upto") - F.col("n")).alias("before"))).alias("m")).select(F.col("_s").alias("at"), F.col(f"m.{by}").alias(f"{by}_at"), F.col("m.before").alias(f"{by}_before"))

    parts = sums.join(goal.select("source", "rest").where("rest > 0"), same).withColumn("hi", F.col("_b").bitwiseAND(0xFF00))
    first = reached(parts.groupBy("_s", "hi", "rest").agg(F.sum("n").alias("n")), "hi", F.lit(0))
    inside = parts.join(first, F.col("_s").eqNullSafe(F.col("at")) & (F.col("hi") == F.col("hi_at"))).drop("at")
    at = checkpoint(reached(inside, "_b", F.col("hi_before")).join(goal.select("source", "rest"), F.col("at").eqNullSafe(F.col("source"))).drop("source"))
    # the rows of that prefix: a row is taken if its middle is before the end, so rows of one id and text are taken up to some number
    near = rows.join(at, F.col("_s").eqNullSafe(F.col("at")) & (F.col("_b") == F.col("_b_at"))).groupBy("_s", "_b", "_d", "_t", "_n", "rest", "_b_before").agg(F.count("*").alias("rows"))
    total = F.col("rows") * F.col("_n")
    before = F.col("_b_before") + F.sum(total).over(Window.partitionBy("_s").orderBy("_d", "_t")) - total
    left = F.col("rest") - before
    taken = F.when(F.col("_n") > 0, F.floor(left / F.col("_n") + 0.5)).when(left >= 0, F.col("rows")).otherwise(0)
    near = near.withColumn("m", F.least(F.greatest(taken, F.lit(0)), F.col("rows"))).where("m < rows")
    cut = lambda b, d, t, m, n: F.struct(F.lit(b).alias("b") if isinstance(b, int) else b.alias("b"), d.alias("d"), t.alias("t"), m.cast("bigint").alias("m"), n.cast("bigint").alias("n"))
    zero, none = F.lit(0), F.lit("")
    edge = near.groupBy(F.col("_s").alias("of")).agg(F.min(cut(F.col("_b"), F.col("_d"), F.col("_t"), F.col("m"), F.col("rows"))).alias("edge"))
    goal = goal.join(at.select("at", "_b_at"), F.col("source").eqNullSafe(F.col("at")), "left").join(edge, F.col("source").eqNullSafe(F.col("of")), "left")
    behind = F.when(F.col("_b_at").isNotNull(), cut(F.col("_b_at") + 1, none, none, zero, zero)).otherwise(cut(1 << 16, none, none, zero, zero))
    place = F.when(F.col("rest") <= 0, cut(-1, none, none, zero, zero)).otherwise(F.coalesce("edge", behind))
    return goal.select("source", "source_size", "target", "whole", place.alias("cut"))


def _decided(rows: DataFrame, plan: DataFrame, max_epochs: float, columns: Sequence[str]) -> DataFrame:
    """``rows`` with source_size, target and copies (``_copies``). ``columns`` tell apart rows of one id and text."""
    spark = rows.sparkSession
    # written, so that Spark knows its size: a table below its threshold is broadcast, a larger one meets source and salt
    folder = f"{checkpoint_dir(spark)}/mixture-{uuid.uuid4().hex}"
    plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).write.parquet(folder)
    plan = spark.read.parquet(folder).select(*[F.col(c).alias(f"_p_{c}") for c in plan.columns], F.col("_salt").alias("_p_salt"))
    salted = rows.withColumn("_salt", F.pmod(F.crc32(F.concat("_d", "_t").cast("binary")), F.lit(SALTS)).cast("int"))
    out = salted.join(plan, F.col("_s").eqNullSafe(F.col("_p_source")) & (F.col("_salt") == F.col("_p_salt"))).drop("_salt", "_p_salt", "_p_source")
    place = lambda b, d, t: F.struct(b.alias("b"), d.alias("d"), t.alias("t"))
    mine, cut = place(F.col("_b"), F.col("_d"), F.col("_t")), place(F.col("_p_cut.b"), F.col("_p_cut.d"), F.col("_p_cut.t"))
    copies = lambda extra: F.least(F.col("_p_whole") + extra, F.lit(int(max_epochs))).cast("int").alias("_copies")
    keep = [c for c in out.columns if not c.startswith("_p_")] + [F.col("_p_source_size").alias("_size_of"), F.col("_p_target").alias("_target")]
    # a cut among rows of one id and text is rare: only then are these rows numbered
    if plan.where("_p_cut.m > 0").isEmpty():
        return out.select(*keep, copies(F.when(mine < cut, 1).otherwise(0)))
    split = (mine == cut) & (F.col("_p_cut.m") > 0)
    plain = out.where(~split).select(*keep, copies(F.when(mine < cut, 1).otherwise(0)))
    some = number_within(out.where(split).withColumn("_of", F.coalesce("_s", F.lit(""))), ["_of", "_s", "_d", "_t"], [F.xxhash64(*columns)], "_row").drop("_of")
    return plain.unionByName(some.select(*keep, copies(F.when(F.col("_row") <= F.col("_p_cut.m"), 1).otherwise(0))))


def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
            weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): what the mix takes of each row."""
    rows = checkpoint(_placed(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t"), F.col(source).alias("s")), "doc_id", "t", "s", seed, ["doc_id"]))
    out = _decided(rows, _plan(rows, weights, max_epochs), max_epochs, ["doc_id"])
    return out.select(
        "doc_id", F.col("_s").alias("source"), F.col("_n").alias("size"), F.col("_size_of").alias("source_size"), F.col("_target").alias("target"),
        F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_n")).cast("bigint").alias("taken"),
    )


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
          weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; all columns are kept."""
    tmp = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names of its own, whatever the table's are
    place = {c.lower(): f"c{i}" for i, c in enumerate(docs.columns)}
    at = [place[c.lower()] for c in (key, text, source)]
    slim = checkpoint(_placed(tmp, *at, seed, []))
    rows = _placed(tmp, *at, seed, tmp.columns)
    out = _decided(rows, _plan(slim, weights, max_epochs), max_epochs, tmp.columns).where("_copies > 0")
    each = free_name(docs, "_each")
    return out.withColumn(each, F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*tmp.columns).toDF(*docs.columns)


#: The same as ``mixture`` without copies, over the table documents.
SQL = f"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}' || COALESCE(':' || doc_id::VARCHAR, '')) AS h, COALESCE(md5(text), '') AS h2 FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
l AS (SELECT a.source, a.source_size, a.w,
             ((SELECT SUM(source_size) FROM s) - COALESCE((SELECT SUM(3.0::DOUBLE * b.source_size) FROM w b WHERE 3.0::DOUBLE * b.source_size / b.w < 3.0::DOUBLE * a.source_size / a.w), 0))
             / (SELECT SUM(b.w) FROM w b WHERE 3.0::DOUBLE * b.source_size / b.w >= 3.0::DOUBLE * a.source_size / a.w) AS level
      FROM w a),
t AS (SELECT source, source_size, LEAST(3.0::DOUBLE * source_size, w * (SELECT MAX(level) FROM l x WHERE x.level <= 3.0::DOUBLE * x.source_size / x.w)) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN LEAST(FLOOR(target / source_size), 3) ELSE 0 END AS whole FROM t),
c AS (SELECT d.*, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS rest,
             SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.h2 ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       (LEAST(whole + CASE WHEN rest > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END, 3) * size)::BIGINT AS taken
FROM c
"""
