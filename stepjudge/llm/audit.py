"""What five filters remove, alone and in every order of applying them.

Every text fails a set of filters, its mask of five bits. Documents are first counted per cell (part, mask),
with map-side sums, so nothing after that grows with the documents of a part. Each cell is then folded across
the array of all 120 orders: ``transform`` takes the orders, ``aggregate`` walks one order's five letters with
the state alive or removed, and gives five structs of counts weighted by the cell. A part's cells (32 at most)
are merged by sums per position of the 600 structs. The array of orders is a constant of the plan (720
characters); everything is DataFrame functions.

Filters: A: fewer than 200 words. B: 100 * distinct words < 50 * words. C: 100 * letters A-Z > 2 * code points.
D: holds one of ``#$%&*|``. E: a document of smaller id has the same text. Words are split at white space.

A null text counts as empty (A fails, and E if another empty text has a smaller id), a null source as the empty
string. A row without an id is no smaller id for others and has none itself, so it never fails E, and it has no
labels. Rows of one id don't repeat each other; each counts as a document. Several label rows of an id count
as one, in which any 1 holds. A very long text costs its own words in one task. An empty table gives no rows.
Further columns aren't used.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: All orders as one constant, split in the plan.
ORDERS = ",".join("".join(p) for p in permutations(FILTERS))
COUNTS = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
WORD = r"[^\x20\x09-\x0D]+"


def text_mask(text: Column, words: Column) -> Column:
    """Bits 0 to 3: the text fails A, B, C, D. ``words`` is the array of its words."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = [
        n < 200,
        distinct.cast("bigint") * 100 < n.cast("bigint") * 50,
        F.regexp_count(text, F.lit("[A-Z]")).cast("bigint") * 100 > F.length(text).cast("bigint") * 2,
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): the documents of a part that fail exactly the filters of the mask."""
    rows = docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("t")
    ).withColumn("words", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    rows = rows.select("id", "part", F.sha2(F.col("t").cast("binary"), 256).alias("digest"), text_mask(F.col("t"), F.col("words")).alias("mask"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(marks, "id", "left").fillna(0, ["good", "toxic"])
    # rows of one id and text first (they lie together already), then per text: how many, and how many hold the smallest id
    of_id = rows.groupBy("digest", "part", "mask", "good", "toxic", "id").agg(F.count("*").alias("n"))
    of_text = of_id.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"), F.min("id").alias("least"), F.min_by("n", "id").alias("at_least")
    )
    # what is left of a text is a row per part, mask and label values; all are told the text's smallest id
    of_text = of_text.withColumn("first", F.min("least").over(Window.partitionBy("digest")))
    passes = F.col("no_id") + F.when(F.col("least").isNull(), 0).when(F.col("first") == F.col("least"), F.col("at_least")).otherwise(0)
    both = F.array(F.struct(F.col("mask").alias("mask"), passes.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - passes).alias("n")))
    split = of_text.select("part", "good", "toxic", F.explode(both).alias("c")).where("c.n > 0")
    n = F.col("c.n")
    return split.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def _fold(cell: Column, orders: Column) -> Column:
    """The 600 structs of one cell: its counts under every order and step."""
    zero = F.lit(0).cast("bigint")

    def walk(order: Column) -> Column:
        # the state is the step at which the cell goes (0: not yet); one struct per step is appended
        def step(state: Column, s: Column) -> Column:
            fails = F.getbit(cell["mask"], F.ascii(F.substring(order, s, 1)) - F.lit(ord("A"))) == 1
            here = fails & ~state["gone"]
            gone = state["gone"] | fails
            counts = F.struct(
                F.when(gone, zero).otherwise(cell["n"]).alias("kept"),
                F.when(here, cell["n"]).otherwise(zero).alias("removed"),
                F.when(fails & state["gone"], cell["n"]).otherwise(zero).alias("redundant"),
                F.when(here, cell["good"]).otherwise(zero).alias("good_lost"),
                F.when(here, cell["toxic"]).otherwise(zero).alias("toxic_lost"),
            )
            return F.struct(gone.alias("gone"), F.concat(state["out"], F.array(counts)).alias("out"))

        empty = F.array().cast("array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>")
        start = F.struct(F.lit(False).alias("gone"), empty.alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), start, step, lambda state: state["out"])

    return F.flatten(F.transform(orders, walk))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley):
    600 rows per part, zeros included."""
    parts = cells(docs, labels, key, text, source).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = F.split(F.lit(ORDERS), ",")
    none = F.array_repeat(F.struct(*[F.lit(0).cast("bigint").alias(c) for c in COUNTS]), 120 * len(FILTERS))
    add = lambda a, b: F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS])
    merged = F.aggregate("cells", none, lambda held, cell: F.zip_with(held, _fold(cell, orders), add))
    out = parts.select("part", "cells", orders.alias("orders"), merged.alias("merged"))
    # per filter: what its steps remove over all orders, and what it alone fails
    zero = F.lit(0).cast("bigint")
    places = F.sequence(F.lit(0), F.lit(120 * len(FILTERS) - 1))
    letter_at = lambda i: F.substring(F.get("orders", F.floor(i / len(FILTERS)).cast("int")), i % len(FILTERS) + 1, 1)

    def removed_by(f: str) -> Column:
        return F.aggregate(places, zero, lambda s, i: s + F.when(letter_at(i) == f, F.get("merged", i)["removed"]).otherwise(zero))

    def failed_alone(bit: int) -> Column:
        return F.aggregate("cells", zero, lambda s, c: s + F.when(c["mask"] == bit, c["n"]).otherwise(zero))

    out = out.select("part", "orders", "merged", F.array(*[removed_by(f) for f in FILTERS]).alias("total"), F.array(*[failed_alone(1 << i) for i in range(len(FILTERS))]).alias("alone"))
    # outer: a plain generator would have Spark evaluate the whole fold once more to see that it isn't empty
    out = out.select("part", "orders", "total", "alone", F.posexplode_outer("merged").alias("i", "c"))
    out = out.withColumn("filter_order", F.get("orders", F.floor(F.col("i") / len(FILTERS)).cast("int"))).withColumn("step", (F.col("i") % len(FILTERS) + 1).cast("int"))
    out = out.withColumn("filter", F.col("filter_order").substr(F.col("step"), F.lit(1))).withColumn("which", F.ascii("filter") - ord("A"))
    return out.select(
        "part", "filter_order", "step", "filter", "c.kept", "c.removed", "c.redundant", F.get("alone", "which").alias("unique_fails"), "c.good_lost", "c.toxic_lost", F.get("total", "which").alias("shapley")
    )


#: The same over the tables documents and labels.
SQL = """
WITH l AS (SELECT doc_id, MAX((quality = 1)::INT) AS good, MAX((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, COALESCE(source, '') AS part, COALESCE(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, MIN(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT part, CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
                || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
                || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' ELSE '' END
                || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                || CASE WHEN w.doc_id > first THEN 'E' ELSE '' END AS fails,
             COALESCE(good, 0) AS good, COALESCE(toxic, 0) AS toxic
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, fails, COUNT(*) AS n, SUM(good) AS good, SUM(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS filter, substr(filter_order, 1, step::INT - 1) AS before FROM o, range(1, 6) r(step)),
e AS (SELECT m.part, s.filter_order, s.step, s.filter, m.n, m.good, m.toxic, contains(m.fails, s.filter) AS failing,
             len(translate(m.fails, s.before, '')) < len(m.fails) AS earlier, m.fails = s.filter AS alone FROM m, s),
g AS (SELECT part, filter_order, step, filter,
             SUM(CASE WHEN NOT earlier AND NOT failing THEN n ELSE 0 END) AS kept,
             SUM(CASE WHEN NOT earlier AND failing THEN n ELSE 0 END) AS removed,
             SUM(CASE WHEN earlier AND failing THEN n ELSE 0 END) AS redundant,
             SUM(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
             SUM(CASE WHEN NOT earlier AND failing THEN good ELSE 0 END) AS good_lost,
             SUM(CASE WHEN NOT earlier AND failing THEN toxic ELSE 0 END) AS toxic_lost
      FROM e GROUP BY ALL)
SELECT part, filter_order, step, filter, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       SUM(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley
FROM g
"""
