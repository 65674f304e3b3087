"""Personal data by candidates and gradient-boosted trees, in DataFrame operations alone.

Generators with high recall propose spans, which may overlap: addresses with or without a dotted domain
or with a spelled-out at sign, and the pieces of every run of digits and separators that may be an IP
address, a card or a phone number: the plain patterns' matches, and every sequence of neighbouring groups
of digits whose separators and count of digits fit a kind. A sequence has ``DIGITS`` digits at most, so
these are linear in the run. Strict rules mark the base spans among the plain matches, which always stay.

Every candidate has a few small integer features of its format and context. Boosted trees of depth two
learn from all candidates of the corpus which of them are base spans (or the local part that a base phone
number ends in), without seeing what the rules decide by (check digits, value ranges, the plus sign), so
candidates that look like base spans in the rest score high. Learning needs the candidates' counts per feature vector only; every split is chosen
from one aggregation over these. The threshold of a kind is the lowest at which ``PRECISION`` of what
scores as much is so. Other candidates above it are added unless they overlap a base span, best first, each
unless it overlaps one really added. Best is the highest margin (a number that passes its check sum or
value ranges gets ``log(10)`` more, as one in ten passes a check sum by chance), then the longest, then
the first.

Positions are code points, ends exclusive. A null text counts as empty and has no spans. Rows are found
independently; repeated rows and null ids get their own results. An empty table gives no rows. Columns
other than those named aren't used by ``find``; ``redact`` keeps them all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepjudge.llm.common import checkpoint, free_name

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.8
TREES, RATE, RIDGE = 10, 0.4, 1.0
LEAST = 8  # candidates that a threshold rests on, at least
DIGITS = 19  # of the longest number of any kind

# Possessive quantifiers and the look-behinds only keep these patterns linear on long runs; what they match is
# the leftmost, non-overlapping matches of the plain patterns.
_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
EMAIL = _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
UNDOTTED = _LOCAL + r"@[A-Za-z0-9-]++(?!\.[A-Za-z0-9-])"
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?(?:at|AT|@) ?[\])] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(] ?(?:dot|DOT|\.) ?[\])] ?)[A-Za-z0-9-]++)++"
RUN = r"\+?[0-9][0-9 ().+-]*+"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?+[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
LOCAL_PHONE = r"(?<![0-9+])[0-9]++(?:(?:\) ?+|[ .-])\(?+[0-9]++)++"


def located(rows: DataFrame, keys: list[str], text: str, pattern: str, keep: list[str]) -> DataFrame:
    """``keep``, and a row for each match: start, m (the match), before and after (the text around it).

    The texts between matches and the matches come in turn, so starts are running sums of their lengths.
    """
    pieces, found = F.split(F.col(text), pattern, -1), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    each = F.transform(F.sequence(F.lit(0), F.size("_found") - 1), lambda i: F.struct(i.alias("i"), F.get("_pieces", i).alias("b"), F.get("_found", i).alias("m"), F.get("_pieces", i + 1).alias("a")))
    out = rows.where(F.col(text).rlike(pattern)).select(*keep, pieces.alias("_pieces"), found.alias("_found")).select(*keep, F.explode(each).alias("_e"))
    order = Window.partitionBy(*keys).orderBy("_i")
    out = out.select(*keep, F.col("_e.i").alias("_i"), F.col("_e.m").alias("m"), F.length("_e.b").alias("_n"), F.right("_e.b", F.lit(24)).alias("before"), F.left("_e.a", F.lit(1)).alias("after"))
    start = F.sum("_n").over(order) + F.coalesce(F.sum(F.length("m")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.withColumn("start", start.cast("int")).drop("_i", "_n")


#: What a whole sequence of groups has to match, and its least and largest count of digits, by form.
_SEQUENCES = (
    (1, r"^[0-9]+(?:\.[0-9]+){3}$", 4, DIGITS),
    (2, r"^[0-9]+(?:[ -][0-9]+)*$", 12, DIGITS),
    (3, r"^\+[0-9][ ().0-9-]+[0-9]$", 9, 15),
    (4, r"^[0-9]+(?:(?:\) ?|[ .-])\(?[0-9]+)+$", 7, 15),
)


def sequences(runs: DataFrame) -> DataFrame:
    """(r, start, m, before, after) of every sequence of neighbouring groups of digits of a run, ``DIGITS`` digits at most.

    A plus sign before the first group belongs to m.
    """
    keys = ["r", "t_hash", "at"]
    rows = runs.where(F.col("run").rlike("[0-9][^0-9]+[0-9]") & (F.length(digits(F.col("run"))) > 4))
    rows = rows.select(*keys, "a", "b", F.split("run", "[0-9]++", -1).alias("_s"), F.regexp_extract_all("run", F.lit("[0-9]++"), F.lit(0)).alias("_d"))
    each = F.transform(F.sequence(F.lit(0), F.size("_d") - 1), lambda i: F.struct(i.alias("i"), F.get("_s", i).alias("s"), F.get("_d", i).alias("d"), F.left(F.get("_s", i + 1), F.lit(1)).alias("next")))
    rows = rows.select(*keys, "a", "b", F.explode(each).alias("_g"))
    order = Window.partitionBy(*keys).orderBy("_g.i")
    end = F.sum(F.length("_g.s") + F.length("_g.d")).over(order)
    rows = rows.withColumn("start", F.col("at") + end - F.length("_g.d")).withColumn("_w", F.collect_list("_g").over(order.rowsBetween(0, DIGITS - 1)))
    count = lambda n: F.aggregate(F.slice("_w", F.lit(1), n), F.lit(0), lambda x, g: x + F.length(g["d"]))
    sizes = F.filter(F.sequence(F.lit(1), F.size("_w")), lambda n: count(n) <= DIGITS)
    rows = rows.select("r", "a", "b", "start", "_w", F.explode(sizes).alias("_n"))
    m = F.array_join(F.transform(F.slice("_w", F.lit(1), F.col("_n")), lambda g, i: F.when(i == 0, g["d"]).otherwise(F.concat(g["s"], g["d"]))), "")
    gap, after = F.get("_w", F.lit(0))["s"], F.get("_w", F.col("_n") - 1)["next"]
    plus = gap.endswith("+")
    return rows.select(
        "r", (F.col("start") - plus.cast("int")).cast("int").alias("start"), F.when(plus, F.concat(F.lit("+"), m)).otherwise(m).alias("m"),
        F.concat("b", F.right(F.when(plus, F.left(gap, F.length(gap) - 1)).otherwise(gap), F.lit(24))).alias("before"), F.when(after == "", F.col("a")).otherwise(after).alias("after"),
    )


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    value = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: value(d.cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


_CONTEXT = (r"(?i)mail|contact|@", r"(?i)tel|phone|call|fax|mobil", r"(?i)card|visa|credit|pay", r"(?i)\bip\b|host|server|addr", r"(?i)version|licen|isbn|token|key|\bid\b")


def _around(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"\p{L}"), 2).when(c.rlike("[0-9]"), 3).otherwise(4)


def _features(m: Column, before: Column, after: Column, form: Column) -> Column:
    n = F.length(digits(m))
    seps = sum((F.when(m.contains(c), 1 << i).otherwise(0) for i, c in enumerate((" ", "-", ".", "("))), F.lit(0))
    longest = F.array_max(F.transform(F.split(m, "[^0-9]+"), lambda p: F.length(p)))
    context = F.lit(0)
    for i, pattern in reversed(list(enumerate(_CONTEXT))):
        context = F.when(before.rlike(pattern), i + 1).otherwise(context)
    groups = F.size(F.filter(F.split(m, "[^0-9]+"), lambda p: p != ""))
    return F.array(form, F.least(n, F.lit(20)), seps, F.least(groups, F.lit(6)), F.least(longest, F.lit(16)), _around(F.right(before, F.lit(1))), _around(after), context)


def texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(r, t): every text under a hash of id and text, which equal rows share."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(row_hash(F.col(key), F.col(text)).alias("r"), t.alias("t"))


def row_hash(key: Column, text: Column) -> Column:
    return F.xxhash64(F.coalesce(key.cast("string"), F.lit("-")), F.coalesce(text, F.lit("")))


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(r, kind, start, end, base, strict, inside, f) of every proposed span; kind is a position in ``KINDS``.

    ``strict`` tells whether an address or a card passes its rule, ``inside`` whether the span is right by the base
    spans of its kind: it is one, ends a phone number or lies in an address of mail.
    """
    rows = texts(docs, key, text)
    keys = ["r", "t_hash"]
    rows = rows.withColumn("t_hash", F.monotonically_increasing_id())  # tells repeated rows apart while positions are summed
    has = lambda *c: F.greatest(*[F.col("t").contains(x) for x in c], F.lit(False))
    out = None
    for pattern, some, base in ((EMAIL, has("@"), True), (UNDOTTED, has("@"), False), (SPELLED, has("[", "("), False)):
        part = located(rows.where(some), keys, "t", pattern, keys)
        part = part.select("r", F.lit(0).alias("kind"), "start", "m", "before", "after", F.lit(base).alias("base"), F.lit(False).alias("strict"), F.lit(0).alias("form"))
        out = part if out is None else out.union(part)
    runs = located(rows, keys, "t", RUN, keys)
    runs = runs.where(F.length(digits(F.col("m"))) >= 4)
    runs = checkpoint(runs.select("r", "t_hash", F.col("start").alias("at"), F.col("m").alias("run"), F.col("before").alias("b"), F.col("after").alias("a")))
    number = F.length(digits(F.col("m")))
    octets = F.forall(F.split("m", r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(F.concat(F.lit("0"), p), F.lit(4)).cast("int") <= 255))
    strict = {1: octets, 2: luhn(digits(F.col("m")))}
    for form, pattern in ((1, IP), (2, CARD), (3, PHONE), (4, LOCAL_PHONE)):
        part = located(runs, ["r", "t_hash", "at"], "run", pattern, ["r", "t_hash", "at", "b", "a", "run"])
        part = part.withColumn("after", F.when(F.col("start") + F.length("m") < F.length("run"), F.col("after")).otherwise(F.col("a")))
        part = part.withColumn("before", F.concat("b", "before")).withColumn("start", F.col("start") + F.col("at"))
        if form == 1:
            good, base = F.lit(True), strict[form]
        elif form == 2:
            good, base = number.between(12, 19), strict[form]
        elif form == 3:
            good, base = number.between(9, 15), F.lit(True)
        else:
            good, base = number.between(7, 15), F.lit(False)
        kind = F.lit(min(form, 3))
        out = out.union(part.where(good).select("r", kind.alias("kind"), "start", "m", "before", "after", base.alias("base"), strict.get(form, F.lit(False)).alias("strict"), kind.alias("form")))
    part = sequences(runs)
    fits = lambda pattern, least, most: F.col("m").rlike(pattern) & number.between(least, most)
    forms = F.array_compact(F.array(*[F.when(fits(*rule), F.lit(form)) for form, *rule in _SEQUENCES]))
    part = part.withColumn("form", F.explode(forms)).withColumn("kind", F.least("form", F.lit(3)))
    part = part.withColumn("strict", F.when(F.col("form") == 1, strict[1]).when(F.col("form") == 2, strict[2]).otherwise(False))
    out = out.union(part.select("r", "kind", "start", "m", "before", "after", F.lit(False), "strict", F.col("kind").alias("form")))
    features = _features(F.col("m"), F.col("before"), F.col("after"), F.col("form"))
    found = F.struct(F.coalesce("base", F.lit(False)).alias("base"), F.coalesce("strict", F.lit(False)).alias("strict"), features.alias("f"))
    out = out.groupBy("r", "kind", "start", (F.col("start") + F.length("m")).cast("int").alias("end")).agg(F.max(found).alias("_x")).select("r", "kind", "start", "end", "_x.*")
    begun = Window.partitionBy("r", "kind").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(F.col("base"), F.col("end"))).over(begun)
    inside = F.when(F.col("kind") == 0, last >= F.col("end")).when(F.col("kind") == 3, last == F.col("end")).otherwise(F.col("base"))
    return out.withColumn("inside", F.coalesce(inside, F.lit(False)))


@dataclass
class Trees:
    """Splits and leaf values; a split asks whether a feature has a value."""

    start: float = 0.0
    trees: list = field(default_factory=list)  # (split, (split, value, value), (split, value, value))
    thresholds: dict = field(default_factory=dict)

    def value(self, i: int, f: str = "f") -> Column:
        """What tree i gives."""
        root, yes, no = self.trees[i]
        ask = lambda s: F.get(f, F.lit(s[0])) <= F.lit(s[1])
        side = lambda s: F.when(ask(s[0]), F.lit(s[1])).otherwise(F.lit(s[2])) if s[0] else F.lit(s[1])
        return F.when(ask(root), side(yes)).otherwise(side(no))

    def margin(self, f: str = "f") -> Column:
        total = F.lit(self.start)
        for i in range(len(self.trees)):
            total = total + self.value(i, f)
        return total

    def probability(self, f: str = "f") -> Column:
        return 1 / (1 + F.exp(-self.margin(f)))


def _best(rows: list, ridge: float = RIDGE):
    """The best split (feature, largest value of its left side) of the sums of one node, and its leaf values."""
    by_feature: dict[int, list] = {}
    for r in rows:
        by_feature.setdefault(r["i"], []).append((r["v"], r["g"], r["h"]))
    value = lambda g, h: RATE * g / (h + ridge)
    best, out = 1e-6, None
    for i in sorted(by_feature):
        sums = sorted(by_feature[i])
        all_g, all_h = sum(s[1] for s in sums), sum(s[2] for s in sums)
        if out is None:
            out = (None, value(all_g, all_h), value(all_g, all_h))
        g = h = 0.0
        for v, dg, dh in sums[:-1]:
            g, h = g + dg, h + dh
            gain = g * g / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            if gain > best:
                best, out = gain, ((i, v), value(g, h), value(all_g - g, all_h - h))
    return out or (None, 0.0, 0.0)


def learn(found: DataFrame) -> Trees:
    """Trees and thresholds from a table of candidates.

    Its rows are summed per feature vector first (a table bounded by the features' values). Each level of a tree is one aggregation by feature and
    value (a few hundred sums) of which the driver picks the best.
    """
    table = checkpoint(found.groupBy("kind", "f").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("inside").cast("double")).alias("y")).coalesce(4))
    sums = table.agg(F.sum("n").alias("n"), F.sum("y").alias("y")).first()
    model = Trees()
    if not sums["n"]:
        return model
    p = (sums["y"] + 1) / (sums["n"] + 2)
    model.start = math.log(p / (1 - p))
    table = table.withColumn("margin", F.lit(model.start))
    for _ in range(TREES):
        p = 1 / (1 + F.exp(-F.col("margin")))
        now = table.select("f", (F.col("y") - F.col("n") * p).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))

        def sums_of(rows: DataFrame, *by: str) -> list:
            return rows.select(*by, "g", "h", F.posexplode("f").alias("i", "v")).groupBy(*by, "i", "v").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()

        root, _, _ = _best(sums_of(now))
        if root is None:
            break
        sides = sums_of(now.withColumn("left", F.get("f", F.lit(root[0])) <= F.lit(root[1])), "left")
        model.trees.append((root, _best([r for r in sides if r["left"]]), _best([r for r in sides if not r["left"]])))
        # the margin so far is a column, so every round has one plan of the same size
        table = checkpoint(table.withColumn("margin", F.col("margin") + model.value(-1)))
    marks = table.groupBy("kind", F.floor(200 / (1 + F.exp(-F.col("margin")))).alias("bin")).agg(F.sum("n").alias("n"), F.sum("y").alias("y")).collect()
    for kind in range(len(KINDS)):
        n = y = 0.0
        for r in sorted((r for r in marks if r["kind"] == kind), key=lambda r: -r["bin"]):
            n, y = n + r["n"], y + r["y"]
            if n >= LEAST and y / n >= PRECISION:
                model.thresholds[kind] = r["bin"] / 200
    return model


def spans(found: DataFrame, model: Trees) -> DataFrame:
    """(r, kind, start, end, base): base spans, and the added ones."""
    limit = F.lit(2.0)
    for kind, t in model.thresholds.items():
        limit = F.when(F.col("kind") == kind, F.lit(t)).otherwise(limit)
    rows = found.withColumn("more", ~F.col("base") & (model.probability() >= limit)).where("base or more")
    rows = rows.withColumn("rank", model.margin() + F.when(F.col("strict"), F.lit(math.log(10))).otherwise(0.0))
    order = Window.partitionBy("r").orderBy("start", F.desc("end"), "kind")
    past, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("b_end", F.max(F.when(F.col("base"), F.col("end"))).over(past))
    rows = rows.withColumn("b_start", F.min(F.when(F.col("base"), F.col("start"))).over(rest))
    free = (F.coalesce("b_end", F.lit(0)) <= F.col("start")) & (F.coalesce("b_start", F.col("end")) >= F.col("end"))
    rows = rows.where(F.col("base") | free).select("r", "kind", "start", "end", "base", "rank")
    # Only spans of one chain of overlaps can keep each other out, so each chain is chosen from on its own.
    more = rows.where(~F.col("base"))
    begins = F.coalesce(F.col("start") >= F.max("end").over(past), F.lit(True)).cast("int")
    more = more.withColumn("begins", begins).withColumn("chain", F.sum("begins").over(order))
    best = F.struct((-F.col("rank")).alias("rank"), (F.col("start") - F.col("end")).alias("size"), "start", "end", "kind")
    chains = more.groupBy("r", "chain").agg(F.sort_array(F.collect_list(best)).alias("all"))
    overlaps = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])
    chosen = F.aggregate("all", F.slice("all", 1, 0), lambda kept, x: F.when(F.exists(kept, lambda y: overlaps(x, y)), kept).otherwise(F.array_append(kept, x)))
    added = chains.select("r", F.explode(chosen).alias("_x")).select("r", "_x.kind", "_x.start", "_x.end", F.lit(False).alias("base"))
    return rows.where("base").select("r", "kind", "start", "end", "base").union(added)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of each row; counts are of base spans."""
    found = checkpoint(candidates(docs, key, text))
    chosen = spans(found, learn(found))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    line = F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("s"), "base")
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["s"]), ",")
    sums = chosen.groupBy("r").agg(
        *[F.sum(((F.col("kind") == i) & F.col("base")).cast("bigint")).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sum((~F.col("base")).cast("bigint")).alias("n_added"), F.sort_array(F.collect_list(line)).alias("all"),
    )
    sums = sums.withColumn("base_spans", joined(F.filter("all", lambda x: x["base"]))).withColumn("spans", joined("all")).drop("all")
    out = docs.select(F.col(key).alias("doc_id"), row_hash(F.col(key), F.col(text)).alias("r")).join(sums, "r", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return out.select(
        "doc_id", *[zero(f"n_{k}") for k in KINDS], F.sha2(F.coalesce("base_spans", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"), zero("n_added"),
    )


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans are replaced as one."""
    found = checkpoint(candidates(docs, key, text))
    chosen = spans(found, learn(found))
    order = Window.partitionBy("r").orderBy("start", F.desc("end"), "kind")
    new = F.coalesce(F.col("start") >= F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    merged = chosen.withColumn("group", F.sum(new.cast("int")).over(order)).groupBy("r", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", "kind")).alias("k"))
    name = F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), F.col("k.kind") + 1)
    lists = merged.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("start", "end", name.alias("name")))).alias("s"))
    r, s = free_name(docs, "_row"), free_name(docs, "_spans")
    rows = docs.withColumn(r, row_hash(F.col(key), F.col(text))).join(lists.select(F.col("r").alias(r), F.col("s").alias(s)), r, "left")
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col(s), i - 1)["end"])
    parts = F.transform(F.col(s), lambda x, i: F.concat(F.substring(F.col(text), begin(i) + 1, x["start"] - begin(i)), x["name"]))
    tail = F.substring(F.col(text), F.element_at(F.col(s), -1)["end"] + 1, F.length(text))
    return rows.withColumn(text, F.when(F.col(s).isNotNull(), F.concat(F.array_join(parts, ""), tail)).otherwise(F.col(text))).select(*docs.columns)
