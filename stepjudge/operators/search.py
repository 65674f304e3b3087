"""Search over logged candidate trees ``(problem_id, node_id, parent_id, text, score, stop_reason)``.

All problems advance together: one round is one equi-join of the active paths with their
children, a skew-safe top-k per problem, and a filter. The tree is hash-partitioned by problem
and checkpointed once, so every round shuffles only the (small) frontier; the frontier is
checkpointed every round to cut lineage. The loop stops when no path is active.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepjudge.operators.ranking import top_k_within
from stepjudge.operators.votes import aggregate_steps, first_argmax
from stepjudge.session import checkpoint_dir, shuffle_partitions


def best_of_n(df: DataFrame, by: Sequence[str], step_scores: str, answer: str, idx: str = "idx", how: str = "last",
              just_sample: bool = False) -> DataFrame:
    """K9: aggregate each candidate's step scores, then the answer of the best candidate (first on
    ties); with one candidate or ``just_sample`` every score is 1.0."""
    agg = F.lit(1.0) if just_sample else aggregate_steps(step_scores, how)
    d = df.withColumn("agg_score", agg)
    return d.groupBy(*by).agg(first_argmax(F.col(answer), "agg_score", idx).alias("pred"), F.max("agg_score").alias("score"))


def dedup_first(df: DataFrame, by: Sequence[str], text: str, order: str) -> DataFrame:
    """One row per (group, text), the first by ``order`` (an aggregate: skew-safe)."""
    cols = [c for c in df.columns if c not in (*by, text)]
    packed = F.min(F.struct(F.col(order), *[F.col(c) for c in cols if c != order])).alias("_r")
    return df.groupBy(*by, text).agg(packed).select(*by, text, "_r.*").select(*df.columns)


def with_previous(tree: DataFrame, by: Sequence[str] = ("problem_id",), node: str = "node_id", parent: str = "parent_id",
                  text: str = "text") -> DataFrame:
    """The text one step back on the path (the parent's text) — an equi-join, not a window."""
    p = tree.select(*by, F.col(node).alias(parent), F.col(text).alias("previous_text"))
    return tree.join(p, [*by, parent], "left")


def prune_top(df: DataFrame, by: Sequence[str], score: str, order: str, k: int) -> DataFrame:
    """The top k per group by score; on equal scores the later row is kept first."""
    return top_k_within(df, by, [F.col(score).desc(), F.col(order).desc()], k, "rank", salt_cols=[*by, order])


def top_completed(df: DataFrame, by: Sequence[str], score: str, order: str, n: int, sort: bool = True) -> DataFrame:
    """The top n finished paths by score (first on ties), or the first n when sorting is off."""
    o = [F.col(score).desc(), F.col(order)] if sort else [F.col(order)]
    return top_k_within(df, by, o, n, "rank", salt_cols=[*by, order])


def refill(survivors: DataFrame, by: Sequence[str], n: int, rank: str = "rank") -> DataFrame:
    """Exactly n rows per group by cycling the survivors: slot s takes survivor (s mod count)+1."""
    counts = survivors.groupBy(*by).agg(F.count(F.lit(1)).alias("_cnt"))
    slots = counts.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    slots = slots.withColumn(rank, (F.col("slot") % F.col("_cnt") + 1).cast(survivors.schema[rank].dataType))
    return slots.join(survivors, [*by, rank]).drop("_cnt")


def follow(start: DataFrame, step: DataFrame, by: Sequence[str], moves: int, combine: Callable[[Column, Column], Column],
           tables: list[DataFrame] | None = None) -> DataFrame:
    """Follow pointers up to ``moves`` times by doubling: ``start`` (by…, _at, _acc, …) stands on nodes,
    ``step`` (by…, _from, _to, _v) has at most one pointer per node.

    Tables of 1, 2, 4, … moves are joined from each other, and those of the binary digits of ``moves``
    are applied: at most 2 log2(moves) + 1 joins instead of one per move. ``combine`` (associative)
    merges what is met on the way; a node without a pointer ends the way, and stays where it is.
    ``tables`` is filled with the tables, of 1, 2, 4, … moves.
    """
    by, moves = list(by), int(moves)

    def moved(start: DataFrame, step: DataFrame) -> DataFrame:
        s = step.select(*by, F.col("_from").alias("_at"), F.col("_to").alias("_next"), F.col("_v").alias("_add"))
        hit = F.col("_next").isNotNull()
        return start.join(s, [*by, "_at"], "left").withColumn("_at", F.coalesce("_next", "_at")).withColumn(
            "_acc", F.when(hit, combine(F.col("_acc"), F.col("_add"))).otherwise(F.col("_acc"))).drop("_next", "_add")

    if tables is None and moves < 4:  # as few joins without a second table
        for _ in range(moves):
            start = moved(start, step)
        return start
    if moves > 1:  # each table is read by the next one, twice, and by those who stand on it: written once
        checkpoint_dir(step.sparkSession)
        step = step.checkpoint(eager=True)
    while moves > 0:
        if tables is not None:
            tables.append(step)
        if moves & 1:
            start = moved(start, step)
        moves >>= 1
        if moves:
            s = step.select(*by, F.col("_from").alias("_to"), F.col("_to").alias("_next"), F.col("_v").alias("_add"))
            hit = F.col("_next").isNotNull()
            step = step.join(s, [*by, "_to"], "left").select(
                *by, "_from", F.coalesce("_next", "_to").alias("_to"),
                F.when(hit, combine(F.col("_v"), F.col("_add"))).otherwise(F.col("_v")).alias("_v")).checkpoint(eager=True)
    return start


def _greedy(tree: DataFrame, by: Sequence[str], node: str, parent: str, score: str, value: str | Column) -> DataFrame:
    """(by…, _from, _to, _v): each node's best child (highest score, lowest id on ties) and a value of it."""
    best = tree.filter(F.col(parent).isNotNull()).groupBy(*by, F.col(parent).alias("_from")).agg(
        F.max_by(F.struct(F.col(node).alias("_to"), (F.col(value) if isinstance(value, str) else value).alias("_v")),
                 F.struct(F.col(score), -F.col(node))).alias("_b"))
    return best.select(*by, "_from", "_b._to", "_b._v")


def lookahead_text(tree: DataFrame, depth: int, by: Sequence[str] = ("problem_id",), node: str = "node_id",
                   parent: str = "parent_id", text: str = "text", score: str = "score") -> DataFrame:
    """Each node's text followed by its greedy continuation — the best child (highest score,
    lowest id on ties) taken ``depth`` times, by pointer doubling (``follow``)."""
    by = list(by)
    step = _greedy(tree, by, node, parent, score, F.coalesce(F.col(text), F.lit("")))
    start = tree.select(*by, node, F.col(node).alias("_at"), F.col(text).alias("_acc"))
    out = follow(start, step, by, depth, lambda a, b: F.concat(a, b))
    return out.select(*by, node, F.col("_acc").alias("lookahead"))


def _greedy_ends(tree: DataFrame, depth: int, by: list[str], node: str, parent: str, score: str) -> DataFrame:
    """(by…, node, _acc, _moves): the score at the end of the greedy continuation, for nodes that have one. Only they are
    followed: their best child first, then ``depth`` - 1 steps from it."""
    step = _greedy(tree, by, node, parent, score, score)
    if depth > 1:  # read by every move
        checkpoint_dir(tree.sparkSession)
        step = step.checkpoint(eager=True)
    start = step.select(*by, F.col("_from").alias(node), F.col("_to").alias("_at"), F.col("_v").alias("_acc"))
    return follow(start, step, by, depth - 1, lambda a, b: b).select(*by, node, "_acc", F.lit(True).alias("_moves"))


def lookahead_score(tree: DataFrame, depth: int, by: Sequence[str] = ("problem_id",), node: str = "node_id",
                    parent: str = "parent_id", score: str = "score") -> DataFrame:
    """(by…, node, look): the score at the end of each node's greedy continuation of ``depth`` steps."""
    by = list(by)
    if depth < 1:
        return tree.select(*by, node, F.col(score).alias("look"))
    out = tree.select(*by, node, score).join(_greedy_ends(tree, depth, by, node, parent, score), [*by, node], "left")
    return out.select(*by, node, F.when(F.col("_moves"), F.col("_acc")).otherwise(F.col(score)).alias("look"))


def _children(tree: DataFrame, by: Sequence[str], node: str, parent: str) -> DataFrame:
    n = tree.filter(F.col(parent).isNotNull()).groupBy(*by, F.col(parent).alias(node)).agg(F.count(F.lit(1)).alias("_nchild"))
    return tree.join(n, [*by, node], "left").fillna(0, subset=["_nchild"])


STRATEGIES = ("best_of_n", "beam_search", "dvts")


def best_paths(tree: DataFrame, keep: int, n: int, rounds: int, by: Sequence[str] = ("problem_id",),
               node: str = "node_id", parent: str = "parent_id", text: str = "text", score: str = "score",
               stop: str = "stop_reason", checkpoint_every: int = 1, strategy: str = "beam_search", lookahead: int = 0) -> DataFrame:
    """The best paths of a logged tree, all problems at once, by a named strategy.

    ``beam_search``: round 0 starts at the roots. Each round expands every active path to its children
    (path text grows, score = the child's score), keeps the ``keep`` best new paths per problem (score,
    then lower node id), and retires a path when its node stops (``stop`` = EOS) or has no children.
    Returns the ``n`` best paths per problem (``rank`` 1..n): retired ones first, then those still
    active after the last round, with ``completed`` telling them apart.

    ``best_of_n``: every finished path of at most ``rounds`` steps is a candidate; the ``n`` best by the
    score of their last node are returned.

    ``dvts`` (diverse verifier tree search): the root's first ⌊n / keep⌋ children begin a subtree each,
    told apart by the column ``subtree``. Every round each active subtree expands its path to the node's
    first ``keep`` children and goes on with the best by look-ahead score (``lookahead`` greedy steps
    further; lowest id on ties); it ends on EOS, an empty step, a boxed answer, a leaf or after
    ``rounds``. Its last expansion is returned, ``keep`` rows best first (scores of the last round have
    no look-ahead); a subtree that never expanded returns its own node.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown search strategy {strategy!r}; expected one of {STRATEGIES}")
    by = list(by)
    if strategy == "dvts":
        return _subtree_paths(tree, keep, n, rounds, by, node, parent, text, score, stop, lookahead)
    if strategy == "best_of_n":
        return _finished_paths(tree, n, rounds, by, node, parent, text, score, stop)
    return _beam_paths(tree, keep, n, rounds, by, node, parent, text, score, stop, checkpoint_every)


def _beam_paths(tree: DataFrame, keep: int, n: int, rounds: int, by: list[str], node: str, parent: str, text: str,
                score: str, stop: str, checkpoint_every: int) -> DataFrame:
    spark = tree.sparkSession
    checkpoint_dir(spark)
    t = _children(tree, by, node, parent)
    t = t.withColumn("_done", F.coalesce(F.col(stop) == "EOS", F.lit(False)) | (F.col("_nchild") == 0))
    # partition the tree once by problem; rounds then shuffle only the frontier
    t = t.repartition(shuffle_partitions(spark), *by).checkpoint(eager=True)
    cols = [*by, node, "path", score, "_done", "depth"]
    frontier = t.filter(F.col(parent).isNull()).select(*by, node, F.col(text).alias("path"), score, "_done",
                                                       F.lit(0).alias("depth"))
    finished_parts = [frontier.filter("_done")]
    frontier = frontier.filter(~F.col("_done"))
    for r in range(1, rounds + 1):
        kids = frontier.select(*by, F.col(node).alias(parent), F.col("path").alias("_pp")).join(t, [*by, parent])
        new = kids.select(*by, node, F.concat("_pp", text).alias("path"), score, "_done", F.lit(r).alias("depth"))
        new = top_k_within(new, by, [F.col(score).desc(), F.col(node)], keep, "_rk", salt_cols=[*by, node]).drop("_rk")
        if r % checkpoint_every == 0:
            # each round's paths (at most `keep` per problem) are written once, so every round and
            # the stop check read one round of lineage instead of all earlier rounds again
            new = new.checkpoint(eager=True)
        finished_parts.append(new.filter("_done"))
        frontier = new.filter(~F.col("_done"))
        if frontier.isEmpty():
            break
    found = frontier
    for part in finished_parts:
        found = found.unionByName(part)
    out = top_k_within(found.select(*cols), by, [F.col("_done").desc(), F.col(score).desc(), F.col(node)], n, "rank", salt_cols=[*by, node])
    return out.withColumnRenamed("_done", "completed")


def _finished_paths(tree: DataFrame, n: int, rounds: int, by: list[str], node: str, parent: str, text: str, score: str, stop: str) -> DataFrame:
    """All paths from a root to a node that stops or has no children, not past an earlier stop; the n best.

    Paths are judged and ranked by their nodes alone; texts are read along the n best of each problem."""
    t = _children(tree, by, node, parent)
    stops = F.coalesce(F.col(stop) == "EOS", F.lit(False))
    up = t.select(*by, F.col(node).alias("_to"), F.struct(stops.alias("blocked"), F.lit(1).alias("depth")).alias("_v"))
    step = t.filter(F.col(parent).isNotNull()).select(*by, F.col(node).alias("_from"), F.col(parent).alias("_to")).join(up, [*by, "_to"])
    ends = t.filter(stops | (F.col("_nchild") == 0)).select(
        *by, node, F.col(score).alias("_score"), F.col(node).alias("_at"), F.struct(F.lit(False).alias("blocked"), F.lit(0).alias("depth")).alias("_acc"))

    def above(a: Column, b: Column) -> Column:
        return F.struct((a["blocked"] | b["blocked"]).alias("blocked"), (a["depth"] + b["depth"]).alias("depth"))

    tables: list[DataFrame] = []
    roots = t.filter(F.col(parent).isNull()).select(*by, F.col(node).alias("_at"))
    found = follow(ends, step, by, rounds, above, tables).join(roots, [*by, "_at"], "left_semi").filter(~F.col("_acc.blocked"))
    found = found.select(*by, node, F.col("_score").alias(score), F.col("_acc.depth").alias("depth"), F.lit(True).alias("completed"))
    best = top_k_within(found, by, [F.col(score).desc(), F.col(node)], n, "rank", salt_cols=[*by, node])
    if tables:
        best = best.checkpoint(eager=True)
    return best.join(_path_texts(best, tables, tree, by, node, text), [*by, node]).select(*by, node, "path", score, "depth", "completed", "rank")


def _path_texts(ends: DataFrame, tables: Sequence[DataFrame], tree: DataFrame, by: list[str], node: str, text: str) -> DataFrame:
    """(by…, node, path): the texts from ``depth`` moves above each end down to it. The places on a way are told by the
    binary digits of their distance, so the tables of 2^k moves (``follow``) give each of them once."""
    places = ends.select(*by, node, "depth", F.col(node).alias("_at"), F.lit(0).alias("_far"))
    for k in reversed(range(len(tables))):
        far = tables[k].filter(F.col("_v.depth") == 2**k).select(*by, F.col("_from").alias("_at"), F.col("_to"))
        more = places.filter(F.col("_far") + 2**k <= F.col("depth")).join(far, [*by, "_at"])
        # a few rows a problem, read twice by the next digit: written
        places = places.unionByName(more.select(*by, node, "depth", F.col("_to").alias("_at"), (F.col("_far") + 2**k).alias("_far"))).checkpoint(eager=True)
    said = places.join(tree.select(*by, F.col(node).alias("_at"), F.col(text).alias("_text")), [*by, "_at"])
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_far")).alias("place"), "_text"))), lambda x: x["_text"]), "")
    return said.groupBy(*by, node).agg(F.when(F.count("_text") == F.count("*"), whole).alias("path"))


def _subtree_paths(tree: DataFrame, width: int, n: int, rounds: int, by: list[str], node: str, parent: str, text: str, score: str,
                   stop: str, lookahead: int, write_every: int = 8) -> DataFrame:
    """Diverse verifier tree search; the state is one row per (problem, subtree) and nothing else moves between rounds."""
    spark = tree.sparkSession
    checkpoint_dir(spark)
    ended = F.coalesce(F.col(stop) == "EOS", F.lit(False)) | (F.col(text) == "")
    kids = tree.filter(F.col(parent).isNotNull())
    kids = kids.select(*by, parent, node, F.col(text).alias("_text"), F.col(score).alias("_own"), ended.alias("_ended"))
    if lookahead:
        kids = kids.join(_greedy_ends(tree, lookahead, by, node, parent, score), [*by, node], "left").withColumn("look", F.when(F.col("_moves"), F.col("_acc")).otherwise(F.col("_own")))
    else:
        kids = kids.withColumn("look", F.col("_own"))
    kids = top_k_within(kids, [*by, parent], [F.col(node)], max(width, n // width), "_place", salt_cols=[*by, node])
    # one row per node that has children, with the first of them: written once, and all that the rounds, the last fan-out and the leaves need
    kid = F.struct("_place", F.col(node).alias("to"), F.col("_text").alias("text"), F.col("_own").alias("own"), "look", F.col("_ended").alias("ended"))
    families = kids.groupBy(*by, parent).agg(F.array_sort(F.collect_list(kid)).alias("_kids")).checkpoint(eager=True)
    some = F.filter("_kids", lambda k: k["_place"] <= width)
    best = F.array_max(F.transform(some, lambda k: F.struct(k["look"].alias("look"), (-k["to"]).alias("first"), k["text"].alias("text"), k["ended"].alias("ended"))))
    choice = families.select(*by, F.col(parent).alias("_at"), best.alias("_b")).select(
        *by, "_at", F.struct((-F.col("_b.first")).alias("to"), F.col("_b.text").alias("text"), F.col("_b.ended").alias("ended")).alias("_c"))
    roots = tree.filter(F.col(parent).isNull()).select(*by, F.col(node).alias(parent), F.col(text).alias("_root"))
    first = families.join(roots, [*by, parent]).select(*by, "_root", F.inline(F.filter("_kids", lambda k: k["_place"] <= max(n // width, 1))))
    first = first.select(*by, "_root", F.col("to").alias(node), F.col("text").alias("_text"), F.col("own").alias("_own"), F.col("ended").alias("_ended"))
    boxed = lambda c: F.coalesce(F.contains(c, F.lit("boxed{")), F.lit(False))
    path = F.concat("_root", "_text")
    state = first.select(*by, F.col(node).alias("subtree"), F.col(node).alias("_at"), path.alias("_path"), (~F.col("_ended") & ~boxed(path)).alias("_active"),
                         F.col("_own"), F.lit(None).cast("bigint").alias("_from"), F.lit(None).cast("string").alias("_before"), F.lit(0).alias("_round"))
    for r in range(1, rounds + 1):
        j = state.join(choice, [*by, "_at"], "left")
        goes = F.col("_active") & F.col("_c").isNotNull()
        longer = F.concat("_path", "_c.text")
        pick = lambda yes, no: F.when(goes, yes).otherwise(F.col(no)).alias(no)
        state = j.select(*by, "subtree", pick(F.col("_c.to"), "_at"), pick(longer, "_path"), (goes & ~F.col("_c.ended") & ~boxed(longer)).alias("_active"),
                         "_own", pick(F.col("_at"), "_from"), pick(F.col("_path"), "_before"), pick(F.lit(r), "_round"))
        if r % write_every == 0 or r == rounds:
            state = state.checkpoint(eager=True)
            if r < rounds and state.filter("_active").isEmpty():
                break
    fan = state.filter(F.col("_from").isNotNull()).select(*by, "subtree", F.col("_from").alias(parent), "_before", "_round").join(families.select(*by, parent, some.alias("_kids")), [*by, parent])
    fan = fan.select(*by, "subtree", "_before", "_round", F.inline("_kids"))
    fan = fan.select(*by, "subtree", F.col("to").alias(node), F.concat("_before", "text").alias("path"), F.when(F.col("_round") == rounds, F.col("own")).otherwise(F.col("look")).alias(score),
                     (F.col("_round") + 1).alias("depth"), F.col("ended").alias("_ended"))
    alone = state.filter(F.col("_from").isNull()).select(*by, "subtree", F.col("subtree").alias(node), F.col("_path").alias("path"), F.col("_own").alias(score),
                                                         F.lit(1).alias("depth"), (~F.col("_active")).alias("_ended"))
    inner = families.select(*by, F.col(parent).alias(node), F.lit(False).alias("_leaf"))
    out = fan.unionByName(alone).join(inner, [*by, node], "left")
    done = F.col("_ended") | F.coalesce("_leaf", F.lit(True)) | boxed(F.col("path"))
    rank = F.row_number().over(Window.partitionBy(*by, "subtree").orderBy(F.col(score).desc(), F.col(node)))  # of width rows
    return out.select(*by, "subtree", node, "path", score, "depth", done.alias("completed"), rank.cast("bigint").alias("rank"))


STOP_REASONS = ("EOS", "length")


def beam_round(beams: DataFrame, expansions: DataFrame, n: int, width: int, by: Sequence[str] = ("problem_id",),
               dedup: bool = True) -> tuple[DataFrame, DataFrame]:
    """One beam-search round on tables.

    ``beams`` (by…, beam_id, text) are the active beams; ``expansions`` (by…, beam_id, exp_idx,
    next_text, stop_reason, score) their scored continuations. A continuation completes the beam
    on ``EOS``/``length`` or an empty step. Duplicated texts are dropped (first kept), the best
    ⌊n / width⌋ active ones per problem survive (later row first on equal scores), and the
    survivors are cycled to exactly n beams (new ``beam_id`` = slot). Returns (active, completed).
    """
    by = list(by)
    j = beams.join(expansions, [*by, "beam_id"]).withColumn("text", F.concat("text", "next_text")).withColumn(
        "completed", F.coalesce(F.col("stop_reason").isin(*STOP_REASONS), F.lit(False)) | (F.col("next_text") == ""))
    j = j.withColumn("_order", F.struct("beam_id", "exp_idx"))
    if dedup:
        j = dedup_first(j, by, "text", "_order")
    done = j.filter("completed")
    kept = prune_top(j.filter(~F.col("completed")), by, "score", "_order", max(n // width, 1))
    active = refill(kept, by, n).withColumn("beam_id", F.col("slot").cast("bigint"))
    return active.select(*by, "beam_id", "text", "score"), done.select(*by, "text", "score", "stop_reason", "_order")


def beam_finish(completed: DataFrame, n: int, by: Sequence[str] = ("problem_id",), sort: bool = True,
                order: str = "_order") -> DataFrame:
    """The top n finished beams (or the first n in ``order``), cycled to exactly n, and the
    prediction: the text of the best-scored one (first on ties)."""
    by = list(by)
    top = top_completed(completed, by, "score", order, n, sort)
    full = refill(top, by, n)
    return full.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("slot", "text", "score"))).alias("_b"),
        first_argmax(F.col("text"), "score", "slot").alias("pred"),
    ).select(*by, F.transform("_b", lambda x: x["text"]).alias("completions"),
             F.transform("_b", lambda x: x["score"]).alias("scores"), "pred")


def tree_round(beams: DataFrame, expansions: DataFrame, width: int, last: bool = False,
               by: Sequence[str] = ("problem_id",)) -> DataFrame:
    """One round of diverse verifier tree search. Each beam (subtree) keeps its best
    continuation by look-ahead score (lowest ``exp_idx`` on ties); a beam stops on ``EOS``, an empty
    step or a boxed answer. In the last round every beam fans out to its ``width`` best rows."""
    by = list(by)
    j = beams.join(expansions, [*by, "beam_id"]).withColumn("text", F.concat("text", "next_text"))
    j = j.withColumn("stopped", F.coalesce(F.col("stop_reason") == "EOS", F.lit(False)) | (F.col("next_text") == "")
                     | F.col("next_text").contains("boxed{"))
    if last:
        return top_k_within(j, [*by, "beam_id"], [F.col("score").desc(), F.col("exp_idx")], width, "rank",
                            salt_cols=[*by, "beam_id", "exp_idx"])
    best = j.groupBy(*by, "beam_id").agg(F.max_by(F.struct("text", "score", "stopped", "exp_idx"),
                                                   F.struct(F.col("score"), -F.col("exp_idx"))).alias("_b"))
    return best.select(*by, "beam_id", "_b.text", "_b.score", "_b.stopped", "_b.exp_idx")


def tree_finish(expanded: DataFrame, by: Sequence[str] = ("problem_id",)) -> DataFrame:
    """The end of diverse verifier tree search over the last round's rows (``tree_round`` with
    ``last``): per problem all completions and scores, subtree by subtree, best first inside each, and
    the prediction: the text of the best score, the first on ties. One output row per problem."""
    by = list(by)
    place = F.struct("beam_id", "rank")
    return expanded.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("beam_id", "rank", "text", "score"))).alias("_b"),
        F.min_by(F.col("text"), F.struct((-F.col("score")).alias("s"), place.alias("p"))).alias("pred"),
    ).select(*by, F.transform("_b", lambda x: x["text"]).alias("completions"), F.transform("_b", lambda x: x["score"]).alias("scores"), "pred")
