"""Named search strategies, pointer doubling and numbered step scores on small tables."""

import pytest

from stepjudge.operators import scoring as SC
from stepjudge.operators import search as SE

TREE = "problem_id bigint, node_id bigint, parent_id bigint, text string, score double, stop_reason string"


def chain(n, problem=1):
    return [(problem, i, i - 1 if i else None, f"{i} ", i / 10, None) for i in range(n)]


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        SE.best_paths(spark.createDataFrame(chain(2), TREE), 1, 1, 1, strategy="astar")


@pytest.mark.parametrize("depth", [0, 1, 2, 3, 5, 8, 16, 40])
def test_lookahead_over_a_chain(spark, depth):
    t = spark.createDataFrame(chain(20) + chain(1, 2), TREE)
    got = {(r.problem_id, r.node_id): r.lookahead for r in SE.lookahead_text(t, depth).collect()}
    assert got == {(1, i): "".join(f"{j} " for j in range(i, min(i + depth, 19) + 1)) for i in range(20)} | {(2, 0): "0 "}


def test_sixteen_steps_take_five_joins(spark, monkeypatch):
    t = spark.createDataFrame(chain(20), TREE)
    joins, join = [], type(t).join
    monkeypatch.setattr(type(t), "join", lambda self, *a, **k: joins.append(a) or join(self, *a, **k))
    out = SE.lookahead_text(t, 16)
    assert len(joins) == 5 and out._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 5


def test_subtrees_that_never_expand(spark):
    rows = [(1, 0, None, "r ", 0.0, None), (1, 1, 0, "a ", 0.5, "EOS"), (1, 2, 0, "b ", 0.1, None), (1, 3, 2, "boxed{1} ", 0.2, None), (1, 4, 2, "c ", 0.9, None),
            (1, 5, 2, "d ", 1.0, None), (1, 6, 0, "e ", 0.3, None), (2, 0, None, "only ", 0.0, None)]
    got = SE.best_paths(spark.createDataFrame(rows, TREE), keep=2, n=6, rounds=3, strategy="dvts").collect()
    assert sorted((r.subtree, r.rank, r.path, r.completed) for r in got) == [
        (1, 1, "r a ", True), (2, 1, "r b c ", True), (2, 2, "r b boxed{1} ", True), (6, 1, "r e ", True)]


def test_best_of_n_stops_at_the_first_stop(spark):
    rows = [(1, 0, None, "r ", 0.0, None), (1, 1, 0, "a ", 0.5, "EOS"), (1, 2, 1, "past ", 0.9, None), (1, 3, 0, "b ", 0.4, None), (1, 4, 3, "c ", 0.4, None)]
    got = SE.best_paths(spark.createDataFrame(rows, TREE), keep=1, n=3, rounds=5, strategy="best_of_n").collect()
    assert sorted((r.rank, r.path, r.depth) for r in got) == [(1, "r a ", 1), (2, "r b c ", 2)]


def test_step_scores_are_numbered_and_missing_ones_null(spark):
    rows = [("k", 5, -0.1, -2.0, "Yes"), ("k", 2, -0.1, None, " Yes"), ("k", 1, -3.0, -0.2, "No "), ("k", 7, -0.1, -0.2, "The"), ("skipped", 1, None, -0.1, "No"), ("none", 1, -0.1, -0.2, "The")]
    df = spark.createDataFrame(rows, "k string, pos int, yes double, no double, top string")
    steps = spark.createDataFrame([("k", 4), ("skipped", 2), ("none", 3), ("unseen", 1)], "k string, n_steps int")
    got = SC.scores_from_logprobs(df, "k", "pos", "yes", "no", "top", steps=steps).collect()
    assert sorted((r.k, r.step_idx, r.pos, r.confidence is None) for r in got if r.k == "k") == [("k", 0, 1, False), ("k", 1, 5, False)]
    assert sorted((r.k, r.step_idx) for r in got if r.confidence is None) == [("none", 0), ("none", 1), ("none", 2), ("unseen", 0)]
    assert not [r for r in got if r.k == "skipped"]
