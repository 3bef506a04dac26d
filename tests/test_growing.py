"""A growing graph against the graph that is built anew."""

from __future__ import annotations

import random

import pytest

from tidemark.plans import graph
from tidemark.plans.growing import Growing, GraphError

EDGE, LABEL = "rev string, down string, kind string", "rev string, label string"


def frames(spark, nodes, edges, labels):
    return spark.createDataFrame([(n,) for n in nodes], "rev string"), spark.createDataFrame(edges, EDGE), spark.createDataFrame(labels, LABEL)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_insertions_equal_the_rebuild(spark):
    rnd = random.Random(2)
    nodes, edges, labels, state = [], [], [], None
    for _ in range(3):
        new, more, named = [], [], []
        for _ in range(12):
            i = len(nodes) + len(new)
            rev, old = f"r{i}", [*nodes, *new]
            recent = old[-6:] if rnd.random() < 0.8 else old
            parents = rnd.sample(recent, min(len(recent), rnd.choice((1, 1, 1, 1, 2)))) if old and rnd.random() > 0.05 else []
            more += [(rev, p, "down") for p in parents]
            if old and rnd.random() < 0.2:
                more.append((rev, rnd.choice(old), "dep"))
            if rnd.random() < 0.3:
                named.append((rev, f"label{i}"))
            new.append(rev)
        delta = frames(spark, new, more, named)
        nodes, edges, labels = nodes + new, edges + more, labels + named
        state = Growing.built(*delta) if state is None else state.added(*delta)
        whole = frames(spark, nodes, edges, labels)
        assert rows(state.heads) == rows(graph.heads(whole[0], graph.versioned(whole[1])))
        assert rows(state.bases) == rows(graph.bases(*whole[:2]))
        assert rows(state.depths) == rows(graph.ranks(*whole[:2]))
        assert rows(state.members()) == rows(graph.label_members(*whole[1:]))


def test_what_can_not_be_added(spark):
    state = Growing.built(*frames(spark, "ab", [("b", "a", "down")], [("a", "x")]))
    for nodes, edges, labels, error in (
        ("b", [], [], "is there already"), ("c", [("c", "z", "down")], [], "is not there"), ("c", [("a", "c", "down")], [], "not new"),
        ("c", [("c", "b", "down")], [("c", "x")], "on another"), ("cd", [("c", "d", "down"), ("d", "c", "down")], [], "cycle"),
    ):
        with pytest.raises(ValueError, match=error):
            state.added(*frames(spark, nodes, edges, labels))
    assert issubclass(GraphError, ValueError)
    assert rows(state.added(*frames(spark, [], [], [])).depths) == [("a", 0), ("b", 1)]
