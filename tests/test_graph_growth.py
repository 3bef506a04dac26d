"""What the loops over a graph send and write."""

from __future__ import annotations

from tidemark.plans import graph

EDGE = "rev string, down string, kind string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_rounds_of_many_rows_are_not_broadcast(spark, monkeypatch):
    plans, settled = [], graph.settled

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settled(df)

    monkeypatch.setattr(graph, "SMALL", 2, raising=False)
    monkeypatch.setattr(graph, "settled", watched)
    edges = spark.createDataFrame([(f"{k}{i}", f"{d}{i % 3}", "down") for k, d in ("ba", "cb") for i in range(12)] + [("a0", "r", "down"), ("a1", "r", "down"), ("a2", "r", "down")], EDGE)
    got = rows(graph.descendants(edges, spark.createDataFrame([("r",)], "rev string")))
    assert got == sorted([("r",), *((f"a{i}",) for i in range(3)), *((f"{k}{i}",) for k in "bc" for i in range(12))])
    assert any("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)


def test_dependencies_that_none_shares_are_not_followed(spark, monkeypatch):
    edges = spark.createDataFrame([("b", "a", "down"), ("c", "b", "down"), ("b", "x", "dep"), ("c", "y", "dep")], EDGE)
    with monkeypatch.context() as m:
        m.setattr(graph, "_reach", None)
        assert rows(graph.normalized(edges)) == rows(edges)
    shared = edges.union(spark.createDataFrame([("c", "x", "dep"), ("d", "x", "dep")], EDGE))
    assert rows(graph.normalized(shared)) == sorted(set(rows(shared)) - {("c", "x", "dep")})
    ring = edges.union(spark.createDataFrame([("a", "c", "down")], EDGE))
    assert rows(graph.normalized(ring)) == sorted(r for r in rows(ring) if r[2] == "down")


def test_peeling_writes_what_it_meets(spark, monkeypatch):
    written, settle = [], graph.settle

    def watched(df):
        out = settle(df)
        written.append(out.count())
        return out

    chain = [(f"{i:02}", f"{i - 1:02}", "down") for i in range(1, 10)]
    edges = spark.createDataFrame(chain + [(f"leaf{i}", "09", "down") for i in range(200)] + [("x", "y", "down"), ("y", "x", "down"), ("x", "00", "down")], EDGE)
    nodes = edges.select("rev").union(edges.select("down")).distinct()
    monkeypatch.setattr(graph, "settle", watched)
    out, left = graph._peeled(edges, nodes)
    assert rows(out) == sorted([(f"{i:02}", i) for i in range(10)] + [(f"leaf{i}", 10) for i in range(200)])
    assert rows(left) == [("x", "y"), ("y", "x")]
    assert sum(written) < 4 * 212


def below(edges):
    """Descendants by walking, of all that have any."""
    children, out = {}, {}
    for rev, down in {(r, d) for r, d, _ in edges}:
        children.setdefault(down, set()).add(rev)
    for top in children:
        seen, todo = set(), list(children[top])
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += children.get(x, ())
        out[top] = len(seen)
    return sorted(out.items())


def test_descendants_are_counted_without_pairs(spark, monkeypatch):
    made = [(str(k), str((k - 1) // 2), "down") for k in range(1, 120)] + [(str(k), str(k - 4), "down") for k in range(12, 120, 9)]
    made += [(str(k), str(k - 7), "dep") for k in range(10, 120, 5)] + [(f"leaf{k}", "3", "down") for k in range(80)] + made[:5]
    edges = spark.createDataFrame(made, EDGE)
    with monkeypatch.context() as m:
        m.setattr(graph, "closure", None)
        m.setattr(graph, "HUB", 16)
        m.setattr(graph, "SMALL", 40)
        assert rows(graph.descendant_counts(edges)) == below(made)
    ring = [("a", "b", "down"), ("b", "c", "down"), ("c", "a", "down"), ("x", "a", "down"), ("y", "x", "dep"), ("c", "t", "down"), ("t", "s", "dep"), ("z", "s", "down"), ("q", "q", "down")]
    more = [*ring, *made[:20], ("0", "a", "down")]
    assert rows(graph.descendant_counts(spark.createDataFrame([*more, (None, "a", "down"), ("a", None, "down")], EDGE))) == below(more)
