from __future__ import annotations

import pytest

from tidemark.plans import graph
from tidemark.plans.versions import (
    CycleError,
    DependencyCycleError,
    DependencyLoopError,
    History,
    LoopError,
    Migrator,
    RangeError,
    Revision,
    RevisionError,
    VersionTable,
)


def history(*rows):
    return History(Revision(r, tuple(down), tuple(dep), tuple(labels)) for r, down, dep, labels in rows)


def plain(**parents):
    return history(*((r, p.split(), (), ()) for r, p in parents.items()))


# Graphs whose orders and heads are known.
DIAMOND = plain(a="", b1="a", b2="a", c="b1 b2", d="c")
BRANCHES = plain(a="", b1="a", b2="a", cb1="b1", cb2="b2", d1cb1="cb1", d2cb1="cb1", d1cb2="cb2", d2cb2="cb2", d3cb2="cb2", d1d2cb2="d1cb2 d2cb2")


def test_order():
    assert DIAMOND.order(DIAMOND.revisions) == ["d", "c", "b1", "b2", "a"]
    got = BRANCHES.order(BRANCHES.ancestors(["d1d2cb2"]))
    assert got == ["d1d2cb2", "d1cb2", "d2cb2", "cb2", "b2", "a"]
    assert plain().order([]) == []


def test_order_respects_ancestors():
    for h in (DIAMOND, BRANCHES):
        order = h.order(h.revisions)
        for r in order:
            assert all(order.index(r) <= order.index(a) for a in h.ancestors([r]))


def test_targets():
    assert BRANCHES.resolve("base") == [] and DIAMOND.resolve("head") == ["d"]
    assert DIAMOND.resolve("d-1") == ["c"] and DIAMOND.resolve("+1", ["c"]) == ["d"]
    with pytest.raises(RevisionError, match="several heads"):
        BRANCHES.resolve("head")
    with pytest.raises(RevisionError, match="ambiguous"):
        DIAMOND.resolve("+1", ["a"])
    with pytest.raises(RevisionError, match="that far"):
        DIAMOND.resolve("+1", ["d"])
    assert BRANCHES.resolve("d1d2") == ["d1d2cb2"]
    with pytest.raises(RevisionError, match="no revision"):
        BRANCHES.resolve("zz")


def test_labels():
    h = history(("a", [], [], []), ("b", ["a"], [], ["left"]), ("c", ["a"], [], ["right"]), ("d", ["b"], ["right"], []))
    assert h.resolve("left@head") == ["d"] and h.resolve("right") == ["c"]
    assert h.upgrade([], "d") in (["a", "c", "b", "d"], ["a", "b", "c", "d"])
    with pytest.raises(RevisionError, match="label"):
        history(("a", [], [], ["x"]), ("b", ["a"], [], ["x"]))


def test_bad_graphs():
    with pytest.raises(RevisionError, match="cycle"):
        plain(a="c", b="a", c="b")
    with pytest.raises(RevisionError, match="itself"):
        plain(a="a")
    with pytest.raises(RevisionError, match="not there"):
        plain(a="zz")
    with pytest.raises(ValueError, match="not allowed"):
        plain(**{"a-b": ""})


def test_kinds_of_bad_graphs():
    with pytest.raises(RevisionError, match="more than once"):
        History([Revision("a"), Revision("a")])
    with pytest.raises(CycleError) as e:
        plain(a="b", b="a")
    assert not isinstance(e.value, DependencyCycleError)
    with pytest.raises(DependencyCycleError):
        history(("a", [], ["b"], []), ("b", ["a"], [], []))
    with pytest.raises(LoopError):
        plain(a="a")
    with pytest.raises(DependencyLoopError):
        history(("a", [], ["a"], []))


def test_ranges():
    assert BRANCHES.between("d1d2cb2", "b2") == ["d1d2cb2", "d1cb2", "d2cb2", "cb2"]
    assert BRANCHES.between("cb2", "b2", inclusive=True) == ["cb2", "b2"]
    with pytest.raises(RangeError):
        BRANCHES.between("d1d2cb2", "cb1")
    assert BRANCHES.between("cb2", "cb1", implicit_base=True) == ["cb2", "b2"]


def test_stamps():
    two = plain(a1="", a2="a1", b1="", b2="b1", c="a2 b2")
    assert two.stamped(["a1"], "b1") == ["a1", "b1"]
    assert two.stamped(["a2", "b1"], "a1") == ["b1", "a1"]
    assert two.stamped(["a2", "b1"], "c") == ["c"]
    assert two.stamped(["a2", "b1"], "base") == []
    assert set(two.stamped([], "heads")) == {"c"}
    assert two.stamped(["c"], "a2") == ["a2"]


def test_added_revision():
    h = DIAMOND.added(Revision("e", ("d",)))
    assert h.heads() == ["e"] and DIAMOND.heads() == ["d"]
    with pytest.raises(RevisionError, match="more than once"):
        h.added(Revision("e", ("c",)))
    assert h.added(Revision("e", ("c",)), instead=True).heads() == ["d", "e"]


@pytest.mark.parametrize("steps, heads", [  # fixed values: steps of a version table and the heads after them
    (["+a"], {"a"}), (["+a", "+b"], {"b"}), (["+a", "-a"], set()), (["+a", "+b", "+c", "+d", "+e1", "+e2"], {"b", "e1", "e2"}),
])
def test_version_transitions(steps, heads):
    h, now = plain(a="", b="a", c="", d="c", e1="d", e2="d"), []
    for s in steps:
        now = h.heads_after(now, [s[1:]] if s[0] == "+" else [], [s[1:]] if s[0] == "-" else [])
    assert set(now) == heads


def test_plans_and_heads():
    assert DIAMOND.upgrade(["a"], "head")[-2:] == ["c", "d"]
    assert DIAMOND.downgrade(["d"], "a") [:2] == ["d", "c"]
    assert set(DIAMOND.downgrade(["d"], "base")) == set(DIAMOND.revisions)
    with pytest.raises(RevisionError, match="no ancestor"):
        BRANCHES.downgrade(["cb1"], "cb2")
    assert set(DIAMOND.heads_after(["b1", "b2"], ["c"])) == {"c"}
    assert set(DIAMOND.heads_after(["c"], undone=["c"])) == {"b1", "b2"}
    assert set(DIAMOND.heads_after(["a"], ["b1", "b2"])) == {"b1", "b2"}


def test_migrator(spark):
    ran = []
    steps = [("a", ""), ("b1", "a"), ("b2", "a"), ("c", "b1 b2")]
    h = History(
        Revision(r, tuple(p.split()), upgrade=lambda db, r=r: ran.append(f"+{r}"), downgrade=lambda db, r=r: ran.append(f"-{r}"))
        for r, p in steps
    )
    versions = VersionTable(spark, "versions_test")
    versions.drop()
    m = Migrator(spark, h, versions)
    assert versions.heads() == []
    m.upgrade("b1", object())
    assert versions.heads() == ["b1"]
    m.upgrade("head", object())
    assert versions.heads() == ["c"] and ran[0] == "+a" and ran[-1] == "+c"
    m.downgrade("c-1", object()) if False else m.downgrade("a", object())
    assert versions.heads() == ["a"]
    m.stamp("c")
    assert versions.heads() == ["c"]
    with pytest.raises(RevisionError, match="holds"):
        versions.write(["x"], ["not there"])
    assert [r[0] for r in spark.table("versions_test").collect()] == ["c"]
    versions.ensure(purge=True)
    assert versions.heads() == [] and spark.table("versions_test").count() == 0
    versions.drop()


def test_of_two_migrators_one_wins(spark):
    from concurrent.futures import ThreadPoolExecutor

    h = plain(a="", b="a", c="b")
    tables = [VersionTable(spark, "versions_race") for _ in range(2)]
    tables[0].drop()
    number, current = tables[0].state()
    tables[1].write(["a"], [])
    with pytest.raises(RevisionError, match="another migration"):
        tables[0].write(["a"], current, number)
    tables[1].write([], ["a"])
    with pytest.raises(RevisionError, match="another migration"):
        tables[0].write(["a"], current, number)  # as it was, but not the state that was read

    def run(t):
        try:
            return Migrator(spark, h, t).upgrade("head")
        except RevisionError:
            return None

    for _ in range(3):
        with ThreadPoolExecutor(2) as pool:
            done = list(pool.map(run, tables))
        assert any(x is not None for x in done) and tables[0].heads() == ["c"]
        tables[0].write([], ["c"])
    tables[0].drop()


@pytest.mark.parametrize("h", [DIAMOND, BRANCHES])
def test_frames_agree(spark, h):
    nodes, edges = h.frames(spark)
    got = lambda df: sorted(r[0] for r in df.select("rev").collect())
    assert got(graph.heads(nodes, graph.versioned(edges))) == sorted(h.heads())
    assert got(graph.bases(nodes, edges)) == sorted(h.bases())
    target = h.heads()[0]
    seed = nodes.where(f"rev = '{target}'")
    assert got(graph.ancestors(edges, seed)) == sorted(h.ancestors([target]))
    places = {r["rev"]: r["place"] for r in graph.topological(nodes, edges).collect()}
    for r in h.revisions:
        assert all(places[a] <= places[r] for a in h.ancestors([r]))


def test_cycles_in_frames(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "rev string")
    edges = spark.createDataFrame([("a", "b", "down"), ("b", "a", "down"), ("c", "a", "down")], "rev string, down string, kind string")
    with pytest.raises(graph.CycleError):
        graph.ranks(nodes, edges)
    assert sorted(r[0] for r in graph.cycle_members(nodes, edges).collect()) == ["a", "b"]


def test_large_graph(spark):
    """A graph of some hundred revisions against plain loops."""
    import random

    rnd = random.Random(5)
    parents = {f"r{i}": {f"r{rnd.randrange(max(0, i - 9), i)}" for _ in range(rnd.choice((1, 1, 2)))} if i else set() for i in range(200)}
    edges = spark.createDataFrame([(r, p, "down") for r, ps in parents.items() for p in ps], "rev string, down string, kind string")
    nodes = spark.createDataFrame([(r,) for r in parents], "rev string")
    above, depth = {}, {}
    for r, ps in parents.items():
        above[r] = set(ps).union(*(above[p] for p in ps))
        depth[r] = 1 + max((depth[p] for p in ps), default=-1)
    assert {tuple(r) for r in graph.closure(edges).collect()} == {(r, a) for r in parents for a in above[r]}
    out = graph.topological(nodes, edges).collect()
    assert {r["rev"]: r["depth"] for r in out} == depth
    assert [r["rev"] for r in sorted(out, key=lambda r: r["place"])] == sorted(parents, key=lambda r: (depth[r], r))
    assert sorted(r["place"] for r in out) == list(range(1, 201))
    some = nodes.where("rev in ('r20', 'r40', 'r41', 'r199')")
    names = ("r20", "r40", "r41", "r199")
    want = {r for r in names if not any(r in above[o] for o in names)}
    assert {r["rev"] for r in graph.branch_heads(edges, some).collect()} == want
    stamped = graph.stamped(edges, some, nodes.where("rev = 'r40'"))
    assert {r["rev"] for r in stamped.collect()} == {"r40"} | {r for r in names if r not in above["r40"] and "r40" not in above[r]}


def test_normalized(spark):
    rows = [("a2", "a1"), ("a3", "a2"), ("b2", "b1"), ("b3", "b2"), ("b4", "b3")]
    edges = [(a, b, "down") for a, b in rows] + [("b2", "a3", "dep"), ("b4", "a3", "dep")]
    out = graph.normalized(spark.createDataFrame(edges, "rev string, down string, kind string"))
    assert {tuple(r) for r in out.where("kind = 'dep'").collect()} == {("b2", "a3", "dep")}


def test_getting_and_walking():
    h = BRANCHES
    assert [r.rev for r in h.get("a", "cb1")] == ["a", "cb1"] and plain().current_head() is None and DIAMOND.current_head() == "d"
    with pytest.raises(RevisionError):
        h.current_head()
    assert h.walk("cb1", -1) == "b1" and h.walk("cb1", -9) == "base" and h.walk("d1cb1", 1) is None and h.walk("d1cb1", 3, stay=True) == "d1cb1"
    with pytest.raises(RevisionError, match="ambiguous"):
        h.walk("a", 1)
    with pytest.raises(RevisionError, match="ambiguous"):
        h.walk("cb2", 1)
    assert h.walk("d1cb2", 1) == "d1d2cb2"


def test_walking_and_overlaps_in_frames(spark):
    nodes, edges = DIAMOND.frames(spark)
    at = lambda *revs: nodes.where(nodes.rev.isin(*revs))
    got = lambda df: sorted(r[0] for r in df.collect())
    assert got(graph.walk(edges, at("c"), -1)) == ["b1", "b2"] and got(graph.walk(edges, at("c", "a"), 2)) == ["c"]
    assert got(graph.walk(edges, at("c", "a"), 2, stay=True)) == ["c", "d"] and got(graph.walk(edges, at("b1"), -5)) == []
    assert got(graph.overlapping(edges, at("b1", "b2"))) == [] and got(graph.overlapping(edges, at("b1", "d", "a"))) == ["a", "b1"]
    with pytest.raises(graph.OverlapError):
        graph.ancestors(edges, at("b1", "d"), check=True)
    assert got(graph.ancestors(edges, at("b1", "b2"), check=True)) == ["a", "b1", "b2"]
