"""The revision graph as DataFrames: nodes (rev, ...) and edges (rev, down, kind).

kind is ``down`` for versioned edges and ``dep`` for dependencies. Closures are loops of a frontier
joined with the edges, an anti-join with what has been seen, and a lineage cut; so diamonds don't
multiply paths, and the work of a round is that of its frontier. Only ``closure`` makes all pairs; the
other questions are asked from their seeds, or by peeling. All descendants of all revisions are counted in sets of intervals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..sources.scratch import forget, settle, settled

#: Rounds after which the tables of what has been seen become one.
MERGE = 8
#: Rows up to which a round's table may be broadcast. What is larger is shuffled, so that the driver gets little of a round however large the graph is.
SMALL = 1 << 15
#: Children up to which a revision's intervals are merged at once; those of one with more are merged by blocks of so many places before.
HUB = 1 << 15


def _sized(df: DataFrame, n: int) -> DataFrame:
    """``df`` of ``n`` rows as a join's side: broadcast if it is small, else shuffled."""
    return F.broadcast(df) if n <= SMALL else df.hint("merge")


class CycleError(ValueError):
    pass


def versioned(edges: DataFrame) -> DataFrame:
    return edges.where("kind = 'down'")


def heads(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Revisions that no edge points to."""
    return nodes.select("rev").join(edges.select(F.col("down").alias("rev")).distinct(), "rev", "left_anti")


def bases(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Revisions that point to none."""
    return nodes.select("rev").join(edges.select("rev").distinct(), "rev", "left_anti")


def branch_points(edges: DataFrame) -> DataFrame:
    """Revisions with several versioned children."""
    return versioned(edges).groupBy(F.col("down").alias("rev")).agg(F.countDistinct("rev").alias("n")).where("n > 1")


def merge_points(edges: DataFrame) -> DataFrame:
    """Revisions with several versioned parents."""
    return versioned(edges).groupBy("rev").agg(F.countDistinct("down").alias("n")).where("n > 1")


def _reach(steps: DataFrame, seeds: DataFrame, *origin: str) -> DataFrame:
    """Rows (rev) reached from ``seeds`` (rev) over ``steps`` (at, to), seeds included; for each value of ``origin`` apart."""
    key = ["rev", *origin]
    steps = settle(steps.distinct())
    frontier, n = settled(seeds.select(*key).distinct())
    seen, total = [frontier], n
    while n:
        met = steps.join(_sized(frontier, n), F.col("rev") == F.col("at")).select(F.col("to").alias("rev"), *origin).distinct()
        frontier, n = settled(met.join(_sized(reduce(DataFrame.unionAll, seen), total), key, "left_anti"))
        seen.append(frontier)
        total += n
        if len(seen) > MERGE:
            one = settle(reduce(DataFrame.unionAll, seen))
            forget(*seen[:-1])
            seen = [one]
    forget(steps)
    return reduce(DataFrame.unionAll, seen)


class OverlapError(ValueError):
    """Targets of one question are on one line of descent."""


def ancestors(edges: DataFrame, seeds: DataFrame, check: bool = False) -> DataFrame:
    """``seeds`` and all above them; ``check``: an error if one of them is an ancestor of another."""
    if check and (bad := overlapping(edges, seeds).take(1)):
        raise OverlapError(f"revision {bad[0][0]} is an ancestor of another that was asked for")
    return _reach(edges.select(F.col("rev").alias("at"), F.col("down").alias("to")), seeds)


def descendants(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return _reach(edges.select(F.col("down").alias("at"), F.col("rev").alias("to")), seeds)


def overlapping(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Those of ``targets`` that are an ancestor of another of them."""
    return targets.select("rev").distinct().join(branch_heads(edges, targets), "rev", "left_anti")


def lineage(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """All that share a line of descent with ``seeds``."""
    return ancestors(edges, seeds).union(descendants(edges, seeds)).distinct()


def closure(edges: DataFrame) -> DataFrame:
    """All pairs (rev, up) with up a proper ancestor: as many as there are, in log2(depth) rounds.

    A round adds the ways on by 2^k steps, and finds the ways of 2^(k+1) steps for the next.
    """
    pairs, size = settled(edges.select("rev", F.col("down").alias("up")).distinct())
    jumps = pairs
    while True:
        on = jumps.select(F.col("rev").alias("up"), F.col("up").alias("above"))
        more = pairs.join(on, "up").select("rev", F.col("above").alias("up"))
        all_, now = settled(pairs.unionByName(more).distinct())
        if now == size:
            return all_
        further = settle(jumps.join(on, "up").select("rev", F.col("above").alias("up")).distinct())
        forget(pairs, jumps)
        pairs, jumps, size = all_, further, now


def descendant_counts(edges: DataFrame) -> DataFrame:
    """rev, n_descendants of all revisions that have any; one on a cycle is among its own. Edges with a null are none.

    Descendants are kept as intervals of the places of a spanning forest: a tree's are one interval, and others come for each way out of it. They
    are handed from children to parents as these have all of theirs, so that each goes once over each link and pairs are never made. What lies on or
    above a cycle takes what it needs by the closure of these alone.
    """
    links = settle(edges.select("rev", "down").where("rev is not null and down is not null").distinct())
    nodes = settle(links.select("rev").union(links.select("down")).distinct().withColumn("id", F.monotonically_increasing_id()))
    places = _placed(nodes, links)
    total = places.count()
    known = links.join(places.select("rev", F.col("place").alias("child")), "rev").join(places.select(F.col("rev").alias("down"), F.col("place").alias("at")), "down")
    known = settle(known.select("child", "at"))
    counts = known.groupBy("at").agg(F.count(F.lit(1)).alias("need"))
    hub = (counts.agg(F.max("need")).first()[0] or 0) > HUB
    steps = settle(known.join(counts, "at"))
    leaves = places.select(F.col("place").alias("at")).join(counts, "at", "left_anti")
    free, n = settled(leaves.select("at", F.col("at").alias("start"), F.col("at").alias("stop"), F.lit(1).cast("long").alias("n")))
    left, tables, out, waiting = total - n, [free], [], None
    while n and left:
        own = F.struct("start", "stop", "n")
        self_ = F.struct(F.col("at").alias("start"), F.col("at").alias("stop"), F.lit(0).cast("long").alias("n"))
        met = steps.join(_sized(free.withColumnRenamed("at", "child"), n), "child")
        # of a child's rows one has n = 1, and brings the parent itself along
        met = met.select("at", "need", F.explode(F.when(F.col("n") == 1, F.array(own, self_)).otherwise(F.array(own))).alias("x")).select("at", "need", "x.*")
        met = met if waiting is None else met.unionByName(waiting)
        seen = Observation()
        now = _merged(met, hub).withColumn("all", F.sum("n").over(Window.partitionBy("at")))
        done = F.col("all") == F.col("need")
        now = settle(now.observe(seen, F.count_if(done).alias("rows"), F.count_if(done & (F.col("island") == 1)).alias("revs")))
        n, left = seen.get["rows"], left - seen.get["revs"]
        free = now.where(done).select("at", "start", "stop", (F.col("island") == 1).cast("long").alias("n"))
        waiting = now.where(F.col("all") < F.col("need")).select("at", "need", "start", "stop", "n")
        out.append(_lengths(free, F.lit(-1)))
        tables.append(now)
        if len(tables) > MERGE:
            one = settle(reduce(DataFrame.unionAll, out))
            forget(*tables[:-1])
            out, tables = [one], [now]
    if left:
        out.append(_turning(steps, waiting, reduce(DataFrame.unionAll, [leaves, *(x.select("at") for x in out)]), hub))
    found = settle(reduce(DataFrame.unionAll, out or [_lengths(free, F.lit(-1))]))
    forget(links, nodes, known, steps, *tables)
    return found.join(places.select(F.col("place").alias("at"), "rev"), "at").where("n_descendants > 0").select("rev", "n_descendants")


def _lengths(intervals: DataFrame, more) -> DataFrame:
    return intervals.groupBy("at").agg((F.sum(F.col("stop") - F.col("start") + 1) + more).alias("n_descendants"))


def _merged(rows: DataFrame, hub: bool = False) -> DataFrame:
    """at, start, stop, n, need, island: ``rows`` without the last, the intervals of one ``at`` merged that overlap or touch. Islands count from 1."""

    def once(rows, *block):
        w = Window.partitionBy("at", *block).orderBy("start", "stop")
        before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
        fresh = rows.withColumn("_new", F.when(F.col("start") <= before + 1, 0).otherwise(1))
        apart = fresh.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        ends = F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("n"), F.max("need").alias("need")
        return apart.groupBy("at", *block, "island").agg(*ends).select("at", "start", "stop", "n", "need", "island")

    if hub:
        rows = once(rows.withColumn("_block", F.floor(F.col("start") / HUB)), "_block").drop("island")
    return once(rows)


def _turning(steps: DataFrame, waiting: DataFrame | None, free: DataFrame, hub: bool) -> DataFrame:
    """at, n_descendants of what has no end below: what ``waiting`` has got of the others, for each that is reached within."""
    inner = settle(steps.join(free.select(F.col("at").alias("child")), "child", "left_anti").select("child", "at"))
    pairs = settle(closure(inner.select(F.col("child").alias("rev"), F.col("at").alias("down"))))
    rows = inner.select("at").union(inner.select("child")).distinct().select("at", F.col("at").alias("start"), F.col("at").alias("stop"))
    rows = rows if waiting is None else rows.unionAll(waiting.select("at", "start", "stop"))
    ways = pairs.select(F.col("rev").alias("at"), "up").unionAll(inner.select("at", F.col("at").alias("up")).distinct()).distinct()
    have = rows.join(ways, "at").select(F.col("up").alias("at"), "start", "stop", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("need"))
    own = pairs.where("rev = up").select(F.col("up").alias("at"), F.lit(1).alias("own"))
    counted = _lengths(_merged(have, hub), F.lit(-1)).join(own, "at", "left")
    return counted.select("at", (F.col("n_descendants") + F.coalesce("own", F.lit(0))).alias("n_descendants"))


def _placed(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """rev, place: numbers of ``nodes`` (rev, id) by which those below one in a spanning forest follow it without a gap.

    A revision hangs on one of its parents. Sizes and places come by doubling: a round adds up twice as many generations.
    """
    up = links.groupBy("rev").agg(F.min("down").alias("down"))
    tree = nodes.join(up, "rev", "left").join(nodes.select(F.col("rev").alias("down"), F.col("id").alias("up")), "down", "left")
    tree = settle(tree.select("rev", "id", "up"))
    tab, live = _counted(tree.select("id", "up", F.lit(1).cast("long").alias("size")))
    while live:
        more = tab.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("more"))
        on = tab.select(F.col("id").alias("up"), F.col("up").alias("next"))
        after, now = _counted(tab.join(more, "id", "left").join(on, "up", "left").select("id", F.col("next").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        forget(tab)
        tab = after
        if now == live:  # what is left hangs on a ring
            break
        live = now
    # each below one of a ring stands alone
    whole = tree.join(tab.select("id", F.col("up").alias("_ring"), "size"), "id").select(
        "rev", "id", F.when(F.col("_ring").isNull(), F.col("up")).alias("up"), F.when(F.col("_ring").isNull(), F.col("size")).otherwise(1).alias("size")
    )
    dealt = settle(whole.repartitionByRange("up", "id").withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part").agg(F.sum("size").alias("_all"))
    sums = sums.select("_part", (F.sum("_all").over(Window.orderBy("_part")) - F.col("_all")).alias("_before"))  # a row for each partition
    within = F.sum("size").over(Window.partitionBy("_part").orderBy(F.col("up").asc_nulls_first(), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = settle(dealt.withColumn("_run", within - F.col("size")).join(F.broadcast(sums), "_part").select("rev", "id", "up", (F.col("_run") + F.col("_before")).alias("run")))
    first = run.where("up is not null").groupBy("up").agg(F.min("run").alias("_first"))
    tab, live = _counted(run.join(first, "up", "left").select("rev", "id", "up", F.when(F.col("up").isNull(), F.col("run")).otherwise(F.col("run") - F.col("_first") + 1).alias("place")))
    forget(tree, dealt, run)
    while live:
        on = tab.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("place").alias("more"))
        after, live = _counted(tab.join(on, "up", "left").select("rev", "id", F.col("next").alias("up"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place")))
        forget(tab)
        tab = after
    return tab.select("rev", "place")


def _counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``settle``, with the number of rows that have an ``up``."""
    seen = Observation()
    out = settle(df.observe(seen, F.count("up").alias("n")))
    return out, seen.get["n"]


def upgrade_set(edges: DataFrame, current: DataFrame, target: DataFrame) -> DataFrame:
    """What an upgrade from ``current`` to ``target`` runs."""
    return ancestors(edges, target).join(ancestors(edges, current), "rev", "left_anti")


def downgrade_set(edges: DataFrame, applied_heads: DataFrame, target: DataFrame) -> DataFrame:
    """What a downgrade to ``target`` undoes: its applied descendants, without itself."""
    below = descendants(edges, target).join(target.select("rev"), "rev", "left_anti")
    return below.join(ancestors(edges, applied_heads), "rev", "left_semi")


def branch_heads(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Those of ``targets`` that are no ancestor of another of them."""
    parents = edges.join(targets.select("rev"), "rev", "left_semi").select(F.col("down").alias("rev"))
    return targets.select("rev").join(ancestors(edges, parents), "rev", "left_anti")


def normalized(edges: DataFrame) -> DataFrame:
    """``edges`` without the dependencies that a versioned ancestor has already.

    An ancestor can only have one that several revisions have, or on a cycle its own; revisions without such are not followed up.
    """
    deps = edges.where("kind = 'dep'")
    own = versioned(edges)
    shared = deps.groupBy("down").agg(F.countDistinct("rev").alias("n")).where("n > 1").select("down")
    turned = own.select(F.col("down").alias("rev"), F.col("rev").alias("down"))
    turning = _peeled(turned, turned.select("rev").union(turned.select("down")))[1].select(F.col("down").alias("rev"))
    open_ = deps.join(shared, "down", "left_semi").select("rev", "down").union(deps.join(turning, "rev", "left_semi").select("rev", "down"))
    open_, n = settled(open_.distinct())
    if not n:
        return own.unionByName(deps)
    seeds = own.join(open_.select("rev").distinct(), "rev").select(F.col("rev").alias("origin"), F.col("down").alias("rev"))
    above = _reach(own.select(F.col("rev").alias("at"), F.col("down").alias("to")), seeds, "origin")
    inherited = above.join(open_, "rev").select(F.col("origin").alias("rev"), "down").distinct()
    return own.unionByName(deps.join(inherited, ["rev", "down"], "left_anti"))


def levels(links: DataFrame, start: DataFrame) -> DataFrame:
    """rev, depth: ``start``, and what has links (rev, down) to such rows only, one above the highest of them.

    A round meets only the links to what the round before has found; of revisions with other links left it keeps how many were met.
    """
    need = links.select("rev", "down").distinct()
    need = need.join(need.groupBy("rev").agg(F.count(F.lit(1)).alias("need")), "rev")
    need = settle(need)
    free, n = settled(start.select("rev", "depth"))
    tables, out, waiting = [], [free], None
    while n:
        met = need.join(_sized(free.withColumnRenamed("rev", "down"), n), "down").groupBy("rev").agg(
            F.count(F.lit(1)).alias("n"), F.max("need").alias("need"), F.max("depth").alias("top")
        )
        if waiting is not None:
            met = met.unionAll(waiting).groupBy("rev").agg(F.sum("n").alias("n"), F.max("need").alias("need"), F.max("top").alias("top"))
        seen = Observation()
        now = settle(met.observe(seen, F.count_if(F.col("n") == F.col("need")).alias("free")))
        n = seen.get["free"]
        free = now.where("n = need").select("rev", (F.col("top") + 1).alias("depth"))
        waiting = now.where("n < need")
        out.append(free)
        tables.append(now)
        if len(out) > MERGE:
            one = settle(reduce(DataFrame.unionAll, out))
            forget(*tables[:-1])
            out, tables = [one], [one, now]
    forget(need)
    return reduce(DataFrame.unionAll, out)


def _peeled(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rev, depth by peeling off what has no parents left; and the links (rev, down) that can't be peeled."""
    links = settle(edges.select("rev", "down").distinct())
    free = nodes.select("rev").distinct().join(links.select("rev").distinct(), "rev", "left_anti")
    out = levels(links, free.withColumn("depth", F.lit(0)))
    return out, links.join(out.select(F.col("rev").alias("down")), "down", "left_anti").select("rev", "down")


def ranks(nodes: DataFrame, edges: DataFrame, check: bool = True) -> DataFrame:
    """rev, depth: the longest path down to a base, by peeling off what has no parents left.

    What can't be peeled lies on or above a cycle: an error, or without ``check`` rows of null depth.
    """
    out, links = _peeled(edges, nodes)
    left = links.select("rev").distinct()
    if check and not left.isEmpty():
        raise CycleError(f"revisions form a cycle, among them {sorted(r[0] for r in left.limit(3).collect())}")
    return out.unionAll(left.withColumn("depth", F.lit(None).cast("int")))


def cycle_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Revisions that are their own ancestor: of what can be peeled from neither end, mostly nothing, the closure tells."""
    left = _peeled(edges, nodes)[1]
    turned = left.select(F.col("down").alias("rev"), F.col("rev").alias("down"))
    core = _peeled(turned, turned.select("rev").union(turned.select("down")))[1]
    return closure(core.select(F.col("down").alias("rev"), F.col("rev").alias("down"))).where("rev = up").select("rev")


def topological(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rev, depth, place: an order in which every revision comes after its ancestors (ties by rev)."""
    return numbered(ranks(nodes, edges), ["depth", "rev"], "place")


def walk(edges: DataFrame, start: DataFrame, steps: int, stay: bool = False) -> DataFrame:
    """Revisions ``steps`` versioned edges above (negative: below) the start.

    A line that ends before is dropped (the empty result below all bases is what is called base), or with ``stay`` left where it ends.
    """
    at = start.select("rev")
    own = versioned(edges).select("rev", "down")
    moves = own.select("rev", F.col("down").alias("next")) if steps < 0 else own.select(F.col("down").alias("rev"), F.col("rev").alias("next"))
    for _ in range(abs(steps)):
        on = at.join(moves, "rev").select(F.col("next").alias("rev"))
        at = (on.union(at.join(moves.select("rev"), "rev", "left_anti")) if stay else on).distinct()
    return at


def matching(nodes: DataFrame, prefix: str) -> DataFrame:
    """Revisions whose id begins with ``prefix``; ids of up to three characters only match whole."""
    return nodes.select("rev").where(
        (F.col("rev") == prefix) | ((F.length("rev") > 3) & F.col("rev").startswith(prefix))
    )


def duplicate_labels(labels: DataFrame) -> DataFrame:
    """Of labels (rev, label): labels given to several revisions, with n."""
    return labels.groupBy("label").agg(F.countDistinct("rev").alias("n")).where("n > 1")


def label_members(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Of labels (rev, label): rev, label for all that a label reaches.

    A label goes to all versioned descendants, and up to ancestors as long as these have one child and
    one parent at most: not past a branch point or a merge point.
    """
    own = versioned(edges)
    down = _reach(own.select(F.col("down").alias("at"), F.col("rev").alias("to")), labels, "label")
    narrow = own.join(branch_points(edges).select(F.col("rev").alias("down")), "down", "left_anti").join(
        merge_points(edges).select("rev"), "rev", "left_anti"
    )
    up = _reach(narrow.select(F.col("rev").alias("at"), F.col("down").alias("to")), labels, "label")
    return down.union(up).select("rev", "label").distinct()


def stamped(edges: DataFrame, current: DataFrame, target: DataFrame) -> DataFrame:
    """The version table's rows after ``target`` (rev) is recorded: heads on its line of descent go, other branches stay."""
    return current.select("rev").join(lineage(edges, target), "rev", "left_anti").union(target.select("rev")).distinct()


def heads_after(edges: DataFrame, current: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """The version table's rows after running ``added`` or undoing ``removed``: heads of what is applied then."""
    applied = ancestors(edges, current)
    if added is not None:
        applied = applied.union(added.select("rev")).distinct()
    if removed is not None:
        applied = applied.join(removed.select("rev"), "rev", "left_anti")
    applied = settle(applied)
    inside = versioned(edges).join(applied, "rev", "left_semi").select(F.col("down").alias("rev")).distinct()
    return applied.join(inside, "rev", "left_anti")
