"""A revision graph that is kept as it grows: heads, bases, depths and labels after new revisions, without building them again.

New revisions follow ones that are there, or one another; what is there never gets new parents. So an insertion joins the tables
that are kept with the new edges only: heads lose those that are followed, depths come from the new revisions' parents, level by level of what
is new, and labels go down to the new revisions. Labels also go up, as long as ancestors have one child and one parent at most;
a revision that gets a second child becomes a branch point, and what had come up to it through the first is taken back along that one
line. The state is tables of the scratch folder, the old ones go when the new ones are written.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import forget, settle, settled
from . import graph


class GraphError(ValueError):
    pass


@dataclass(frozen=True)
class Growing:
    """heads (rev: no versioned child), bases (rev), depths (rev, depth), labels (rev, label, up: come from below), own (rev, label) and edges."""

    heads: DataFrame
    bases: DataFrame
    depths: DataFrame
    labels: DataFrame
    own: DataFrame
    edges: DataFrame

    @staticmethod
    def built(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> Growing:
        """From the whole graph, once."""
        versioned = graph.versioned(edges)
        down = graph._reach(versioned.select(F.col("down").alias("at"), F.col("rev").alias("to")), labels, "label")
        members = graph.label_members(edges, labels).select("rev", "label")
        up = members.join(down.select("rev", "label"), ["rev", "label"], "left_anti")
        both = down.select("rev", "label", F.lit(False).alias("up")).unionAll(up.select("rev", "label", F.lit(True)))
        return Growing(
            settle(graph.heads(nodes, versioned)), settle(graph.bases(nodes, edges)), settle(graph.ranks(nodes, edges)), settle(both.distinct()),
            settle(labels.select("rev", "label").distinct()), settle(edges.select("rev", "down", "kind").distinct()),
        )

    def members(self) -> DataFrame:
        """rev, label as ``graph.label_members`` has them."""
        return self.labels.select("rev", "label").distinct()

    def added(self, nodes: DataFrame, edges: DataFrame, labels: DataFrame | None = None) -> Growing:
        """With new ``nodes`` (rev), their ``edges`` (rev, down, kind) and ``labels`` (rev, label)."""
        nodes, edges = settle(nodes.select("rev").distinct()), settle(edges.select("rev", "down", "kind").distinct())
        labels = settle((labels if labels is not None else nodes.select("rev", F.lit("").alias("label")).where("false")).select("rev", "label").distinct())
        versioned = graph.versioned(edges)
        self._checked(nodes, edges, labels)
        heads = graph.heads(self.heads.unionAll(nodes), versioned)
        bases = self.bases.unionAll(nodes.join(edges.select("rev"), "rev", "left_anti"))
        depths = self.depths.unionAll(self._depths(nodes, edges))
        now = Growing(settle(heads), settle(bases), settle(depths), self._labels(edges, labels), settle(self.own.unionAll(labels)), settle(self.edges.unionAll(edges)))
        forget(self.heads, self.bases, self.depths, self.labels, self.own, self.edges, nodes, edges, labels)
        return now

    def _checked(self, nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> None:
        known = self.depths.select("rev")
        if bad := known.join(nodes, "rev", "left_semi").take(1):
            raise GraphError(f"revision {bad[0][0]} is there already")
        if bad := edges.join(nodes, "rev", "left_anti").take(1):
            raise GraphError(f"revision {bad[0]['rev']} is not new and can't be given parents")
        parents = edges.select(F.col("down").alias("rev")).distinct().join(nodes, "rev", "left_anti")
        if bad := parents.join(known.join(parents, "rev", "left_semi"), "rev", "left_anti").take(1):
            raise GraphError(f"revision {bad[0][0]}, which another refers to, is not there")
        given = labels.groupBy("label").agg(F.countDistinct("rev").alias("n")).where("n > 1").select("label")
        if bad := given.unionAll(self.own.join(labels, "label", "left_semi").select("label")).take(1):
            raise GraphError(f"label {bad[0][0]} is on another revision")

    def _depths(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """Of the new revisions: as they are peeled, each is one above its highest parent."""
        parents = edges.select("rev", "down").distinct()
        old = self.depths.join(parents.select(F.col("down").alias("rev")).distinct(), "rev", "left_semi")
        bare = nodes.join(parents.select("rev"), "rev", "left_anti").select("rev", F.lit(0).alias("depth"))
        found = settle(graph.levels(parents, old.select("rev", "depth").unionAll(bare)))
        if bad := nodes.join(found, "rev", "left_anti").take(1):
            raise graph.CycleError(f"revisions form a cycle, among them {bad[0][0]}")
        return found.join(nodes, "rev", "left_semi").select("rev", "depth")

    def _labels(self, edges: DataFrame, labels: DataFrame) -> DataFrame:
        """Labels after new edges; only lines through the new revisions and their parents are followed."""
        if not labels.take(1) and not self.labels.take(1):
            return settle(self.labels)
        whole = graph.versioned(self.edges.unionAll(edges)).select("rev", "down").distinct()
        new = graph.versioned(edges).select("rev", "down").distinct()
        step = lambda df, at, to: df.select(F.col(at).alias("at"), F.col(to).alias("to"))
        # down: from labelled parents and new labels, over new edges
        near = new.select(F.col("down").alias("rev")).distinct()
        seeds = self.labels.where("not up").join(near, "rev", "left_semi").select("rev", "label").unionAll(labels)
        down = graph._reach(step(new, "down", "rev"), seeds, "label").select("rev", "label")
        # branch points that were none: what had come up to them and from there on is taken back
        children = whole.join(near.withColumnRenamed("rev", "down"), "down", "left_semi").groupBy("down").agg(F.countDistinct("rev").alias("n"))
        turned = settle(children.where("n > 1").select(F.col("down").alias("rev")))
        lost = self.labels.where("up").join(turned, "rev", "left_semi").select("rev", "label")
        had = self.labels.where("up").select(F.col("rev").alias("to"), "label")
        lines = graph.versioned(self.edges).select("rev", "down").distinct()
        gone = _followed(lines, lost, had)
        up = self.labels.where("up").join(gone, ["rev", "label"], "left_anti")
        # up: from new labels, over edges whose ends are no branch point and no merge point
        rising, found = settle(labels.select("rev", "label")), []
        while True:
            over = whole.join(rising, "rev")
            ends = settle(over.select("rev", "down").distinct())
            wide = whole.join(ends.select("down").distinct(), "down", "left_semi").groupBy("down").agg(F.countDistinct("rev").alias("n")).where("n > 1").select("down")
            merged = whole.join(ends.select("rev").distinct(), "rev", "left_semi").groupBy("rev").agg(F.countDistinct("down").alias("n")).where("n > 1").select("rev")
            narrow = over.join(wide, "down", "left_anti").join(merged, "rev", "left_anti")
            rising, n = settled(narrow.select(F.col("down").alias("rev"), "label").distinct())
            if not n:
                break
            found.append(rising)
        parts = [self.labels.where("not up"), down.select("rev", "label", F.lit(False).alias("up")), up, *(f.select("rev", "label", F.lit(True).alias("up")) for f in found)]
        return settle(reduce(DataFrame.unionAll, parts).distinct())


def _followed(lines: DataFrame, seeds: DataFrame, among: DataFrame) -> DataFrame:
    """``seeds`` (rev, label) and what they go up to over ``lines`` while ``among`` (to, label) has it."""
    frontier, n = settled(seeds)
    seen = [frontier]
    while n:
        on = frontier.join(lines, "rev").select(F.col("down").alias("to"), "label")
        frontier, n = settled(on.join(among, ["to", "label"], "left_semi").select(F.col("to").alias("rev"), "label").distinct())
        seen.append(frontier)
    return reduce(DataFrame.unionAll, seen)
