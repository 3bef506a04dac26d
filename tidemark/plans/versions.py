"""Revisions as a plan: targets, what to run in which order, and the table of applied heads.

The graph of revisions is small control data and is planned on the driver, in the order that a user
expects (branches stay together); ``plans.graph`` answers the same questions for graphs as DataFrames.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..functions.casts import check_revision_id
from ..sources.files import Busy, Files, Journal


class RevisionError(ValueError):
    pass


class RangeError(RevisionError):
    """The ends of a range are on no line of descent."""


class CycleError(RevisionError):
    """Revisions are their own ancestors."""


class DependencyCycleError(CycleError):
    """They are so by their dependencies only."""


class LoopError(RevisionError):
    """A revision names itself as what it follows."""


class DependencyLoopError(LoopError):
    """A revision names itself as what it depends on."""


@dataclass(frozen=True)
class Revision:
    rev: str
    down: tuple[str, ...] = ()
    depends: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    upgrade: Callable | None = field(default=None, compare=False)
    downgrade: Callable | None = field(default=None, compare=False)

    def __post_init__(self):
        check_revision_id(self.rev)
        if self.rev in self.down:
            raise LoopError(f"revision {self.rev} follows itself")
        if self.rev in self.depends:
            raise DependencyLoopError(f"revision {self.rev} depends on itself")


class History:
    def __init__(self, revisions: Iterable[Revision]):
        self.revisions: dict[str, Revision] = {}
        for r in revisions:
            if r.rev in self.revisions:
                raise RevisionError(f"revision {r.rev} is there more than once")
            self.revisions[r.rev] = r
        labelled: dict[str, str] = {}
        for r in self.revisions.values():
            for label in r.labels:
                if label in labelled:
                    raise RevisionError(f"label {label} is on {labelled[label]} and on {r.rev}")
                labelled[label] = r.rev
        self.labelled = labelled
        self.parents = {
            r.rev: list(dict.fromkeys([*r.down, *(labelled.get(d, d) for d in r.depends)])) for r in self.revisions.values()
        }
        self.children: dict[str, list[str]] = {r: [] for r in self.revisions}
        for r, parents in self.parents.items():
            for p in parents:
                if p not in self.revisions:
                    raise RevisionError(f"revision {p}, which {r} refers to, is not there")
                self.children[p].append(r)
        if len(self.order(self.revisions)) < len(self.revisions):
            whole = self.parents
            self.parents = {r.rev: list(r.down) for r in self.revisions.values()}
            plain = len(self.order(self.revisions)) == len(self.revisions)
            self.parents = whole
            left = sorted(set(self.revisions) - set(self.order(self.revisions)))
            raise (DependencyCycleError if plain else CycleError)(f"revisions form a cycle, among {', '.join(left[:5])}")

    def added(self, revision: Revision, *, instead: bool = False) -> History:
        """With one more revision, or, if ``instead``, with this one for the one of its id."""
        if instead:
            return History([revision if r.rev == revision.rev else r for r in self.revisions.values()])
        return History([*self.revisions.values(), revision])

    def heads(self) -> list[str]:
        below = {d for r in self.revisions.values() for d in r.down}
        return [r for r in self.revisions if r not in below]

    def bases(self) -> list[str]:
        return [r.rev for r in self.revisions.values() if not r.down]

    def ancestors(self, revs: Iterable[str]) -> set[str]:
        todo, seen = list(revs), set()
        while todo:
            r = todo.pop()
            if r not in seen:
                seen.add(r)
                todo += self.parents[r]
        return seen

    def descendants(self, revs: Iterable[str]) -> set[str]:
        todo, seen = list(revs), set()
        while todo:
            r = todo.pop()
            if r not in seen:
                seen.add(r)
                todo += self.children[r]
        return seen

    def order(self, revs: Iterable[str]) -> list[str]:
        """Descendants before ancestors, a branch followed down as long as nothing else needs its next revision."""
        inside = set(revs)
        waiting = {r: 0 for r in self.revisions if r in inside}
        for r in waiting:
            for p in self.parents[r]:
                if p in waiting:
                    waiting[p] += 1
        ready = [r for r in reversed(list(waiting)) if not waiting[r]]
        out = []
        while ready:
            r = ready.pop()
            out.append(r)
            for p in reversed(self.parents[r]):
                if p in waiting:
                    waiting[p] -= 1
                    if not waiting[p]:
                        ready.append(p)
        return out

    def on_branch(self, label: str) -> set[str]:
        root = self.labelled.get(label) or self.find(label)
        return self.descendants([root]) | self.ancestors([root])

    def find(self, name: str) -> str:
        """A revision by id, label, or beginning of its id (ids over three characters)."""
        if name in self.revisions:
            return name
        if name in self.labelled:
            return self.labelled[name]
        found = [r for r in self.revisions if len(r) > 3 and r.startswith(name)]
        if len(found) != 1:
            raise RevisionError(f"{name} is {'no revision' if not found else 'ambiguous: ' + ', '.join(found[:3])}")
        return found[0]

    def get(self, *names: str) -> list[Revision]:
        """Revisions by what ``resolve`` understands; an error where a name stands for several heads."""
        out = []
        for name in names:
            found = self.resolve(name)
            if len(found) > 1 and name.rpartition("@")[2] != "heads":
                raise RevisionError(f"{name} is ambiguous: {', '.join(found)}")
            out += [self.revisions[r] for r in found]
        return out

    def current_head(self) -> str | None:
        """The only head, None of no revisions; an error if there are several."""
        found = self.heads()
        if len(found) > 1:
            raise RevisionError(f"several heads: {', '.join(found)}")
        return found[0] if found else None

    def walk(self, start: str, steps: int, label: str | None = None, stay: bool = False) -> str | None:
        """The revision so many steps above (negative: below) ``start``, on a label's branch if one is given; "base" below the bases.

        Above the heads: None, or with ``stay`` the last one. An error where the way parts.
        """
        branch = self.on_branch(label) if label else set(self.revisions)
        at = self.find(start)
        for _ in range(abs(steps)):
            own = self.revisions[at].down if steps < 0 else [r for r in self.children[at] if at in self.revisions[r].down]
            on = [r for r in dict.fromkeys(own) if r in branch]
            if len(on) > 1:
                raise RevisionError(f"ambiguous step: {', '.join(on)}")
            if not on:
                return "base" if steps < 0 else at if stay else None
            at = on[0]
        return at

    def resolve(self, target: str, current: Iterable[str] = ()) -> list[str]:
        """Revisions of ``[label@](base|head|heads|id|label)[±n]``, or ``[label@]±n`` from the current heads."""
        label, at, rest = target.rpartition("@")
        name, steps = re.fullmatch(r"(.*?)([+-]\d+)?", rest).groups()
        branch = self.on_branch(label) if at else set(self.revisions)
        if name == "base":
            found = []
        elif name in ("head", "heads"):
            found = [r for r in self.heads() if r in branch]
            if name == "head" and len(found) > 1:
                raise RevisionError(f"several heads: {', '.join(found)}")
        elif name:
            found = [self.find(name)]
            if at and found[0] not in branch:
                raise RevisionError(f"{name} is not on branch {label}")
        elif steps:
            found = [r for r in current if r in branch]
            if not found and int(steps) < 0:
                raise RevisionError("nothing to go down from")
        else:
            raise RevisionError("no target")
        for _ in range(abs(int(steps or 0))):
            found = self._next(found, int(steps) > 0, branch)
        return found

    def _next(self, found: list[str], up: bool, branch: set[str]) -> list[str]:
        if up:
            steps = [r for r in self.revisions if r in branch and (set(self.revisions[r].down) & set(found) or not found and not self.revisions[r].down)]
            if not steps:
                raise RevisionError("no revision that far up")
        else:
            if not found:
                raise RevisionError("no revision that far down")
            steps = list(dict.fromkeys(d for r in found for d in self.revisions[r].down if d in branch))
        if len(steps) > 1:
            raise RevisionError(f"ambiguous step: {', '.join(steps)}")
        return steps

    def lineage(self, revs: Iterable[str]) -> set[str]:
        revs = list(revs)
        return self.ancestors(revs) | self.descendants(revs)

    def between(self, upper: str, lower: str, *, inclusive: bool = False, implicit_base: bool = False) -> list[str]:
        """Revisions above ``lower`` up to ``upper``, descendants first; an error if ``lower`` is no ancestor of ``upper``.

        ``implicit_base``: other branches that ``upper`` needs too, from their bases on; nothing is an error then.
        """
        top, bottom = self.resolve(upper), self.resolve(lower)
        want = self.ancestors(top)
        if not implicit_base and (lost := [r for r in bottom if r not in want]):
            raise RangeError(f"{lost[0]} is no ancestor of {upper}")
        have = self.ancestors(bottom)
        if bottom and not implicit_base:
            want &= self.descendants(bottom)
        return self.order((want - have) | (set(bottom) if inclusive else set()))

    def stamped(self, current: Iterable[str], target: str) -> list[str]:
        """The heads after ``target`` is recorded: it stands for those on its line of descent, other branches stay."""
        current = list(current)
        to = self.resolve(target, current)
        label, at, _ = target.rpartition("@")
        if to:
            near = self.lineage(to)
        else:
            near = self.on_branch(label) if at else set(self.revisions)
        stay = [r for r in current if r not in near]
        return stay + [r for r in to if not (self.descendants([r]) - {r}) & set(to)]

    def upgrade(self, current: Iterable[str], target: str) -> list[str]:
        """What to run, in order."""
        current = list(current)
        want = self.ancestors(self.resolve(target, current)) - self.ancestors(current)
        return self.order(want)[::-1]

    def downgrade(self, current: Iterable[str], target: str) -> list[str]:
        """What to undo, in order."""
        current = list(current)
        applied = self.ancestors(current)
        to = self.resolve(target, current)
        label, at, _ = target.rpartition("@")
        if to:
            gone = (self.descendants(to) - set(to)) & applied
            if not gone and not set(to) & set(current):
                raise RangeError(f"{target} is no ancestor of what is applied")
        else:
            gone = applied & (self.on_branch(label) if at else applied)
            gone = self.descendants(gone) & applied if at else gone
        return self.order(gone)

    def heads_after(self, current: Iterable[str], run: Iterable[str] = (), undone: Iterable[str] = ()) -> list[str]:
        applied = (self.ancestors(current) | set(run)) - set(undone)
        below = {d for r in applied for d in self.revisions[r].down}
        return [r for r in self.revisions if r in applied and r not in below]

    def frames(self, spark: SparkSession):
        """nodes and edges for ``plans.graph``."""
        nodes = spark.createDataFrame([(r,) for r in self.revisions], "rev string")
        edges = [(r.rev, d, "down") for r in self.revisions.values() for d in r.down]
        edges += [(r.rev, self.labelled.get(d, d), "dep") for r in self.revisions.values() for d in r.depends]
        return nodes, spark.createDataFrame(edges, "rev string, down string, kind string")


class VersionTable:
    """The applied heads, one row each, in a table of the session catalog.

    What counts are the states behind it: small files numbered from 1, each created exclusively. Who writes a state has to have read the
    one before; of two that have read the same one writes the next, and the other gets an error before its step is recorded. The
    table shows the last state.
    """

    def __init__(self, spark: SparkSession, name: str = "tidemark_version"):
        self.spark, self.name = spark, name
        self._files = Files(spark)
        self._folder = f"{Journal(spark, name.rpartition('.')[0] or None).folder}/versions/{name.rpartition('.')[2].lower()}"

    def ensure(self, purge: bool = False) -> None:
        """Make the table if it is not there; ``purge``: and record that nothing is applied."""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (version_num STRING) USING parquet")
        if purge:
            self.write([], self.heads())

    def state(self) -> tuple[int, list[str]]:
        """The last state's number and heads; 0 and what the table holds, if no state was written yet."""
        numbers = [int(n.removesuffix(".json")) for n in self._files.names(self._folder) if re.fullmatch(r"\d+\.json", n)]
        if numbers:
            return max(numbers), json.loads(self._files.read(f"{self._folder}/{max(numbers)}.json"))
        there = self.spark.catalog.tableExists(self.name)
        return 0, sorted(r[0] for r in self.spark.table(self.name).collect()) if there else []  # a few heads

    def heads(self) -> list[str]:
        return self.state()[1]

    def write(self, heads: Iterable[str], expected: Iterable[str], after: int | None = None) -> int:
        """``heads`` instead of what is there, if that is as ``expected`` (and still the state of number ``after``). The new state's number."""
        self.ensure()
        number, there = self.state()
        if there != sorted(expected) or after not in (None, number):
            raise RevisionError(f"the version table holds {there}, not {sorted(expected)}: another migration has written it")
        heads = sorted(heads)
        try:
            self._files.write_new(f"{self._folder}/{number + 1}.json", json.dumps(heads))
        except Busy as e:
            raise RevisionError(f"another migration has written the state after {there}") from e
        self._show()
        return number + 1

    def _show(self) -> None:
        """The last state in the table; again if another one has come meanwhile."""
        while True:
            number, heads = self.state()
            rows = self.spark.createDataFrame([(h,) for h in heads], "version_num string")
            try:
                rows.coalesce(1).write.insertInto(self.name, overwrite=True)
            except Exception:  # who has written the next state may be writing the table too
                if self.state()[0] == number:
                    raise
            if self.state()[0] == number:
                return

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self._files.delete(self._folder)


class Migrator:
    """Runs revisions against a database and records each step."""

    def __init__(self, spark: SparkSession, history: History, versions: VersionTable | None = None):
        self.history, self.versions = history, versions or VersionTable(spark)

    def _step(self, rev: str, up: bool, database) -> None:
        number, current = self.versions.state()
        own = self.history.revisions[rev]
        work = own.upgrade if up else own.downgrade
        if work is not None and database is not None:
            work(database)
        after = self.history.heads_after(current, [rev] if up else [], [] if up else [rev])
        self.versions.write(after, current, number)

    def upgrade(self, target: str, database=None) -> list[str]:
        run = self.history.upgrade(self.versions.heads(), target)
        for rev in run:
            self._step(rev, True, database)
        return run

    def downgrade(self, target: str, database=None) -> list[str]:
        undo = self.history.downgrade(self.versions.heads(), target)
        for rev in undo:
            self._step(rev, False, database)
        return undo

    def stamp(self, target: str) -> None:
        """Record revisions as applied without running them; heads of other branches stay."""
        current = self.versions.heads()
        self.versions.write(self.history.stamped(current, target), current)
