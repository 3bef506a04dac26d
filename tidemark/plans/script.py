"""Operations as a script that Spark runs, statement by statement, without this library.

Nothing is read: the definitions of the tables that are written again have to be given, and are followed from one operation to
the next. What the session catalog can't do in place is a move-and-copy: CREATE the staging table, INSERT ... SELECT, assertions of what
the constraints demand of the new rows, RENAME, DROP. Constraints and indexes are kept as the property that the catalog
reads them from.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from ..operators import ops
from ..operators.rewrite import Rewrite, quoted
from ..operators.writes import demands, keys_of, uses
from ..sources.catalog import Database, carried, followed
from ..sources.changes import SUFFIXES
from ..spec import Constraint, Table


def statements(operations: Iterable[ops.Operation], tables: Iterable[Table] = ()) -> list[str]:
    """SQL statements, in order. ``tables``: the definitions as they are before."""
    known, out = {t.key.lower(): t for t in tables}, []
    for o in operations:
        out += _Script(known).of(o)
    return out


def script(operations: Iterable[ops.Operation], tables: Iterable[Table] = ()) -> str:
    return "".join(f"{s};\n" for s in statements(operations, tables))


class _Script:
    def __init__(self, known: dict[str, Table]):
        self.known = known

    def of(self, o: ops.Operation) -> list[str]:
        if isinstance(o, ops.CreateTable):
            self.known[o.table.key.lower()] = o.table
            return [*o.sql(), *self._objects(o.table, Table(o.table.name, ()))]
        if isinstance(o, ops.DropTable):
            self.known.pop(o.table.lower(), None)
            return o.sql()
        if isinstance(o, ops.RenameTable):
            out = o.sql()
            if t := self.known.pop(o.table.lower(), None):
                self.known[o.new.lower()] = replace(t, name=o.new, schema=None)
            return out + self._follow(o.table, o.new, {})
        if isinstance(o, ops.BulkInsert | ops.Execute | ops.TableComment):
            return o.sql()
        if isinstance(o, ops.Batch):
            return self._batch(o)
        return self._batch(ops.Batch(o.table, (o,)))

    def _table(self, name: str) -> Table:
        if name.lower() not in self.known:
            raise ValueError(f"a script that changes {name} needs its definition")
        return self.known[name.lower()]

    def _objects(self, t: Table, before: Table) -> list[str]:
        text = ops.objects_json(t)
        if text == ops.objects_json(before):
            return []
        return [f"ALTER TABLE {t.key} SET TBLPROPERTIES ({ops.literal(ops.PROPERTY)} = {ops.literal(text)})"]

    def _follow(self, old: str, new: str, names: dict[str, str]) -> list[str]:
        out, low = [], {k.lower(): v for k, v in names.items()}
        for key, t in list(self.known.items()):
            own = lambda c: c.refers and c.refers[0].lower() == old.lower()
            after = replace(t, constraints=tuple(
                replace(c, refers=(new, tuple(low.get(x.lower(), x) for x in c.refers[1]))) if own(c) else c for c in t.constraints
            ))
            out += self._objects(after, t)
            self.known[key] = after
        return out

    def _batch(self, o: ops.Batch) -> list[str]:
        if all(isinstance(c, ops.AddColumn) for c in o.changes) and o.table.lower() not in self.known and Database._native(o, None):
            return [s for c in o.changes for s in c.sql()]
        old = self._table(o.table)
        rewrite = o.change(Rewrite(old))
        names = followed(old, o)
        new = carried(old, o, rewrite.result(), names)
        if o.recreate != "always" and Database._native(o, old):
            plain = [replace(c, nullable=None, identity=...) if isinstance(c, ops.AlterColumn) else c for c in o.changes]
            own = [s for c in plain if isinstance(c, ops.AddColumn | ops.AlterColumn | ops.TableComment) for s in c.sql()]
            self.known[o.table.lower()] = new
            come = {c.constraint.name for c in o.changes if isinstance(c, ops.AddConstraint)}
            strict = {c.name for c in o.changes if isinstance(c, ops.AlterColumn) and c.nullable is False}
            return self._asserted(new, o.table, come, set(), strict) + own + self._objects(new, old)
        if o.recreate == "never":
            raise ValueError(f"{o.table} can't be changed so without writing its rows again")
        if any(isinstance(c, ops.AddColumn) and c.column.identity for c in o.changes):
            raise ValueError(f"{o.table}: the numbers of a new identity column depend on the rows, which a script doesn't read")
        key, staging, aside = old.key, old.key + SUFFIXES[0], old.key + SUFFIXES[1]
        external = old.storage.external
        copy = replace(new, name=staging, schema=None, storage=replace(new.storage, location=None, external=False))
        parts = {p.lower() for p in new.storage.partitions}
        places = [c.name for c in new.columns if c.name.lower() not in parts] + [c.name for c in new.columns if c.name.lower() in parts]
        come = {x.constraint.name for x in o.changes if isinstance(x, ops.AddConstraint)}
        come |= {x.index.name for x in o.changes if isinstance(x, ops.CreateIndex)}
        listed = ", ".join(map(quoted, places))
        out = [*ops.CreateTable(copy).sql(), f"INSERT INTO {staging} ({listed}) SELECT {listed} FROM ({rewrite.sql(key)})"]
        out += self._asserted(new, staging, come, rewrite.fresh(), {c.name for c in new.columns if not c.nullable})
        if external:
            final = replace(new, name=key, schema=None)
            out += [f"DROP TABLE {key}", *ops.CreateTable(final).sql(), f"INSERT OVERWRITE TABLE {key} SELECT {listed} FROM {staging}", f"DROP TABLE {staging}"]
        else:
            out += [f"ALTER TABLE {key} RENAME TO {aside}", f"ALTER TABLE {staging} RENAME TO {key}", f"DROP TABLE {aside}"]
        self.known[key.lower()] = new
        return out + self._objects(new, Table(key, ())) + self._follow(key, key, names)

    def _asserted(self, t: Table, rows: str, come: set[str], fresh: set[str], strict: set[str]) -> list[str]:
        """Statements that fail if ``rows`` break what is new or depends on ``fresh`` columns; exclusions have none."""
        asked = [(f"{t.key} violates {c.name}", _broken(c, t, rows)) for c in demands(t) if c.name in come or uses(c, t) & fresh]
        asked += [(f"{t.key}.{n} may not be null", f"SELECT 1 FROM {rows} WHERE {quoted(n)} IS NULL") for n in sorted(strict)]
        return [f"SELECT assert_true(count(*) = 0, {ops.literal(m)}) FROM ({q})" for m, q in asked if q]


def _broken(c: Constraint, t: Table, rows: str) -> str | None:
    """A query of what breaks a constraint."""
    if c.kind == "check":
        return f"SELECT 1 FROM {rows} WHERE NOT ({c.condition})"
    if c.kind in ("primary", "unique"):
        keys = keys_of(c)
        nulls = " OR ".join(f"{k} IS NULL" for k in keys)
        twice = f"SELECT 1 FROM {rows} WHERE NOT ({nulls}) GROUP BY {', '.join(keys)} HAVING count(*) > 1"
        return twice if c.kind == "unique" else f"{twice} UNION ALL SELECT 1 FROM {rows} WHERE {nulls}"
    if c.kind == "foreign":
        parent = rows if c.refers[0].lower() == t.key.lower() else c.refers[0]
        same = " AND ".join(f"c.{quoted(a)} = p.{quoted(b)}" for a, b in zip(c.columns, c.refers[1]))
        whole = " AND ".join(f"c.{quoted(a)} IS NOT NULL" for a in c.columns)
        return f"SELECT 1 FROM (SELECT * FROM {rows} c WHERE {whole}) c LEFT ANTI JOIN {parent} p ON {same}"
    return None
