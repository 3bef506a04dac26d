"""Change operations: what to do, its inverse, and its SQL text.

Operations are values; ``sources.catalog`` runs them on a catalog and ``Batch`` folds those on one
table into one ``Rewrite``. ``sql`` spells an operation in the usual words of SQL, for reading; ``plans.script`` makes of
operations and the tables' definitions a script that Spark runs.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from ..spec import Column, Constraint, Identity, Index, Table
from .rewrite import Rewrite, quoted

#: The table property that holds what the session catalog can't, and the end of its text, by which it is found in listings.
PROPERTY, END = "tidemark.objects", '"end": true'


def objects_json(t: Table) -> str:
    stored = {
        "constraints": [asdict(c) for c in t.constraints],
        "indexes": [asdict(i) for i in t.indexes],
        "not_null": [c.name for c in t.columns if not c.nullable],
        "columns": {
            c.name: {
                "type": c.type, "default": c.default, "comment": c.comment, "computed": c.computed, "identity": c.identity and asdict(c.identity),
            }
            for c in t.columns
        },
        "end": True,
    }
    return json.dumps(stored)


class Irreversible(ValueError):
    pass


@dataclass(frozen=True)
class Operation:
    def reverse(self) -> Operation:
        raise Irreversible(f"{type(self).__name__} has no inverse")

    def diff(self) -> tuple:
        return (type(self).__name__,)

    def sql(self) -> list[str]:
        raise NotImplementedError

    def change(self, rewrite: Rewrite) -> Rewrite:
        """Column operations: the same change within a rewrite."""
        raise TypeError(f"{type(self).__name__} is no change of a table's columns")


def _identity_sql(i: Identity) -> str:
    return f"START WITH {i.start} INCREMENT BY {i.step}"


def _plain(c: Column) -> Column:
    """As the session catalog takes it."""
    return replace(c, computed=None, identity=None)


def _column_sql(c: Column) -> str:
    parts = [f"{quoted(c.name)} {c.type}"]
    if not c.nullable:
        parts.append("NOT NULL")
    if c.default is not None:
        parts.append(f"DEFAULT {c.default}")
    if c.computed is not None:
        parts.append(f"GENERATED ALWAYS AS ({c.computed})")
    if c.identity:
        parts.append(f"GENERATED {'ALWAYS' if c.identity.always else 'BY DEFAULT'} AS IDENTITY ({_identity_sql(c.identity)})")
    if c.comment:
        parts.append(f"COMMENT {literal(c.comment)}")
    return " ".join(parts)


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, int | float):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _storage_sql(t: Table) -> str:
    own, listed = t.storage, lambda names: ", ".join(map(quoted, names))
    pairs = lambda items: ", ".join(f"{literal(k)} = {literal(v)}" for k, v in items)
    out = f" USING {own.provider}"
    if own.options:
        out += f" OPTIONS ({pairs(own.options)})"
    if own.partitions:
        out += f" PARTITIONED BY ({listed(own.partitions)})"
    if own.location and own.external:
        out += f" LOCATION {literal(own.location)}"
    if own.buckets:
        number, columns, by = own.buckets
        out += f" CLUSTERED BY ({listed(columns)})" + (f" SORTED BY ({listed(by)})" if by else "") + f" INTO {number} BUCKETS"
    if own.properties:
        out += f" TBLPROPERTIES ({pairs(own.properties)})"
    return out


@dataclass(frozen=True)
class CreateTable(Operation):
    table: Table
    if_not_exists: bool = False

    def reverse(self):
        return DropTable(self.table.key, old=self.table)

    def diff(self):
        return ("add_table", self.table.key)

    def sql(self):
        body = ", ".join(_column_sql(_plain(c)) for c in self.table.columns)
        comment = f" COMMENT {literal(self.table.comment)}" if self.table.comment else ""
        guard = "IF NOT EXISTS " if self.if_not_exists else ""
        return [f"CREATE TABLE {guard}{self.table.key} ({body}){_storage_sql(self.table)}{comment}"]


@dataclass(frozen=True)
class DropTable(Operation):
    """``cascade``: foreign keys of other tables to it go too; without it they keep the table from being dropped."""

    table: str
    if_exists: bool = False
    old: Table | None = None
    cascade: bool = False

    def reverse(self):
        if self.old is None:
            raise Irreversible(f"the definition of {self.table} is not known")
        return CreateTable(self.old)

    def diff(self):
        return ("remove_table", self.table)

    def sql(self):
        return [f"DROP TABLE {'IF EXISTS ' if self.if_exists else ''}{self.table}"]


@dataclass(frozen=True)
class RenameTable(Operation):
    table: str
    new: str

    def reverse(self):
        return RenameTable(self.new, self.table)

    def sql(self):
        return [f"ALTER TABLE {self.table} RENAME TO {self.new}"]


@dataclass(frozen=True)
class AddColumn(Operation):
    table: str
    column: Column
    before: str | None = None
    behind: str | None = None
    fill: str | None = None
    if_not_exists: bool = False

    def reverse(self):
        return DropColumn(self.table, self.column.name, old=self.column, behind=self.behind, fill=self.fill)

    def diff(self):
        return ("add_column", self.table, self.column.name)

    def sql(self):
        return [f"ALTER TABLE {self.table} ADD COLUMN {_column_sql(self.column)}"]

    def change(self, rewrite):
        if self.if_not_exists and rewrite.find(self.column.name):
            return rewrite
        return rewrite.add(self.column, before=self.before, behind=self.behind, fill=self.fill, strict=False)


@dataclass(frozen=True)
class DropColumn(Operation):
    """The inverse puts the column back behind ``behind`` (empty: in front) and gives its rows ``fill``, else the default.

    What the rows held is gone: a column that may not be null and has neither can come back to an empty table only.
    """

    table: str
    name: str
    if_exists: bool = False
    old: Column | None = None
    behind: str | None = None
    fill: str | None = None

    def reverse(self):
        if self.old is None:
            raise Irreversible(f"the definition of {self.table}.{self.name} is not known")
        return AddColumn(self.table, self.old, behind=self.behind, fill=self.fill)

    def diff(self):
        return ("remove_column", self.table, self.name)

    def sql(self):
        return [f"ALTER TABLE {self.table} DROP COLUMN {quoted(self.name)}"]

    def change(self, rewrite):
        if self.if_exists and not rewrite.find(self.name):
            return rewrite
        return rewrite.drop(self.name)


@dataclass(frozen=True)
class AlterColumn(Operation):
    """Each attribute that is not None (default, comment, identity: not ...) changes; renaming comes last."""

    table: str
    name: str
    nullable: bool | None = None
    default: object = ...
    type: str | None = None
    comment: object = ...
    new_name: str | None = None
    using: str | None = None
    mode: str = "strict"
    fill: str | None = None
    old: Column | None = None
    identity: object = ...

    def reverse(self):
        if self.old is None:
            raise Irreversible(f"the definition of {self.table}.{self.name} is not known")
        o = self.old
        return AlterColumn(
            self.table, self.new_name or self.name,
            nullable=None if self.nullable is None else o.nullable,
            default=... if self.default is ... else o.default,
            type=None if self.type is None else o.type,
            comment=... if self.comment is ... else o.comment,
            new_name=self.name if self.new_name else None,
            identity=... if self.identity is ... else o.identity,
            old=replace(
                o, name=self.new_name or self.name, type=self.type or o.type,
                nullable=o.nullable if self.nullable is None else self.nullable,
                default=o.default if self.default is ... else self.default,
                comment=o.comment if self.comment is ... else self.comment,
                identity=o.identity if self.identity is ... else self.identity,
            ),
        )

    def diff(self):
        kinds = [
            ("modify_nullable", self.nullable is not None), ("modify_default", self.default is not ... or self.identity is not ...),
            ("modify_type", self.type is not None), ("modify_comment", self.comment is not ...),
            ("modify_name", self.new_name is not None),
        ]
        return tuple((k, self.table, self.name) for k, on in kinds if on)

    def sql(self):
        head, out = f"ALTER TABLE {self.table} ALTER COLUMN {quoted(self.name)}", []
        if self.nullable is not None:
            out.append(f"{head} {'DROP' if self.nullable else 'SET'} NOT NULL")
        if self.default is not ...:
            out.append(f"{head} " + ("DROP DEFAULT" if self.default is None else f"SET DEFAULT {self.default}"))
        if self.type is not None:
            out.append(f"{head} TYPE {self.type}")
        if self.comment is not ...:
            out.append(f"{head} COMMENT {literal(self.comment or '')}")
        if self.identity is not ...:
            out.append(f"{head} " + (f"ADD GENERATED AS IDENTITY ({_identity_sql(self.identity)})" if self.identity else "DROP IDENTITY"))
        if self.new_name:
            out.append(f"ALTER TABLE {self.table} RENAME COLUMN {quoted(self.name)} TO {quoted(self.new_name)}")
        return out

    def change(self, rewrite):
        if self.type is not None:
            rewrite.retype(self.name, self.type, using=self.using, mode=self.mode)
        rewrite.alter(self.name, nullable=self.nullable, default=self.default, comment=self.comment, fill=self.fill)
        return rewrite.rename(self.name, self.new_name) if self.new_name else rewrite


@dataclass(frozen=True)
class AddConstraint(Operation):
    table: str
    constraint: Constraint

    def reverse(self):
        return DropConstraint(self.table, self.constraint.name, old=self.constraint)

    def diff(self):
        return ("add_fk" if self.constraint.kind == "foreign" else "add_constraint", self.table, self.constraint.name)

    def sql(self):
        c = self.constraint
        own = ", ".join(c.columns)
        if c.kind == "foreign":
            body = f"FOREIGN KEY ({own}) REFERENCES {c.refers[0]} ({', '.join(c.refers[1])})"
            body += "".join(f" {k} {v}" for k, v in c.options)
        elif c.kind == "check":
            body = f"CHECK ({c.condition})"
        elif c.kind == "exclude":
            body = f"EXCLUDE ({', '.join(f'{e} WITH {o}' for e, o in c.elements)})" + (f" WHERE ({c.where})" if c.where else "")
        else:
            body = f"{'PRIMARY KEY' if c.kind == 'primary' else 'UNIQUE'} ({own})"
        return [f"ALTER TABLE {self.table} ADD CONSTRAINT {c.name} {body}"]


def primary_key(name, table, columns):
    return AddConstraint(table, Constraint(name, "primary", tuple(columns)))


def unique(name, table, columns):
    return AddConstraint(table, Constraint(name, "unique", tuple(columns)))


def foreign_key(name, table, parent, columns, parent_columns, **options):
    spelled = tuple((k.replace("_", " ").upper(), str(v)) for k, v in options.items())
    return AddConstraint(table, Constraint(name, "foreign", tuple(columns), (parent, tuple(parent_columns)), options=spelled))


def check(name, table, condition):
    return AddConstraint(table, Constraint(name, "check", condition=condition))


def exclude(name, table, key, *elements, where=None):
    return AddConstraint(table, Constraint(name, "exclude", (key,), elements=tuple(elements), where=where))


@dataclass(frozen=True)
class DropConstraint(Operation):
    """``kind``, if given, has to be that of the constraint."""

    table: str
    name: str
    if_exists: bool = False
    old: Constraint | None = None
    kind: str | None = None

    def reverse(self):
        if self.old is None:
            raise Irreversible(f"the definition of constraint {self.name} is not known")
        return AddConstraint(self.table, self.old)

    def diff(self):
        return ("remove_fk" if self.old and self.old.kind == "foreign" else "remove_constraint", self.table, self.name)

    def sql(self):
        return [f"ALTER TABLE {self.table} DROP CONSTRAINT {'IF EXISTS ' if self.if_exists else ''}{self.name}"]


@dataclass(frozen=True)
class CreateIndex(Operation):
    table: str
    index: Index
    if_not_exists: bool = False

    def reverse(self):
        return DropIndex(self.table, self.index.name, old=self.index)

    def diff(self):
        return ("add_index", self.table, self.index.name)

    def sql(self):
        kind = "UNIQUE INDEX" if self.index.unique else "INDEX"
        return [f"CREATE {kind} {'IF NOT EXISTS ' if self.if_not_exists else ''}{self.index.name} ON {self.table} ({', '.join(self.index.columns)})"]


@dataclass(frozen=True)
class DropIndex(Operation):
    table: str
    name: str
    if_exists: bool = False
    old: Index | None = None

    def reverse(self):
        if self.old is None:
            raise Irreversible(f"the definition of index {self.name} is not known")
        return CreateIndex(self.table, self.old)

    def diff(self):
        return ("remove_index", self.table, self.name)

    def sql(self):
        return [f"DROP INDEX {'IF EXISTS ' if self.if_exists else ''}{self.name}"]


@dataclass(frozen=True)
class TableComment(Operation):
    """``comment`` None drops it."""

    table: str
    comment: str | None
    old: str | None = None

    def reverse(self):
        return TableComment(self.table, self.old, self.comment)

    def diff(self):
        return ("remove_table_comment" if self.comment is None else "add_table_comment", self.table)

    def sql(self):
        return [f"COMMENT ON TABLE {self.table} IS {literal(self.comment)}"]


@dataclass(frozen=True)
class BulkInsert(Operation):
    """``rows`` are dicts; what a row leaves out takes the column's default. No rows: nothing to do."""

    table: Table
    rows: tuple[dict, ...]

    def sql(self):
        names = [c.name for c in self.table.columns]
        return [
            f"INSERT INTO {self.table.key} ({', '.join(n for n in names if n in r)}) "
            f"VALUES ({', '.join(literal(r[n]) for n in names if n in r)})"
            for r in self.rows
        ]


@dataclass(frozen=True)
class Execute(Operation):
    statement: str

    def diff(self):
        return ("execute", self.statement)

    def sql(self):
        return [self.statement]


@dataclass(frozen=True)
class Batch(Operation):
    """Changes of one table's columns (and constraints), done together in one rewrite.

    ``order``: the columns before, which the inverse puts back in that order. ``recreate``: "auto" (rows are written again if a
    change needs it), "always", or "never" (an error if one needs it).
    """

    table: str
    changes: tuple[Operation, ...]
    reordering: tuple[tuple[str, ...], ...] = field(default=())
    order: tuple[str, ...] = ()
    recreate: str = "auto"

    def reverse(self):
        return Batch(self.table, tuple(c.reverse() for c in reversed(self.changes)), (self.order,) if self.order else ())

    def diff(self):
        return tuple(c.diff() for c in self.changes)

    def sql(self):
        return [s for c in self.changes for s in c.sql()]

    def change(self, rewrite):
        for c in self.changes:
            if not isinstance(c, AddConstraint | DropConstraint | CreateIndex | DropIndex | TableComment):
                rewrite = c.change(rewrite)
        for names in self.reordering:
            rewrite.reorder(*names)
        return rewrite


def conventional(t: Table, convention: dict[str, str]) -> Table:
    """``t`` with names for constraints and indexes that have none, by kind: a pattern of {table}, {columns} and {parent}."""
    def named(x, kind, columns, parent=""):
        if x.name or kind not in convention:
            return x
        return replace(x, name=convention[kind].format(table=t.name, columns="_".join(columns), parent=parent))

    return replace(
        t, constraints=tuple(named(c, c.kind, c.columns, c.refers[0] if c.refers else "") for c in t.constraints),
        indexes=tuple(named(i, "index", i.columns) for i in t.indexes),
    )


def spelled(operations) -> str:
    """The operations' SQL, a statement a line, in the usual words, for reading: Spark's catalog has no constraints and can't alter all this in place."""
    return "".join(f"{s};\n" for o in operations for s in o.sql())


def reversed_all(operations) -> list[Operation]:
    return [o.reverse() for o in reversed(list(operations))]
