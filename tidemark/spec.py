"""Declared tables: columns, constraints and indexes, and their relation to Spark schemas."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


#: Table property of an identity column: the next number.
NEXT = "tidemark.next."


@dataclass(frozen=True)
class Identity:
    """Numbers that rows get where none is given; ``always``: none may be given. ``order``: SQL by which rows that are there are numbered."""

    start: int = 1
    step: int = 1
    always: bool = False
    order: str | None = None


@dataclass(frozen=True)
class Column:
    """``default`` is a SQL expression text; ``type`` a Spark type string; ``computed`` SQL over the other columns."""

    name: str
    type: str
    nullable: bool = True
    default: str | None = None
    comment: str | None = None
    computed: str | None = None
    identity: Identity | None = None

    def field(self) -> StructField:
        meta = {}
        if self.comment:
            meta["comment"] = self.comment
        if self.default is not None:
            meta |= {"CURRENT_DEFAULT": self.default, "EXISTS_DEFAULT": self.default}
        return StructField(self.name, _parse_datatype_string(self.type), self.nullable, meta)

    @staticmethod
    def of(f: StructField) -> Column:
        kind = f.metadata.get("__CHAR_VARCHAR_TYPE_STRING", f.dataType.simpleString())
        return Column(f.name, kind, f.nullable, f.metadata.get("CURRENT_DEFAULT"), f.metadata.get("comment") or None)


@dataclass(frozen=True)
class Constraint:
    """kind: primary, unique, foreign, check, exclude.

    primary, unique: ``columns``, or ``elements`` with "=" for expressions. foreign: ``refers`` is (table, columns). check: ``condition`` is SQL. exclude: ``elements`` are
    (expression, operator) pairs, operators "=" or "&&" (an interval: expression is "low,high") or
    "~n" (numbers closer than n).
    """

    name: str
    kind: str
    columns: tuple[str, ...] = ()
    refers: tuple[str, tuple[str, ...]] | None = None
    condition: str | None = None
    elements: tuple[tuple[str, str], ...] = ()
    where: str | None = None
    options: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Index:
    """``columns`` are names, or SQL expressions over the columns."""

    name: str
    columns: tuple[str, ...]
    unique: bool = False

    def constraint(self, t: Table) -> Constraint:
        """What a unique index demands of ``t``."""
        names = {c.name.lower() for c in t.columns}
        return Constraint(self.name, "unique", elements=tuple(("`" + c.replace("`", "``") + "`" if c.lower() in names else c, "=") for c in self.columns))


@dataclass(frozen=True)
class Storage:
    """How a table's rows lie on disk; ``buckets`` is their number, columns and sort columns.

    An ``external`` table's rows stay at ``location`` when it is dropped; of other tables the catalog chooses the place.
    """

    provider: str = "parquet"
    partitions: tuple[str, ...] = ()
    buckets: tuple[int, tuple[str, ...], tuple[str, ...]] | None = None
    options: tuple[tuple[str, str], ...] = ()
    properties: tuple[tuple[str, str], ...] = ()
    location: str | None = None
    external: bool = False

    def following(self, names) -> Storage:
        """With columns called by their new names (``names``: old to new); columns that are not in it go."""
        low = {k.lower(): v for k, v in names.items()}
        kept = lambda columns: tuple(low[c.lower()] for c in columns if c.lower() in low)
        buckets = self.buckets and (self.buckets[0], kept(self.buckets[1]), kept(self.buckets[2]))
        whole = buckets and len(buckets[1]) == len(self.buckets[1])
        marks = {f"{NEXT}{k}": f"{NEXT}{v}" for k, v in names.items()}
        properties = tuple((marks.get(k, k), v) for k, v in self.properties if not k.startswith(NEXT) or k in marks)
        return replace(self, partitions=kept(self.partitions), buckets=buckets if whole else None, properties=properties)


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    constraints: tuple[Constraint, ...] = ()
    indexes: tuple[Index, ...] = ()
    comment: str | None = None
    schema: str | None = None
    storage: Storage = field(default=Storage(), compare=False)

    @property
    def key(self) -> str:
        return f"{self.schema}.{self.name}" if self.schema else self.name

    def struct(self) -> StructType:
        return StructType([c.field() for c in self.columns])

    def column(self, name: str) -> Column:
        """Names are found without case, as Spark does."""
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise KeyError(f"table {self.name} has no column {name}")

    def with_columns(self, columns) -> Table:
        return replace(self, columns=tuple(columns))

    @staticmethod
    def of(name: str, df: DataFrame, **more) -> Table:
        return Table(name, tuple(Column.of(f) for f in df.schema.fields), **more)


@dataclass(frozen=True)
class Catalog:
    """A set of tables; equal keys in what is merged are an error."""

    tables: tuple[Table, ...] = field(default=())

    def __post_init__(self):
        keys = [t.key for t in self.tables]
        twice = sorted({k for k in keys if keys.count(k) > 1})
        if twice:
            raise ValueError(f"declared more than once: {', '.join(twice)}")

    def merged(self, *others: Catalog) -> Catalog:
        return Catalog(sum((o.tables for o in others), self.tables))

    def __getitem__(self, key: str) -> Table:
        return next(t for t in self.tables if t.key == key)
