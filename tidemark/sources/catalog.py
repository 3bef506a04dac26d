"""Tables of the session catalog: reading their definition, and running change operations on them.

What Spark can do in place is done so (create, drop, rename a table, defaults, comments, columns that
are appended and may be null). All else is move-and-copy: the new rows are written to a staging table
of the same format, partitions, buckets, options and properties, and then swapped in (``changes``): the old table goes
last, an external one keeps its place, and what is cut off half-way is taken up by ``recover``. Constraints, indexes,
computed and identity columns are properties of the table, as the session catalog has none; what a constraint demands is validated
on the new rows wherever a change could break it. Checks and exclusions follow renamed columns and go with dropped ones, and so do foreign keys
of other tables, except that a column which another table refers to can't be dropped. Rows that are inserted, updated or deleted are
validated too, by looking up their keys only (``operators.writes``); UPDATE, DELETE and MERGE write touched files anew (``changes``).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from contextlib import nullcontext
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.casts import plain_type, stored_as
from ..functions.names import references, renamed
from ..operators import ops
from ..operators.rewrite import Rewrite, quoted, with_computed
from ..operators.validate import violations
from ..operators.writes import demands, judged, uses
from ..spec import Catalog, Column, Constraint, Identity, Index, Storage, Table
from . import changes, identity
from .files import Journal
from .scratch import settle

PROPERTY = ops.PROPERTY


class ValidationError(ValueError):
    pass


class Database:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    # reading

    def tables(self, database: str | None = None) -> list[str]:
        """Names of tables; views and the staging tables of changes under way are none."""
        listed = self.spark.catalog.listTables(database)
        return sorted(t.name for t in listed if not t.isTemporary and t.tableType != "VIEW" and not t.name.endswith(changes.SUFFIXES))

    def reflect(self, name: str) -> Table:
        """Everything from one statement; char and varchar lengths, which it leaves out, from the table's schema."""
        facts = json.loads(self.spark.sql(f"DESCRIBE TABLE EXTENDED {name} AS JSON").first()[0])
        properties = dict(facts.get("table_properties", {}))
        stored = json.loads(properties.pop(PROPERTY, "{}"))
        strict = set(stored.get("not_null", ()))
        more = stored.get("columns", {})
        columns = [Column.of(f) for f in self.spark.table(name).schema.fields]
        buckets = None
        if facts.get("num_buckets"):
            buckets = int(facts["num_buckets"]), tuple(facts.get("bucket_columns", ())), tuple(facts.get("sort_columns", ()))
        external = facts.get("type") == "EXTERNAL"
        options = {k: v for k, v in facts.get("storage_properties", {}).items() if k.lower() not in ("path", "serialization.format")}
        storage = Storage(
            facts.get("provider", "parquet"), tuple(facts.get("partition_columns", ())), buckets,
            tuple(sorted(options.items())), tuple(sorted(properties.items())), facts.get("location"), external,
        )
        constraints, indexes = _objects(stored)
        return Table(
            name, tuple(_column(c, c.name not in strict, more.get(c.name, {})) for c in columns), constraints, indexes,
            facts.get("comment") or None, storage=storage,
        )

    def catalog(self, database: str | None = None, only=lambda kind, name: True) -> Catalog:
        """All tables; ``only`` (kind: table, column, index or constraint; name: of columns and so on ``table.name``) leaves some out."""
        prefix = f"{database}." if database else ""
        found = []
        for name in self.tables(database):
            if not only("table", name):
                continue
            t = self.reflect(prefix + name)
            own = lambda kind, items: tuple(x for x in items if only(kind, f"{name}.{x.name}"))  # noqa: B023, E731
            found.append(replace(
                t, columns=own("column", t.columns), constraints=own("constraint", t.constraints), indexes=own("index", t.indexes)
            ))
        return Catalog(tuple(found))

    def _listed(self, database: str | None = None) -> DataFrame:
        """Every table's definition as text, from one statement."""
        listed = self.spark.sql(f"SHOW TABLE EXTENDED {f'IN {database} ' if database else ''}LIKE '*'").where("not isTemporary")
        return listed.where(~F.col("information").rlike(r"(?m)^Type: VIEW$") & ~F.col("tableName").rlike(f"({'|'.join(changes.SUFFIXES)})$"))

    def columns(self, database: str | None = None) -> DataFrame:
        """One row a column of every table of a database (table_name, provider, place, column_name, type, nullable), from one statement.

        The listing has every table's definition as text; it is taken apart by DataFrame functions. Lengths of
        char and varchar columns are not in it.
        """
        lines = F.regexp_extract_all("information", F.lit(r"(?m)^ \|-- (.*)$"), 1)
        rows = self._listed(database).select(
            F.col("tableName").alias("table_name"),
            F.regexp_extract("information", r"(?m)^Provider: (.*)$", 1).alias("provider"),
            F.regexp_extract("information", r'"not_null": (\[[^\]]*\])', 1).alias("strict"),
            F.posexplode(lines).alias("place", "line"),
        )
        name = F.regexp_extract("line", r"^(.*): [^:]*$", 1)
        return rows.select(
            "table_name", "provider", "place", name.alias("column_name"),
            F.regexp_extract("line", r": (\S+) \(nullable", 1).alias("type"),
            (~F.coalesce(F.array_contains(F.from_json("strict", "array<string>"), name), F.lit(False))).alias("nullable"),
        )

    def objects(self, database: str | None = None) -> DataFrame:
        """A row for each constraint and index of a database's tables, from the same one statement.

        table_name, kind (primary, unique, foreign, check, exclude, index, unique index), name, columns (array), refers (table), refers_columns, condition.
        """
        own = stored(self._listed(database))
        c = own.select("table_name", F.explode("o.constraints").alias("c")).select(
            "table_name", "c.kind", "c.name", "c.columns", F.get_json_object("c.refers", "$[0]").alias("refers"),
            F.from_json(F.get_json_object("c.refers", "$[1]"), "array<string>").alias("refers_columns"), "c.condition",
        )
        nothing = F.lit(None).cast("string")
        i = own.select("table_name", F.explode("o.indexes").alias("i")).select(
            "table_name", F.when(F.col("i.unique"), "unique index").otherwise("index").alias("kind"), "i.name", "i.columns",
            nothing.alias("refers"), F.lit(None).cast("array<string>").alias("refers_columns"), nothing.alias("condition"),
        )
        return c.unionAll(i)

    def definitions(self, database: str | None = None) -> DataFrame:
        """All tables of a database from one statement: table_name, comment, place and name of each column with its type, nullable, default, comment, computed, identity.

        What this library has stored of a column counts where the column is still there; else there is its type as the listing has it.
        """
        listed = self._listed(database)
        lines = F.regexp_extract_all("information", F.lit(r"(?m)^ \|-- (.*)$"), 1)
        rows = stored(listed, "information").select("table_name", "o", "information", F.posexplode(lines).alias("place", "line"))
        name, plain = F.regexp_extract("line", r"^(.*): [^:]*$", 1), F.regexp_extract("line", r": (\S+) \(nullable", 1)
        short = F.create_map(*(F.lit(x) for pair in _NAMES.items() for x in pair))
        own = lambda field: F.try_element_at("o.columns", F.col("name"))[field]
        return rows.withColumns({"name": name, "plain": F.coalesce(F.try_element_at(short, plain), plain)}).select(
            "table_name", F.nullif(F.regexp_extract("information", r"(?m)^Comment: (.*)$", 1), F.lit("")).alias("table_comment"), "place", "name",
            F.coalesce(own("type"), "plain").alias("type"),
            (~F.coalesce(F.array_contains("o.not_null", F.col("name")), F.lit(False))).alias("nullable"),
            own("default").alias("default"), own("comment").alias("comment"), own("computed").alias("computed"), own("identity").alias("identity"),
        )

    def known(self, o: ops.Operation) -> ops.Operation:
        """``o`` with the definitions and places that its inverse needs, as they are now."""
        if isinstance(o, ops.DropTable):
            return replace(o, old=self.reflect(o.table))
        if isinstance(o, ops.Batch):
            t = self.reflect(o.table)
            rewrite, altered = Rewrite(t), []
            for c in o.changes:
                if isinstance(c, ops.DropColumn | ops.AlterColumn):
                    c = replace(c, old=rewrite.columns.get(rewrite.find(c.name) or c.name))
                elif isinstance(c, ops.DropConstraint):
                    c = replace(c, old=next((x for x in t.constraints if x.name == c.name), None))
                elif isinstance(c, ops.DropIndex):
                    c = replace(c, old=next((x for x in t.indexes if x.name == c.name), None))
                if not isinstance(c, _OBJECTS):
                    c.change(rewrite)
                altered.append(c)
            return replace(o, changes=tuple(altered), order=tuple(c.name for c in t.columns))
        if not isinstance(o, ops.DropColumn | ops.AlterColumn | ops.DropConstraint | ops.DropIndex | ops.TableComment):
            return o
        t = self.reflect(o.table)
        if isinstance(o, ops.TableComment):
            return replace(o, old=t.comment)
        if isinstance(o, ops.DropConstraint | ops.DropIndex):
            have = t.constraints if isinstance(o, ops.DropConstraint) else t.indexes
            return replace(o, old=next((x for x in have if x.name == o.name), None))
        o = replace(o, old=t.column(o.name))
        place = t.columns.index(o.old)
        if isinstance(o, ops.DropColumn) and 0 < place < len(t.columns) - 1:
            o = replace(o, behind=t.columns[place - 1].name)
        return o

    def data(self) -> dict[str, DataFrame]:
        return _Lazy(self.spark)

    # changing

    #: What runs operations of the user's own, or instead of what is here.
    implementations: dict[type, Callable[[Database, ops.Operation], None]] = {}

    @classmethod
    def implementation_for(cls, kind: type, replacing: bool = False):
        """Decorator of the function (database, operation) that runs operations of a class."""
        def register(f):
            if not replacing and (kind in cls.implementations or hasattr(cls, f"_{kind.__name__.lower()}")):
                raise ValueError(f"{kind.__name__} has an implementation")
            cls.implementations[kind] = f
            return f

        return register

    def run(self, *operations: ops.Operation) -> None:
        for o in operations:
            own = next((self.implementations[k] for k in type(o).__mro__ if k in self.implementations), None)
            own(self, o) if own else getattr(self, f"_{type(o).__name__.lower()}")(o)

    def recover(self, database: str | None = None) -> list[str]:
        """Take up changes that were cut off: what had been decided is gone through with, the rest is undone. Names of the tables.

        For when no change is under way: one that is would be taken for cut off.
        """
        journal, done = Journal(self.spark, database), []
        for path, entry in journal.pending():
            (changes.finish if entry["decided"] else changes.undo)(self, entry)
            journal.end(path)
            done.append(entry["table"])
        return done

    def _keep_objects(self, t: Table) -> None:
        self.spark.sql(f"ALTER TABLE {t.key} SET TBLPROPERTIES ({ops.literal(PROPERTY)} = {ops.literal(ops.objects_json(t))})")

    def _createtable(self, o: ops.CreateTable) -> None:
        if o.if_not_exists and self.spark.catalog.tableExists(o.table.key):
            return
        for s in o.sql():
            self.spark.sql(s)
        self._keep_objects(o.table)

    def _droptable(self, o: ops.DropTable) -> None:
        """Refused while other tables refer to it, unless ``cascade`` drops their foreign keys."""
        for t in self.children(o.table):
            if not o.cascade:
                raise ValueError(f"{o.table} can't be dropped, {t.key}.{_referring(t, o.table)[0].name} refers to it")
            self._keep_objects(replace(t, constraints=tuple(c for c in t.constraints if c not in _referring(t, o.table))))
        for s in o.sql():
            self.spark.sql(s)

    def _renametable(self, o: ops.RenameTable) -> None:
        children = self.children(o.table)
        for s in o.sql():
            self.spark.sql(s)
        self.follow(children, o.table, o.new, {})
        t = self.reflect(o.new)
        if t.storage.partitions:
            self.spark.sql(f"ALTER TABLE {o.new} RECOVER PARTITIONS")  # the catalog may keep their old places
        if own := _referring(t, o.table):
            moved = tuple(replace(c, refers=(o.new, c.refers[1])) if c in own else c for c in t.constraints)
            self._keep_objects(replace(t, constraints=moved))

    def children(self, parent: str) -> list[Table]:
        """Tables with a foreign key to ``parent`` (itself left out): one listing says which, only these are read."""
        database = parent.rpartition(".")[0]
        refers = F.lower("information").contains(f'"refers": ["{parent.lower()}",')
        names = [r[0] for r in self._listed(database or None).where(refers).select("tableName").collect()]
        names = sorted(f"{database}.{n}" if database else n for n in names)
        return [t for n in names if n.lower() != parent.lower() and _referring(t := self.reflect(n), parent)]

    def follow(self, children: list[Table], old: str, new: str, names: dict[str, str]) -> None:
        """Foreign keys of ``children`` to ``old``, with its and its columns' new names."""
        low = {k.lower(): v for k, v in names.items()}
        for t in children:
            refers = lambda c: (new, tuple(low.get(x.lower(), x) for x in c.refers[1]))  # noqa: B023, E731
            after = tuple(replace(c, refers=refers(c)) if c in _referring(t, old) else c for c in t.constraints)
            if after != t.constraints:
                self._keep_objects(replace(t, constraints=after))

    def _addcolumn(self, o: ops.AddColumn) -> None:
        t = self.reflect(o.table)
        if any(c.name.lower() == o.column.name.lower() for c in t.columns):
            if o.if_not_exists:
                return
            raise ValueError(f"column {o.column.name} is there already")
        c = o.column
        if c.nullable and c.default is None and c.computed is None and c.identity is None and o.fill is None and not (o.before or o.behind):
            for s in o.sql():
                self.spark.sql(s)
            self._keep_objects(t.with_columns((*t.columns, c)))
        else:
            self._batch(ops.Batch(o.table, (o,)))

    def _dropcolumn(self, o: ops.DropColumn) -> None:
        self._batch(ops.Batch(o.table, (o,)))

    def _altercolumn(self, o: ops.AlterColumn) -> None:
        simple = o.type is None and o.new_name is None and o.fill is None
        if not simple:
            return self._batch(ops.Batch(o.table, (o,)))
        t = self.reflect(o.table)
        changed = Rewrite(t).alter(o.name, nullable=o.nullable, default=o.default, comment=o.comment).result()
        if o.nullable is False:
            self._validate_nulls(changed, self.spark.table(o.table))
        for s in replace(o, nullable=None, identity=...).sql():
            self.spark.sql(s)
        if o.identity is not ...:
            column = changed.column(o.name)
            if o.identity is not None and column.type not in ("int", "bigint", "smallint"):
                raise ValueError(f"{t.key}.{column.name} is {column.type}, an identity has to be a whole number")
            changed = changed.with_columns(replace(c, identity=o.identity) if c is column else c for c in changed.columns)
        self._keep_objects(changed)

    def _addconstraint(self, o: ops.AddConstraint) -> None:
        t = self.reflect(o.table)
        if any(c.name == o.constraint.name for c in t.constraints):
            raise ValueError(f"constraint {o.constraint.name} is there already")
        self._demand(o.constraint, t, self.data())
        self._keep_objects(replace(t, constraints=(*t.constraints, o.constraint)))

    @staticmethod
    def _validate_nulls(t: Table, df: DataFrame) -> None:
        strict = [c.name for c in t.columns if not c.nullable]
        if strict:  # one pass for all columns
            counts = df.agg(*(F.count_if(F.col(quoted(c)).isNull()).alias(c) for c in strict)).first()
            if bad := [c for c in strict if counts[c]]:
                raise ValidationError(f"{t.key}.{bad[0]} may not be null and has {counts[bad[0]]} nulls")

    def _dropconstraint(self, o: ops.DropConstraint) -> None:
        t = self.reflect(o.table)
        gone = [c for c in t.constraints if c.name == o.name]
        if not gone and not o.if_exists:
            raise KeyError(f"no constraint {o.name} on {o.table}")
        if gone and o.kind not in (None, gone[0].kind):
            raise KeyError(f"constraint {o.name} on {o.table} is {gone[0].kind}, not {o.kind}")
        self._keep_objects(replace(t, constraints=tuple(c for c in t.constraints if c not in gone)))

    def _createindex(self, o: ops.CreateIndex) -> None:
        t = self.reflect(o.table)
        if any(i.name == o.index.name for i in t.indexes):
            if o.if_not_exists:
                return
            raise ValueError(f"index {o.index.name} is there already")
        if o.index.unique:
            self._demand(o.index.constraint(t), t, self.data())
        else:
            self.spark.table(t.key).select(*(F.expr(e) for e, _ in o.index.constraint(t).elements))  # columns and expressions are there
        self._keep_objects(replace(t, indexes=(*t.indexes, o.index)))

    def _dropindex(self, o: ops.DropIndex) -> None:
        t = self.reflect(o.table)
        left = tuple(i for i in t.indexes if i.name != o.name)
        if len(left) == len(t.indexes) and not o.if_exists:
            raise KeyError(f"no index {o.name} on {o.table}")
        self._keep_objects(replace(t, indexes=left))

    def _tablecomment(self, o: ops.TableComment) -> None:
        for s in o.sql():
            self.spark.sql(s)

    # rows

    def _bulkinsert(self, o: ops.BulkInsert) -> None:
        """Rows are dicts of values for the operation's columns; what a row leaves out takes the default as the catalog has it now."""
        if o.rows:
            self.insert(o.table.key, bulk_rows(self.spark, o, self.reflect(o.table.key)), given=frozenset(k for r in o.rows for k in r))

    def insert(self, name: str, rows: DataFrame, refused: str = "raise", given: frozenset[str] | None = None) -> DataFrame:
        """Append ``rows`` to a table; columns are matched by name, missing ones take their defaults, identities and computed values.

        Rows that break a constraint are looked for before anything is written. ``refused``: "raise" (``ValidationError``, nothing is
        written) or "skip" (the others are written). The result is what was refused, with the names of what it breaks in ``_refused``.
        A table with constraints or identities takes one insert at a time (``files.Busy``), so that two can't bring the same key.
        """
        if refused not in ("raise", "skip"):
            raise ValueError(f"refused={refused}")
        t = self.reflect(name)
        alone = demands(t) or any(c.identity for c in t.columns)
        with changes.guard(self, t) if alone else nullcontext():
            return self._inserted(self.reflect(name) if alone else t, rows, refused, given)

    def _inserted(self, t: Table, rows: DataFrame, refused: str, given: frozenset[str] | None) -> DataFrame:
        name = t.key
        ready = settle(identity.allocated(self, t, whole_rows(t, rows, given)))
        seen = settle(judged(ready, t, self.data()))
        bad = seen.where(F.size("_refused") > 0)
        if refused == "raise" and (example := bad.take(1)):
            raise ValidationError(f"{t.key} would violate {', '.join(example[0]['_refused'])}, for example {example[0]}")
        places = self.spark.table(name).columns
        seen.where(F.size("_refused") == 0).select(*map(quoted, places)).write.insertInto(name)
        return bad

    def update(self, name: str, values: dict[str, changes.Text], where: changes.Text | None = None, alias: str | None = None) -> int:
        """Set columns to SQL expressions over the row, where ``where`` is true. The number of rows."""
        return changes.update(self, name, values, where, alias)

    def delete(self, name: str, where: changes.Text | None = None, alias: str | None = None) -> int:
        return changes.delete(self, name, where, alias)

    def merge(self, name: str, source: DataFrame, on: changes.Text, *clauses: changes.When, alias: str = "target", source_alias: str = "source") -> int:
        """The clauses for rows of ``source`` that match and don't match, the first of each kind that holds. The number of rows."""
        return changes.merge(self, name, source, on, clauses, alias, source_alias)

    def _execute(self, o: ops.Execute) -> None:
        """INSERT, UPDATE, DELETE and MERGE of tables with constraints are validated; the others go to Spark."""
        if not changes.statement(self, o.statement):
            self.spark.sql(o.statement)

    def _batch(self, o: ops.Batch, source: Table | None = None) -> None:
        """All column changes in one rewrite; what they touch is checked on the new rows before the swap.

        ``source``: the table's definition, if it is not to be read from the catalog.
        """
        old = source or self.reflect(o.table)
        if source and not source.storage.location:
            stored = self.reflect(o.table).storage
            old = replace(old, storage=replace(old.storage, location=stored.location, external=stored.external))
        rewrite = o.change(Rewrite(old))
        names = followed(old, o)
        new = carried(old, o, rewrite.result(), names)
        if o.recreate == "never" and not self._native(o, old):
            raise ValueError(f"{o.table} can't be changed so without writing its rows again")
        if o.recreate != "always" and self._native(o, old):
            return self.run(*o.changes)
        children = self.children(o.table)
        low = {k.lower() for k in names}
        for t in children:
            for c in _referring(t, o.table):
                if lost := [x for x in c.refers[1] if x.lower() not in low]:
                    raise ValueError(f"{t.key}.{c.name} refers to {o.table}.{lost[0]}, which can't be dropped")
        rows = rewrite.apply(self.spark.table(o.table))
        if numbered := [c.column for c in o.changes if isinstance(c, ops.AddColumn) and c.column.identity]:
            rows, new = identity.backfilled(new, rows, numbered)
        fresh = rewrite.fresh()

        def check(staged: DataFrame) -> None:
            self._validate_nulls(new, staged)
            data = _Lazy(self.spark)
            data[new.key] = staged
            come = {x.constraint.name for x in o.changes if isinstance(x, ops.AddConstraint)}
            come |= {x.index.name for x in o.changes if isinstance(x, ops.CreateIndex)}
            for c in demands(new):
                if c.name in come or uses(c, new) & fresh:
                    self._demand(c, new, data)
            mine = {k.lower(): v for k, v in names.items()}
            for t in children:
                for c in _referring(t, o.table):
                    if {mine[x.lower()] for x in c.refers[1]} & fresh:
                        self._demand(replace(c, refers=(new.key, tuple(mine[x.lower()] for x in c.refers[1]))), t, data)

        changes.swap(self, old, new, rows, check, names)

    @staticmethod
    def _native(o: ops.Batch, t: Table) -> bool:
        """Whether all changes are ones that leave the rows as they are."""
        def plain(c):
            if isinstance(c, ops.AddColumn):
                x = c.column
                return x.nullable and (x.default, x.computed, x.identity, c.fill, c.before, c.behind) == (None,) * 6
            if isinstance(c, ops.AlterColumn):
                return c.type is None and c.new_name is None and c.fill is None and c.using is None
            return isinstance(c, (*_OBJECTS, ops.TableComment))

        return not o.reordering and all(map(plain, o.changes))

    def rewrite(self, o: ops.Batch, source: Table | None = None) -> None:
        """``o`` by move-and-copy, with the definition of the table as the caller gives it (constraints it has, storage)."""
        self._batch(replace(o, recreate="always"), source)

    @staticmethod
    def _demand(c: Constraint, t: Table, data) -> None:
        if bad := violations(c, t, data).take(1):
            raise ValidationError(f"{t.key} would violate {c.name}, for example {bad[0]}")


#: Types as listings call them, where that is not their name in SQL.
_NAMES = {"integer": "int", "long": "bigint", "short": "smallint", "byte": "tinyint"}

_SHAPE = (
    "constraints array<struct<name:string,kind:string,columns:array<string>,refers:string,condition:string,options:array<array<string>>,elements:string>>, "
    "indexes array<struct<name:string,columns:array<string>,unique:boolean>>, not_null array<string>, columns map<string,struct<type:string,"
    "default:string,comment:string,computed:string,identity:struct<start:bigint,step:bigint,always:boolean>>>"
)


def stored(listed: DataFrame, *more: str) -> DataFrame:
    """table_name and what this library has stored of each table of a listing, as the struct o."""
    text = F.regexp_extract("information", rf"{PROPERTY.replace('.', chr(92) + '.')}=(\{{.*?{ops.END}\}})", 1)
    return listed.select(F.col("tableName").alias("table_name"), F.from_json(text, _SHAPE).alias("o"), *more)


_OBJECTS = (ops.AddConstraint, ops.DropConstraint, ops.CreateIndex, ops.DropIndex)


def _referring(t: Table, parent: str) -> list[Constraint]:
    return [c for c in t.constraints if c.refers and c.refers[0].lower() == parent.lower()]


def _column(c: Column, nullable: bool, more: dict) -> Column:
    made = more.get("identity")
    return replace(c, nullable=nullable, computed=more.get("computed"), identity=made and Identity(**made))


def _objects(stored: dict) -> tuple[tuple[Constraint, ...], tuple[Index, ...]]:
    constraints = tuple(
        Constraint(
            c["name"], c["kind"], tuple(c["columns"]), c["refers"] and (c["refers"][0], tuple(c["refers"][1])),
            c["condition"], tuple((tuple(e) if isinstance(e, list) else e, operator) for e, operator in c["elements"]), c["where"],
            tuple(map(tuple, c["options"])),
        )
        for c in stored.get("constraints", ())
    )
    return constraints, tuple(Index(i["name"], tuple(i["columns"]), i["unique"]) for i in stored.get("indexes", ()))


class _Lazy(dict):
    """Tables by name, read when asked for."""

    def __init__(self, spark: SparkSession):
        super().__init__()
        self.spark = spark

    def __missing__(self, name: str) -> DataFrame:
        return self.spark.table(name)


def followed(old: Table, batch: ops.Batch) -> dict[str, str]:
    """The names after a batch of the columns that stay."""
    names = {c.name: c.name for c in old.columns}
    for o in batch.changes:
        if isinstance(o, ops.AlterColumn) and o.new_name:
            names = {k: o.new_name if v.lower() == o.name.lower() else v for k, v in names.items()}
        elif isinstance(o, ops.DropColumn):
            names = {k: v for k, v in names.items() if v.lower() != o.name.lower()}
    return names


def carried(old: Table, batch: ops.Batch, new: Table, names: dict[str, str] | None = None) -> Table:
    """Constraints, indexes and storage after a batch: what depends on columns that went goes, renamed columns are followed, new ones come."""
    names = followed(old, batch) if names is None else names
    low = {k.lower(): v for k, v in names.items()}
    own = {c.name.lower() for c in old.columns}
    constraints, indexes = [], []
    for c in old.constraints:
        columns = tuple(low[x.lower()] for x in c.columns if x.lower() in low)
        if uses(c, old) <= set(names):
            text = lambda x: x and renamed(x, names)
            elements = tuple(
                (text(e) if isinstance(e, str) else tuple(map(text, e)), operator) for e, operator in c.elements
            )
            refers = c.refers
            if refers and refers[0].lower() == old.key.lower():
                refers = refers[0], tuple(low.get(x.lower(), x) for x in refers[1])
            constraints.append(replace(c, columns=columns, condition=text(c.condition), where=text(c.where), elements=elements, refers=refers))
        elif c.kind == "primary" and columns:
            constraints.append(replace(c, columns=columns))
    for i in old.indexes:
        if reduce(set.union, ({x} if x.lower() in own else references(x, own) for x in i.columns), set()) and all(
            u.lower() in low for x in i.columns for u in ({x} if x.lower() in own else references(x, own))
        ):
            indexes.append(replace(i, columns=tuple(low[x.lower()] if x.lower() in own else renamed(x, names) for x in i.columns)))
    for o in batch.changes:
        if isinstance(o, ops.AddConstraint):
            constraints.append(o.constraint)
        elif isinstance(o, ops.DropConstraint):
            if not o.if_exists and all(c.name != o.name for c in constraints):
                raise KeyError(f"no constraint {o.name} on {old.key}")
            constraints = [c for c in constraints if c.name != o.name]
        elif isinstance(o, ops.CreateIndex):
            indexes.append(o.index)
        elif isinstance(o, ops.DropIndex):
            indexes = [i for i in indexes if i.name != o.name]
    return replace(new, constraints=tuple(constraints), indexes=tuple(indexes), storage=old.storage.following(names))


def whole_rows(t: Table, rows: DataFrame, given: frozenset[str] | None = None) -> DataFrame:
    """``rows`` with all columns of ``t``: defaults for those that are missing, computed values, and nulls where identities are to come.

    ``given``: the columns that were named, if ``rows`` has more than these.
    """
    have = {c.lower(): c for c in rows.columns}
    named = set(have) if given is None else {g.lower() for g in given}
    if odd := named - {c.name.lower() for c in t.columns}:
        raise KeyError(f"table {t.key} has no column {sorted(odd)[0]}")
    values = []
    for c in t.columns:
        if c.name.lower() in named and c.computed is not None:
            raise ValueError(f"{t.key}.{c.name} is computed and can't be given values")
        if c.name.lower() in named and c.identity and c.identity.always:
            raise ValueError(f"{t.key}.{c.name} is always numbered and can't be given values")
        if c.computed is None:
            value = F.col(quoted(have[c.name.lower()])) if c.name.lower() in have else F.expr(c.default if c.default is not None else "NULL")
            values.append(stored_as(value, c.type).alias(c.name))
    return with_computed(t.columns, rows.select(*values)).select(*(quoted(c.name) for c in t.columns))


def bulk_rows(spark: SparkSession, o: ops.BulkInsert, t: Table | None = None) -> DataFrame:
    """The rows as a DataFrame of the table's columns; what is left out takes the default. ``t``: the table as it is, if not the operation's."""
    columns = (t or o.table).columns
    own = [{k.lower(): v for k, v in r.items()} for r in o.rows]
    given = [c for c in columns if any(c.name.lower() in r for r in own)]
    known = spark.createDataFrame(
        [tuple(r.get(c.name.lower()) for c in given) + tuple(c.name.lower() in r for c in given) for r in own],
        ", ".join([f"{quoted(c.name)} {plain_type(c.type)}" for c in given] + [f"{quoted('has ' + c.name)} boolean" for c in given]),
    )
    values = []
    for c in columns:
        default = F.expr(c.default or "NULL").cast(plain_type(c.type))
        values.append((F.when(F.col(quoted("has " + c.name)), F.col(quoted(c.name))).otherwise(default) if c in given else default).alias(c.name))
    return known.select(*values)
