"""Changes of stored rows that survive being cut off: the swap of a rewritten table, and UPDATE, DELETE and MERGE.

A change first takes the table's journal (``files.Journal``), prepares all beside what is there, validates it, and
then writes what it is going to do: that decides it. What follows can be done again from any point, by ``Database.recover``, so that no
row is lost whenever the driver ends; readers in between may see the table missing for a moment. Undecided changes leave
nothing but files that are passed over.

Swap: a managed table is renamed aside, the staging table takes its name, and then the old one is dropped (a partitioned one is
dropped first, see ``_swap_names``). An external table keeps
its place: folders are renamed instead, and the definition is made anew at the old location.

UPDATE, DELETE and MERGE are copy-on-write by file: the rows that change are written down first, with their file and
place in it, their old and their new values. Only files with such rows are written again, the others are not
touched. What a deletion or a changed key means for tables that refer to it is worked out level by level with semi-joins before
anything is decided: ON DELETE and ON UPDATE CASCADE, SET NULL and SET DEFAULT change their rows too, else the change is refused. New values
are validated by their keys (``operators.writes``). Tables that are not plain Parquet files, or are bucketed, are written again as a whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.casts import stored_as
from ..functions.names import references
from ..operators import ops
from ..operators.rewrite import computed_levels, quoted, with_computed
from ..operators.writes import demands, judged, near
from ..spec import Constraint, Table
from .files import Busy, Files, Journal
from .scratch import settle, settled

#: Of the staging table while it is written, and of the old table until it goes.
SUFFIXES = ("__tidemark_new", "__tidemark_old")
STAGED = "_tidemark_staged"
FILE, PLACE, OLD, NEW = "_tm_file", "_tm_place", "_tm_old", "_tm_new"
#: Levels of foreign keys that one change may go through.
DEPTH = 100


#: SQL, or an expression of a parsed statement.
Text = str | Column


def _expr(x: Text) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def _database(name: str) -> str | None:
    return name.rpartition(".")[0] or None


class _Change:
    """The journals of one change: undone if it fails before ``decide``, left for recovery if it fails after it."""

    def __init__(self, db, table: str, entry: dict):
        self.db, self.journal, self.paths, self.decided = db, Journal(db.spark, _database(table)), [], False
        self.table, self.entries, self.then = table, [], []
        self.take(table, entry)

    def take(self, table: str, entry: dict) -> None:
        try:
            self.paths.append(self.journal.begin(table, {"table": table, "decided": False, **entry}))
        except Busy as e:
            raise Busy(f"{table} is being changed, or a change of it was cut off and waits for recovery") from e
        self.entries.append(entry)

    def decide(self, entry: dict) -> None:
        self.entry = {"table": self.table, "decided": True, **entry}
        self.journal.decide(self.paths[0], self.entry)
        self.decided = True

    def __enter__(self):
        return self

    def __exit__(self, kind, error, trace):
        if kind is not None and not issubclass(kind, Exception):
            return  # the driver ends: for recovery
        if kind is None and self.decided:
            finish(self.db, self.entry)
        if kind is not None and not self.decided:
            for entry in self.entries:
                undo(self.db, entry)
        if kind is None or not self.decided:
            for path in reversed(self.paths):
                self.journal.end(path)
        for step in self.then if kind is None else ():
            step()


def drop(db, name: str) -> None:
    """A staging table with its files, wherever they are."""
    if db.spark.catalog.tableExists(name):
        t = db.reflect(name)
        db.spark.sql(f"DROP TABLE IF EXISTS {name}")
        if t.storage.external:
            Files(db.spark).delete(t.storage.location)


def undo(db, entry: dict) -> None:
    if entry["kind"] == "table":
        drop(db, entry["staging"])
        if entry.get("folder"):
            Files(db.spark).delete(entry["folder"])
    elif entry.get("location"):
        Files(db.spark).delete(f"{entry['location']}/{STAGED}")


def finish(db, entry: dict) -> None:
    """Go through with what has been decided, from wherever it is."""
    if entry["kind"] == "table":
        (_swap_folders if entry["external"] else _swap_names)(db, entry)
        for child, stored in entry["children"].items():
            if db.spark.catalog.tableExists(child):
                db.spark.sql(f"ALTER TABLE {child} SET TBLPROPERTIES ({ops.literal(ops.PROPERTY)} = {ops.literal(stored)})")
    else:
        for part in entry["parts"]:
            _swap_files(db, part)


# move-and-copy


def swap(db, old: Table, new: Table, rows: DataFrame, check, names: Mapping[str, str] | None = None) -> None:
    """Put ``rows`` as the table ``new`` in the place of ``old``. ``check`` gets the staged rows and raises if they may not come."""
    spark, key = db.spark, old.key
    staging, aside = (key + s for s in SUFFIXES)
    external, location = old.storage.external, old.storage.location and old.storage.location.rstrip("/")
    place = location + SUFFIXES[0] if external else None
    with _Change(db, key, {"kind": "table", "staging": staging, "folder": place}) as change:
        drop(db, staging)
        drop(db, aside)
        if external:
            Files(spark).delete(place)
            Files(spark).delete(location + SUFFIXES[1])
        staged = replace(new, name=staging, schema=None, storage=replace(new.storage, location=place, external=external))
        for s in ops.CreateTable(staged).sql():
            spark.sql(s)
        db._keep_objects(replace(new, name=staging, schema=None))
        rows.select(*map(quoted, spark.table(staging).columns)).write.insertInto(staging)  # partition columns come last
        check(spark.table(staging))
        final = replace(new, storage=replace(new.storage, location=location, external=external))
        change.decide({
            "kind": "table", "staging": staging, "aside": aside, "external": external, "location": location, "names": [key],
            "create": ops.CreateTable(final).sql(), "objects": ops.objects_json(new), "partitioned": bool(new.storage.partitions),
            "was_partitioned": bool(old.storage.partitions),
            "children": _following(db, key, names or {}),
        })


def _following(db, key: str, names: Mapping[str, str]) -> dict[str, str]:
    """What tables that refer to ``key`` hold when its columns have their new names."""
    low, out = {k.lower(): v for k, v in names.items()}, {}
    for t in db.children(key):
        own = lambda c: c.refers and c.refers[0].lower() == key.lower()
        after = tuple(replace(c, refers=(key, tuple(low.get(x.lower(), x) for x in c.refers[1]))) if own(c) else c for c in t.constraints)
        if after != t.constraints:
            out[t.key] = ops.objects_json(replace(t, constraints=after))
    return out


def _swap_names(db, entry: dict) -> None:
    spark, table, staging, aside = db.spark, entry["table"], entry["staging"], entry["aside"]
    there = spark.catalog.tableExists
    if there(staging):
        if there(table) and entry["was_partitioned"]:
            # The catalog may hold its partitions by their old places after a renaming: dropped later, it would take the new table's files
            # along. All rows are in the staging table, which is decided to be the table.
            spark.sql(f"DROP TABLE {table}")
        elif there(table):
            spark.sql(f"ALTER TABLE {table} RENAME TO {aside}")
        spark.sql(f"ALTER TABLE {staging} RENAME TO {table}")
    if entry["partitioned"]:
        spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")  # of which the catalog keeps the places before the renaming, or misspelled ones
    spark.sql(f"DROP TABLE IF EXISTS {aside}")


def _swap_folders(db, entry: dict) -> None:
    spark, files, table, place = db.spark, Files(db.spark), entry["table"], entry["location"]
    staged, aside = (place + s for s in SUFFIXES)
    if files.exists(staged):
        if files.exists(place):
            files.move(place, aside)
        files.move(staged, place)
    spark.sql(f"DROP TABLE IF EXISTS {entry['staging']}")
    spark.sql(f"DROP TABLE IF EXISTS {table}")  # the definition: the files are not the catalog's
    for s in entry["create"]:
        spark.sql(s)
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({ops.literal(ops.PROPERTY)} = {ops.literal(entry['objects'])})")
    if entry["partitioned"]:
        spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    files.delete(aside)


def _swap_files(db, part: dict) -> None:
    files, place = Files(db.spark), part["location"].rstrip("/")
    staged = f"{place}/{STAGED}"
    for name in files.below(staged):
        files.move(f"{staged}/{name}", f"{place}/{name}")
    for path in part["remove"]:
        files.delete(path)
    files.delete(staged)
    if part["partitions"]:
        specs = " ".join(f"PARTITION ({', '.join(f'{quoted(k)} = {ops.literal(v)}' for k, v in spec)})" for spec in part["partitions"])
        db.spark.sql(f"ALTER TABLE {part['table']} ADD IF NOT EXISTS {specs}")
    db.spark.catalog.refreshTable(part["table"])


def _partitions(spark, names: Iterable[str]) -> list[list[tuple[str, str | None]]]:
    """Partitions of files by their folders, as the catalog is told them."""
    plain = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    out = []
    for folder in sorted({n.rpartition("/")[0] for n in names} - {""}):
        pairs = [x.partition("=")[::2] for x in folder.split("/")]
        out.append([(plain(k), None if v == "__HIVE_DEFAULT_PARTITION__" else plain(v)) for k, v in pairs])
    return out


# rows


@dataclass(frozen=True)
class When:
    """A clause of MERGE. ``kind``: matched, missing (from the target), surplus (rows of the target without a source row).

    ``action``: update, delete or insert; ``values``: SQL by column, None for all columns of the source.
    """

    kind: str
    action: str
    values: Mapping[str, Text] | None = None
    condition: Text | None = None


#: Spark fills up char columns as it reads them, in a projection above the scan that hides where rows come from; they are stored filled up.
PADDING = "spark.sql.readSideCharPadding"


def _placed(spark, name: str) -> DataFrame:
    """A table's rows with FILE and PLACE."""
    before = spark.conf.get(PADDING)
    spark.conf.set(PADDING, "false")
    try:  # the plan is analysed here and now
        return spark.table(name).withColumns({FILE: F.col("_metadata.file_path"), PLACE: F.col("_metadata.row_index")})
    finally:
        spark.conf.set(PADDING, before)


class _Part:
    """A table in a change: its rows with their places, and those that change (FILE, PLACE, OLD, NEW; NEW null: the row goes)."""

    def __init__(self, db, name: str):
        self.db, self.t = db, db.reflect(name)
        self.columns = [c.name for c in self.t.columns]
        self.by_file = self.t.storage.provider.lower() == "parquet" and not self.t.storage.buckets
        df = db.spark.table(name)
        if self.by_file:
            self.rows = _placed(db.spark, name)
        else:  # its rows as they are now, numbered
            self.rows = settle(df.withColumns({FILE: F.lit(""), PLACE: F.monotonically_increasing_id()}))
        self.changed: DataFrame | None = None
        self.inserts: DataFrame | None = None
        self.touched: set[str] = set()
        self.kept: Column | None = None
        self.lost: tuple[list[str], DataFrame] | None = None

    def struct(self) -> Column:
        return F.struct(*map(quoted, self.columns))

    def rest(self, rows: DataFrame | None = None) -> DataFrame:
        """Rows that don't change."""
        rows = self.rows if rows is None else rows
        if self.kept is not None:
            return rows.where(self.kept)
        if self.lost is not None:  # a key is narrower than a file's name and a place, and there are fewer of them
            return rows.join(self.lost[1], _equal(*self.lost), "left_anti")
        return rows if self.changed is None else rows.join(self.changed.select(FILE, PLACE), [FILE, PLACE], "left_anti")

    def fresh(self) -> DataFrame | None:
        """New values of rows, and new rows."""
        parts = [] if self.changed is None else [self.changed.where(F.col(NEW).isNotNull()).select(f"{NEW}.*")]
        parts += [] if self.inserts is None else [self.inserts]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def now(self) -> DataFrame:
        """FILE, PLACE, OLD (as stored) and NEW (as it is to be so far) of rows that are to stay."""
        kept = self.rest().select(FILE, PLACE, self.struct().alias(OLD), self.struct().alias(NEW))
        return kept if self.changed is None else kept.unionAll(self.changed.where(F.col(NEW).isNotNull()))

    def change(self, more: DataFrame, columns: Iterable[str] | None, stored: bool = False) -> None:
        """``more`` (like ``changed``; ``stored``: columns of a settled table) comes on top of what has changed before."""
        self.kept = self.lost = None
        if self.changed is not None:
            more, stored = self.changed.join(more.select(FILE, PLACE), [FILE, PLACE], "left_anti").unionAll(more), False
        self.changed = more if stored else settle(more)
        self.touched |= set(self.columns if columns is None else columns)


def _set(part: _Part, rows: DataFrame, values: Mapping[str, Text], qualify=lambda c: quoted(c)) -> tuple[DataFrame, set[str]]:
    """``rows`` with NEW: their columns with ``values`` set and computed ones computed; and the columns that may differ."""
    t, low = part.t, {k.lower(): v for k, v in values.items()}
    for name in values:
        c = t.column(name)
        if c.computed is not None or c.identity and c.identity.always:
            raise ValueError(f"{t.key}.{c.name} can't be given values")
    own = {c.name: stored_as(_expr(low.get(c.name.lower(), qualify(c.name))), c.type) for c in t.columns if c.computed is None}
    made = with_computed(t.columns, rows.select(FILE, PLACE, OLD, *(v.alias(n) for n, v in own.items())))
    changed = {t.column(n).name for n in values}
    for level in computed_levels(t.columns):
        changed |= {c.name for c in level if references(c.computed, part.columns) & changed}
    return made.select(FILE, PLACE, OLD, part.struct().alias(NEW)), changed


def _steady(df: DataFrame) -> bool:
    return df._jdf.queryExecution().analyzed().deterministic()


def update(db, name: str, values: Mapping[str, Text], where: Text | None = None, alias: str | None = None) -> int:
    return _where(db, name, where, alias, lambda part, rows: _set(part, rows, values))


def delete(db, name: str, where: Text | None = None, alias: str | None = None) -> int:
    return _where(db, name, where, alias, _gone)


def _gone(part: _Part, rows: DataFrame) -> tuple[DataFrame, set[str]]:
    return rows.select(FILE, PLACE, OLD, F.lit(None).cast(rows.schema[OLD].dataType).alias(NEW)), set(part.columns)


def _where(db, name: str, where: Text | None, alias: str | None, made) -> int:
    with _Change(db, name, _lock(db, name)) as change:
        part = _Part(db, name)
        own = part.rows.alias(alias or name.rpartition(".")[2])
        hit = own if where is None else own.where(where)
        changed, columns = made(part, hit.withColumn(OLD, F.struct(*(F.col(quoted(c)) for c in part.columns))))
        part.change(changed, columns)
        if where is not None and not alias and _steady(hit):
            part.kept = ~F.coalesce(_expr(where), F.lit(False))
        return _apply(change, part)


def _lock(db, name: str) -> dict:
    return {"kind": "files", "location": db.reflect(name).storage.location}


def guard(db, t: Table) -> _Change:
    """The journal of a table whose files are only added to."""
    return _Change(db, t.key, {"kind": "files", "location": t.storage.location})


def merge(db, name: str, source: DataFrame, on: Text, clauses: Iterable[When], alias: str = "target", source_alias: str = "source") -> int:
    clauses = list(clauses)
    with _Change(db, name, _lock(db, name)) as change:
        part = _Part(db, name)
        t = part.t
        source = settle(source)
        s, own = source.alias(source_alias), part.rows.withColumn(OLD, part.struct()).alias(alias)
        star = {c: f"{source_alias}.{quoted(c)}" for c in source.columns}
        pieces, columns = [], set()
        for kind, rows in (("matched", own.join(s, _expr(on))), ("surplus", own.join(s, _expr(on), "left_anti"))):
            asked = [c for c in clauses if c.kind == kind]
            if not asked:
                continue
            first = F.lit(None).cast("int")
            for i, c in reversed(list(enumerate(asked))):
                first = F.when(F.lit(True) if c.condition is None else _expr(c.condition), F.lit(i)).otherwise(first)
            chosen = rows.withColumn("_tm_clause", first).where("_tm_clause is not null")
            for i, c in enumerate(asked):
                mine = chosen.where(F.col("_tm_clause") == i)
                if c.action == "delete":
                    mine, names = _gone(part, mine)
                else:
                    mine, names = _set(part, mine, star if c.values is None else c.values, lambda n: f"{alias}.{quoted(n)}")
                pieces.append(mine)
                columns |= names
        if pieces:
            changed = settle(reduce(DataFrame.unionAll, pieces))
            if twice := changed.groupBy(FILE, PLACE).count().where("count > 1").take(1):
                raise ValueError(f"a row of {t.key} is matched by {twice[0]['count']} rows of the source")
            part.change(changed, columns, stored=True)
        missing = [c for c in clauses if c.kind == "missing"]
        if missing:
            part.inserts = settle(_inserted(db, t, s.join(own, _expr(on), "left_anti"), missing, star))
            part.touched |= set(part.columns)
        return _apply(change, part)


def _inserted(db, t: Table, rows: DataFrame, clauses: list[When], star: Mapping[str, str]) -> DataFrame:
    from . import identity
    from .catalog import whole_rows

    first = F.lit(None).cast("int")
    for i, c in reversed(list(enumerate(clauses))):
        first = F.when(F.lit(True) if c.condition is None else _expr(c.condition), F.lit(i)).otherwise(first)
    chosen, parts = rows.withColumn("_tm_clause", first), []
    for i, c in enumerate(clauses):
        values = star if c.values is None else c.values
        parts.append(whole_rows(t, chosen.where(F.col("_tm_clause") == i).select(*(_expr(v).alias(n) for n, v in values.items()))))
    return identity.allocated(db, t, settle(reduce(DataFrame.unionAll, parts)))


def _apply(change: _Change, root: _Part) -> int:
    """Work out what the change of ``root`` means for other tables, validate all new values, stage the files and decide."""
    db, parts = change.db, {root.t.key.lower(): root}
    n = 0 if root.changed is None else root.changed.count()
    n += 0 if root.inserts is None else root.inserts.count()
    if not n:
        return 0
    if root.changed is not None:
        _spread(change, parts, root)
    refused(db, parts)
    entries, whole = [], []
    for part in parts.values():
        if not part.by_file:
            whole.append(part)
            continue
        place = part.t.storage.location.rstrip("/")
        names = [] if part.changed is None else [r[0] for r in part.changed.select(FILE).distinct().collect()]  # as many as Spark lists for a scan
        kept = [part.rest(part.rows.where(F.col(FILE).isin(names)))] if names else []
        fresh = part.fresh()
        rows = reduce(DataFrame.unionByName, [*(k.select(*map(quoted, part.columns)) for k in kept), *([] if fresh is None else [fresh])])
        writer = rows.write.format(part.t.storage.provider).options(**dict(part.t.storage.options)).mode("overwrite")
        (writer.partitionBy(*part.t.storage.partitions) if part.t.storage.partitions else writer).save(f"{place}/{STAGED}")
        files = Files(db.spark)
        come = _partitions(db.spark, files.below(f"{place}/{STAGED}")) if part.t.storage.partitions else []
        entries.append({"table": part.t.key, "location": place, "remove": [files.url(x) for x in names], "partitions": come})
    staged = [(p, settle(_union(p))) for p in whole]
    if entries:
        change.decide({"kind": "files", "parts": entries})
    if whole:
        change.then = [lambda p=p, rows=rows: swap(db, p.t, p.t, rows, lambda _: None) for p, rows in staged]
    return n


def _union(part: _Part) -> DataFrame:
    rest, fresh = part.rest().select(*map(quoted, part.columns)), part.fresh()
    return rest if fresh is None else rest.unionByName(fresh)


def refused(db, parts: dict[str, _Part]) -> None:
    """``ValidationError`` if new values break what their table demands."""
    from .catalog import ValidationError, _Lazy

    data = _Lazy(db.spark)
    final = {k: _union(p) for k, p in parts.items()}

    class Now(dict):
        def __missing__(self, key):
            return final[key.lower()] if key.lower() in final else data[key]

    for part in parts.values():
        fresh = part.fresh()
        if fresh is None or not (demands(part.t) or any(not c.nullable for c in part.t.columns)):
            continue
        tables = Now()
        tables[part.t.key] = part.rest()
        only = None if part.inserts is not None else part.touched
        if bad := judged(settle(fresh), part.t, tables, only).where(F.size("_refused") > 0).take(1):
            raise ValidationError(f"{part.t.key} would violate {', '.join(bad[0]['_refused'])}, for example {bad[0]}")


def _spread(change: _Change, parts: dict[str, _Part], root: _Part) -> None:
    """Level by level: rows that refer to keys which go or change are changed as their foreign key says."""
    from .catalog import ValidationError

    db, queue = change.db, [(root.t, root.changed, 0)]
    while queue:
        parent, delta, depth = queue.pop(0)
        if depth > DEPTH:
            raise ValidationError(f"foreign keys beyond {parent.key} go round")
        for child, c in _referring(db, parts, parent):
            seen = Observation()
            lost = _lost(parts[parent.key.lower()], delta, c)
            lost = settle(lost.observe(seen, F.count_if(F.col("_gone")).alias("gone"), F.count_if(~F.col("_gone")).alias("moved")))
            part = parts.get(child.key.lower()) or _Part(db, child.key)
            rules = {k.upper(): v.upper() for k, v in c.options}
            acts = []
            for gone, rule, n in ((True, rules.get("ON DELETE", "NO ACTION"), seen.get["gone"]), (False, rules.get("ON UPDATE", "NO ACTION"), seen.get["moved"])):
                if n and rule in ("NO ACTION", "RESTRICT"):
                    if example := _hits(part, c, lost.where(F.col("_gone") == gone)).take(1):
                        raise ValidationError(f"{child.key}.{c.name} refers to a key of {parent.key} that would go, for example {example[0][NEW]}")
                elif n:
                    acts.append((gone, rule))
            if not acts:
                continue
            lost = lost.where(F.col("_gone").isin([gone for gone, _ in acts]))
            hits = _hits(part, c, lost) if len(acts) == 1 else settle(_hits(part, c, lost))
            level, n = settled(reduce(DataFrame.unionAll, [_acted(child, part, c, hits.where(F.col("_gone") == gone), rule, gone) for gone, rule in acts]))
            if not n:
                continue
            if child.key.lower() not in parts:
                change.take(child.key, {"kind": "files", "location": child.storage.location})
                parts[child.key.lower()] = part
            # the old side of the next level is what the row was until now, not what is stored
            step = level.select(FILE, PLACE, F.col("_was").alias(OLD), NEW)
            first = part.changed is None
            part.change(level.select(FILE, PLACE, OLD, NEW), None, stored=True)
            if first:
                part.lost = [quoted(x) for x in c.columns], _apart(lost.select(*(f"k{i}" for i in range(len(c.columns)))))
            queue.append((child, step, depth + 1))


def _referring(db, parts: dict[str, _Part], parent: Table) -> list[tuple[Table, Constraint]]:
    known = {t.key.lower(): t for t in [*db.children(parent.key), parent]}
    return [(t, c) for t in known.values() for c in t.constraints if c.refers and c.refers[0].lower() == parent.key.lower()]


def _lost(part: _Part, delta: DataFrame, c: Constraint) -> DataFrame:
    """Keys (k0, ...) that the rows of ``delta`` had and the parent has no longer, what they are now (n0, ...), and whether the row went."""
    own = [x for x in c.refers[1]]
    was = [F.col(f"{OLD}.{quoted(x)}").alias(f"k{i}") for i, x in enumerate(own)]
    now = [F.col(f"{NEW}.{quoted(x)}").alias(f"n{i}") for i, x in enumerate(own)]
    rows = delta.select(*was, *now, F.col(NEW).isNull().alias("_gone"))
    differs = reduce(lambda a, b: a | b, (~F.col(f"k{i}").eqNullSafe(F.col(f"n{i}")) for i in range(len(own))))
    whole = reduce(lambda a, b: a & b, (F.col(f"k{i}").isNotNull() for i in range(len(own))))
    rows = rows.where(whole & (F.col("_gone") | differs))
    keys = [f"k{i}" for i in range(len(own))]
    rows = settle(rows.groupBy(*keys).agg(*(F.max(f"n{i}").alias(f"n{i}") for i in range(len(own))), F.bool_and("_gone").alias("_gone")))
    # a key that another row has, or gets, is not lost
    still = near(part.rest(), [quoted(x) for x in own], rows.select(*keys)).select(*(F.col(quoted(x)).alias(k) for x, k in zip(own, keys)))
    fresh = part.fresh()
    if fresh is not None:
        still = still.unionAll(fresh.select(*(F.col(quoted(x)) for x in own)))
    return rows.join(still.distinct(), keys, "left_anti")


def _apart(lost: DataFrame) -> DataFrame:
    """``lost`` by names that no table's columns have."""
    return lost.select(*(F.col(x).alias(f"_tm_{x}") for x in lost.columns))


def _equal(columns: list[str], lost: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, (F.col(x) == F.col(f"_tm_k{i}") for i, x in enumerate(columns)))


def _hits(part: _Part, c: Constraint, lost: DataFrame) -> DataFrame:
    """FILE, PLACE, OLD, NEW of the rows that refer to ``lost`` keys, with these. A row goes through the join once, not as OLD and as NEW."""
    names = [quoted(x) for x in c.columns]
    if part.changed is not None:
        return part.now().join(lost, reduce(lambda a, b: a & b, (F.col(f"{NEW}.{x}") == F.col(f"k{i}") for i, x in enumerate(names))))
    rows = near(part.rows, names, lost.select(*(f"k{i}" for i in range(len(names)))))
    own = part.struct()
    return rows.join(_apart(lost), _equal(names, lost)).select(FILE, PLACE, own.alias(OLD), own.alias(NEW), *(F.col(f"_tm_{x}").alias(x) for x in lost.columns))


def _acted(child: Table, part: _Part, c: Constraint, rows: DataFrame, rule: str, gone: bool) -> DataFrame:
    """FILE, PLACE, OLD, NEW and _was of the rows that refer, after the rule."""
    kept = [F.col(x) for x in (FILE, PLACE, OLD)]
    was = F.col(NEW).alias("_was")
    if rule == "CASCADE" and gone:
        return rows.select(*kept, F.lit(None).cast(rows.schema[NEW].dataType).alias(NEW), was)
    places = {x.lower(): i for i, x in enumerate(c.columns)}

    def value(x):
        old = F.col(f"{NEW}.{quoted(x.name)}")
        if x.name.lower() not in places:
            return old
        if rule == "CASCADE":
            return F.col(f"n{places[x.name.lower()]}")
        if rule == "SET DEFAULT":
            return F.expr(x.default or "NULL")
        if rule == "SET NULL":
            return F.lit(None)
        raise ValueError(f"{child.key}.{c.name}: {rule}")

    made = rows.select(*kept, was, *(stored_as(value(x), x.type).alias(x.name) for x in child.columns if x.computed is None))
    return with_computed(child.columns, made).select(*kept, part.struct().alias(NEW), "_was")


# statements


def statement(db, sql: str) -> bool:
    """Run INSERT, UPDATE, DELETE or MERGE as Spark's own parser reads it; False if it is another statement or needs nothing of ours."""
    spark = db.spark
    parser = spark._jsparkSession.sessionState().sqlParser()
    try:
        plan = parser.parsePlan(sql)
    except Exception:
        return False  # Spark will say what is wrong
    kind = plan.getClass().getSimpleName()
    around = None
    if kind == "UnresolvedWith" and plan.child().getClass().getSimpleName() == "InsertIntoStatement":
        around, plan, kind = plan, plan.child(), "InsertIntoStatement"
    if kind not in ("UpdateTable", "DeleteFromTable", "MergeIntoTable", "InsertIntoStatement"):
        return False
    name, alias = _relation(plan.targetTable() if kind == "MergeIntoTable" else plan.table())
    if name is None or not spark.catalog.tableExists(name):
        return False
    text = lambda e: type(F.lit(0))(spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(e))
    when = lambda option: text(option.get()) if option.isDefined() else None
    if kind == "UpdateTable":
        db.update(name, _assigned(plan.assignments(), text), when(plan.condition()), alias)
    elif kind == "DeleteFromTable":
        whole = plan.condition().toString() == "true"
        db.delete(name, None if whole else text(plan.condition()), alias)
    elif kind == "MergeIntoTable":
        source, source_alias = plan.sourceTable(), _relation(plan.sourceTable())
        clauses = []
        for of, actions in (("matched", plan.matchedActions()), ("missing", plan.notMatchedActions()), ("surplus", plan.notMatchedBySourceActions())):
            for i in range(actions.size()):
                a = actions.apply(i)
                said = a.getClass().getSimpleName()
                what = "update" if said.startswith("Update") else "insert" if said.startswith("Insert") else "delete"
                values = None if "Star" in said or what == "delete" else _assigned(a.assignments(), text)
                clauses.append(When(of, what, values, when(a.condition())))
        db.merge(
            name, _frame(spark, source), text(plan.mergeCondition()), *clauses,
            alias=alias or name.rpartition(".")[2], source_alias=source_alias[1] or (source_alias[0] or "source").rpartition(".")[2],
        )
    else:
        t = db.reflect(name)
        plain = not demands(t) and all(c.nullable and c.computed is None and c.identity is None for c in t.columns)
        if plain:
            return False
        if plan.overwrite() or plan.partitionSpec().size():
            raise ValueError(f"{name} has constraints: its rows can't be overwritten by a statement")
        query = plan.query()
        if around is not None:
            query = around.copy(query, around.cteRelations(), around.allowRecursion())
        rows = _frame(spark, query)
        named = [plan.userSpecifiedCols().apply(i) for i in range(plan.userSpecifiedCols().size())]
        if not plan.byName():
            columns = named or [c.name for c in t.columns if c.computed is None and not (c.identity and c.identity.always)]
            if len(columns) != len(rows.columns):
                raise ValueError(f"{name} takes {len(columns)} values a row, not {len(rows.columns)}")
            rows = rows.toDF(*columns)
        db.insert(name, rows)
    return True


def _relation(plan) -> tuple[str | None, str | None]:
    """Name and alias of a table in a parsed statement."""
    alias = None
    while plan.getClass().getSimpleName() == "SubqueryAlias":
        alias, plan = alias or plan.alias(), plan.child()
    if plan.getClass().getSimpleName() != "UnresolvedRelation":
        return None, alias
    parts = plan.multipartIdentifier()
    return ".".join(parts.apply(i) for i in range(parts.size())), alias


def _assigned(assignments, text) -> dict[str, Column]:
    out = {}
    for i in range(assignments.size()):
        a = assignments.apply(i)
        parts = a.key().nameParts()
        out[parts.apply(parts.size() - 1)] = text(a.value())
    return out


def _frame(spark, plan) -> DataFrame:
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)
