"""Schema diff: two catalogs as DataFrames, matched by full outer joins.

A catalog is ``columns`` (tbl, col, type, nullable, default, comment, computed, identity) and ``objects`` (tbl, kind, name,
signature), kind one of index, unique, foreign, check. A diff is rows (kind, tbl, object, old, new).
Renames look like drop and add; primary keys are not compared; checks are compared by name only, unless conditions are
asked for. Foreign keys are alike if both ends and their options are; "NO ACTION" is the default and counts as no option.
Expressions (of indexes, defaults, checks, computed columns) are alike if Catalyst reads them alike. A computed column's expression
can't be changed in place, so that another one is no difference but a warning (``warned``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.casts import plain_default, types_differ
from ..functions.expressions import canonical
from ..sources.catalog import stored
from ..sources.scratch import settle
from ..spec import Catalog, Column, Constraint, Identity, Table

COLUMNS = (
    "tbl string, col string, type string, nullable boolean, default string, comment string, computed string, identity string, "
    "default_form string, computed_form string"
)
OBJECTS = "tbl string, kind string, name string, signature string"


class Forms(dict):
    """(table, text) to what the expression is compared by; the text itself where there is none."""

    def __missing__(self, key):
        return key[1]

    @staticmethod
    def of(spark: SparkSession, *catalogs: Catalog) -> Forms:
        """Of all expressions of the catalogs' tables, those of one name read over the columns of all of them."""
        tables: dict[str, list[Table]] = {}
        for t in (t for c in catalogs for t in c.tables):
            tables.setdefault(t.key, []).append(t)
        out = Forms()
        for key, same in tables.items():
            columns = {c.name.lower(): c.type for t in same for c in t.columns}
            texts = [c.computed for t in same for c in t.columns] + [c.default for t in same for c in t.columns]
            texts += [x for t in same for i in t.indexes for x in i.columns if x.lower() not in columns]
            texts += [c.condition for t in same for c in t.constraints]
            if wanted := {x for x in texts if x is not None}:
                out |= {(key, text): form for text, form in canonical(spark, columns, wanted).items()}
        return out


def _identity(i: Identity | None) -> str | None:
    """The options that count."""
    return i and f"start {i.start} step {i.step}{' always' if i.always else ''}"


def columns_of(spark: SparkSession, catalog: Catalog, forms: Mapping = Forms()) -> DataFrame:  # noqa: B008
    form = lambda t, text: text and forms[t.key, text]
    rows = [
        (t.key, c.name, c.type, c.nullable, c.default, c.comment, c.computed, _identity(c.identity), form(t, c.default), form(t, c.computed))
        for t in catalog.tables for c in t.columns
    ]
    return spark.createDataFrame(rows, COLUMNS)


def objects_of(spark: SparkSession, catalog: Catalog, forms: Mapping = Forms(), conditions: bool = False) -> DataFrame:  # noqa: B008
    """Signatures: unique by sorted columns, index by uniqueness and ordered columns or expressions, foreign by both ends."""
    rows = []
    for t in catalog.tables:
        rows += [(t.key, "index", i.name, f"{i.unique}:{','.join(forms[t.key, x] for x in i.columns)}") for i in t.indexes]
        for c in t.constraints:
            if c.kind == "unique":
                rows.append((t.key, "unique", c.name, ",".join(sorted(c.columns))))
            elif c.kind == "foreign":
                rows.append((t.key, "foreign", c.name, foreign_signature(c)))
            elif c.kind == "check":
                rows.append((t.key, "check", c.name, forms[t.key, c.condition] if conditions else c.name))
    return spark.createDataFrame(rows, OBJECTS)


def foreign_signature(c: Constraint) -> str:
    options = sorted(f" {k.lower()} {v.lower()}" for k, v in c.options if v.lower() != "no action")
    return f"{','.join(c.columns)}->{c.refers[0]}({','.join(c.refers[1])})" + "".join(options)


def filtered(catalog: Catalog, only: Callable[[str, str], bool]) -> Catalog:
    """Without what ``only(kind, name)`` says no to; kind is schema, table, column, index or constraint (the last three by ``table.name``)."""
    out = []
    for t in catalog.tables:
        if (t.schema and not only("schema", t.schema)) or not only("table", t.key):
            continue
        own = {k: tuple(x for x in items if only(k, f"{t.key}.{x.name}")) for k, items in (
            ("column", t.columns), ("constraint", t.constraints), ("index", t.indexes))}
        out.append(replace(t, columns=own["column"], constraints=own["constraint"], indexes=own["index"]))
    return Catalog(tuple(out))


def comments(actual: DataFrame, desired: DataFrame) -> DataFrame:
    """add_table_comment (also where another was there) and remove_table_comment, of tables (tbl, comment) that both have."""
    both = actual.withColumnRenamed("comment", "a").join(desired.withColumnRenamed("comment", "d"), "tbl").where(~F.col("a").eqNullSafe(F.col("d")))
    kind = F.when(F.isnull("d"), "remove_table_comment").otherwise("add_table_comment")
    return both.select(*_row(kind, None, F.col("a"), F.col("d")))


def _row(kind, object_, old, new):
    kind = F.lit(kind) if isinstance(kind, str) else kind
    text = [(F.lit(None) if x is None else x).cast("string") for x in (object_, old, new)]
    return [kind.alias("kind"), F.col("tbl"), text[0].alias("object"), text[1].alias("old"), text[2].alias("new")]


def tables(actual: DataFrame, desired: DataFrame) -> DataFrame:
    """add_table and remove_table."""
    a = actual.select("tbl").distinct().withColumn("a", F.lit(True))
    d = desired.select("tbl").distinct().withColumn("d", F.lit(True))
    both = a.join(d, "tbl", "full_outer").where("a is null or d is null")
    return both.select(*_row(F.when(F.isnull("a"), "add_table").otherwise("remove_table"), None, None, None))


def _matched(actual: DataFrame, desired: DataFrame) -> DataFrame:
    """Columns of the tables that both have, with a and d structs."""
    common = actual.select("tbl").distinct().join(desired.select("tbl").distinct(), "tbl", "left_semi")
    side = lambda df, name: df.join(common, "tbl", "left_semi").select(
        "tbl", "col", F.struct(*(c.split()[0] for c in COLUMNS.split(", ")[2:])).alias(name)
    )
    return side(actual, "a").join(side(desired, "d"), ["tbl", "col"], "full_outer")


def columns(actual: DataFrame, desired: DataFrame, *, compare_types: bool = True, compare_defaults: bool = False) -> DataFrame:
    """add_column, remove_column, modify_type, modify_nullable, modify_comment, and modify_default if asked for."""
    both = _matched(actual, desired)
    there = F.col("a").isNotNull() & F.col("d").isNotNull()
    changes = [
        F.when(F.isnull("a"), F.struct(F.lit("add_column").alias("kind"), F.lit(None).cast("string").alias("old"), F.col("d.type").alias("new"))),
        F.when(F.isnull("d"), F.struct(F.lit("remove_column").alias("kind"), F.col("a.type").alias("old"), F.lit(None).cast("string").alias("new"))),
    ]
    attributes = [
        # an identity is never null whatever is declared, and a computed column may not say whether it is
        ("modify_nullable", "nullable", (F.col("a.nullable") != F.col("d.nullable")) & F.isnull("d.identity") & ~(F.col("d.computed").isNotNull() & F.col("d.nullable"))),
        ("modify_default", "identity", ~F.col("a.identity").eqNullSafe(F.col("d.identity"))),
        ("modify_comment", "comment", F.coalesce("a.comment", F.lit("")) != F.coalesce("d.comment", F.lit(""))),
    ]
    if compare_types:
        attributes.append(("modify_type", "type", types_differ(F.col("a.type"), F.col("d.type"))))
    if compare_defaults:
        plain = lambda side: plain_default(F.col(f"{side}.default_form"))
        attributes.append(("modify_default", "default", ~plain("a").eqNullSafe(plain("d"))))
    for kind, name, differs in attributes:
        value = F.struct(F.lit(kind).alias("kind"), F.col(f"a.{name}").cast("string").alias("old"), F.col(f"d.{name}").cast("string").alias("new"))
        changes.append(F.when(there & differs, value))
    found = both.select("tbl", "col", F.explode(F.array_compact(F.array(*changes))).alias("x"))
    return found.select(*_row(F.col("x.kind"), F.col("col"), F.col("x.old"), F.col("x.new")))


def objects(actual: DataFrame, desired: DataFrame) -> DataFrame:
    """add_/remove_ index, constraint and fk: by name (foreign keys and unnamed uniques by signature).

    One of the same name and another signature is removed and added.
    """
    by = F.when((F.col("kind") == "foreign") | F.isnull("name"), F.col("signature")).otherwise(F.col("name"))
    a = actual.withColumn("id", by).select("tbl", "kind", "id", F.struct("name", "signature").alias("a"))
    d = desired.withColumn("id", by).select("tbl", "kind", "id", F.struct("name", "signature").alias("d"))
    noun = F.when(F.col("kind") == "index", "index").when(F.col("kind") == "foreign", "fk").otherwise("constraint")
    both = a.join(d, ["tbl", "kind", "id"], "full_outer").withColumn("noun", noun)
    differs = F.col("a.signature") != F.col("d.signature")
    gone = F.when(F.isnull("d") | differs, F.struct(F.concat(F.lit("remove_"), "noun").alias("verb"), F.col("a.signature").alias("old"), F.lit(None).cast("string").alias("new")))
    come = F.when(F.isnull("a") | differs, F.struct(F.concat(F.lit("add_"), "noun").alias("verb"), F.lit(None).cast("string").alias("old"), F.col("d.signature").alias("new")))
    found = both.select("tbl", "id", F.explode(F.array_compact(F.array(gone, come))).alias("x"))
    return found.select(*_row(F.col("x.verb"), F.col("id"), F.col("x.old"), F.col("x.new")))


def warned(actual: DataFrame, desired: DataFrame) -> DataFrame:
    """tbl, object, old, new of columns whose computed expression differs, or that are computed on one side only."""
    both = _matched(actual, desired).where("a is not null and d is not null")
    found = both.where(~F.col("a.computed_form").eqNullSafe(F.col("d.computed_form")))
    return found.select("tbl", F.col("col").alias("object"), F.col("a.computed").alias("old"), F.col("d.computed").alias("new"))


#: Schemas that hold no tables of the user's.
HIDDEN = ("information_schema",)


def schemas(actual: Catalog, desired: Catalog, default: str = "default", only: Callable[[str, str], bool] | None = None) -> list[str | None]:
    """The schemas that are compared: all that either side has tables in, the default one as None; ``only("schema", name)`` leaves some out."""
    names = {t.schema if t.schema != default else None for c in (actual, desired) for t in c.tables}
    asked = [n for n in names if n not in HIDDEN and (only is None or n is None or only("schema", n))]
    return sorted(asked, key=lambda n: n or "")


def _normal(catalog: Catalog, default: str) -> Catalog:
    return Catalog(tuple(replace(t, schema=None) if t.schema == default else t for t in catalog.tables if t.schema not in HIDDEN))


@dataclass(frozen=True)
class Frames:
    """A catalog as DataFrames: columns and objects as above, tables (tbl, comment)."""

    columns: DataFrame
    objects: DataFrame
    tables: DataFrame


def frames_of(spark: SparkSession, catalog: Catalog, forms: Mapping, conditions: bool = False) -> Frames:
    tables = spark.createDataFrame([(t.key, t.comment or None) for t in catalog.tables], "tbl string, comment string")
    return Frames(columns_of(spark, catalog, forms), objects_of(spark, catalog, forms, conditions), tables)


def compare(
    spark: SparkSession, actual: Catalog, desired: Catalog, *, only: Callable[[str, str], bool] | None = None, default_schema: str = "default",
    compare_conditions: bool = False, **options,
) -> DataFrame:
    """The whole diff, of what ``only`` lets through. Objects of tables that are added or removed as a whole are not listed.

    Tables are matched by schema and name; those of the default schema may name it or not.
    """
    actual, desired = _normal(actual, default_schema), _normal(desired, default_schema)
    if only is not None:
        actual, desired = filtered(actual, only), filtered(desired, only)
    forms = Forms.of(spark, actual, desired)
    return compared(*(frames_of(spark, c, forms, compare_conditions) for c in (actual, desired)), **options)


def compared(actual: Frames, desired: Frames, **options) -> DataFrame:
    changed = tables(actual.tables, desired.tables)
    found = comments(actual.tables, desired.tables).unionByName(objects(actual.objects, desired.objects)).join(changed.select("tbl"), "tbl", "left_anti")
    return changed.unionByName(columns(actual.columns, desired.columns, **options)).unionByName(found)


def compare_live(db, desired: Catalog, database: str | None = None, *, only: str | None = None, compare_conditions: bool = False, **options) -> DataFrame:
    """The diff of a database as it is: however many tables it has, its definitions come from one statement and stay DataFrames.

    Only expressions are looked at on the driver. ``only``: SQL over tbl, for tables that are compared; ``database`` is the tables' schema.
    """
    spark = db.spark
    desired = _normal(desired, database or "default")
    columns, found = settle(db.definitions(database)), settle(stored(db._listed(database)))
    if only is not None:
        keep = F.expr(only.replace("tbl", "table_name"))
        columns, found = columns.where(keep), found.where(keep)
        names = {r[0] for r in spark.createDataFrame([(t.key,) for t in desired.tables], "tbl string").where(only).collect()}
        desired = Catalog(tuple(t for t in desired.tables if t.key in names))
    texts = found.select("table_name", F.explode(F.concat(
        F.coalesce(F.flatten("o.indexes.columns"), F.array().cast("array<string>")), F.coalesce("o.constraints.condition", F.array().cast("array<string>")),
    )).alias("text")).unionAll(columns.select("table_name", F.explode(F.array("default", "computed"))))
    texts = [tuple(r) for r in texts.where("text is not null").distinct().collect()]
    wide = {k for k, _ in texts} | {t.key for t in desired.tables if any(c.default or c.computed for c in t.columns) or t.indexes or t.constraints}
    typed: dict[str, dict[str, str]] = {}
    for r in columns.where(F.col("table_name").isin(sorted(wide))).select("table_name", "name", "type").collect():
        typed.setdefault(r[0], {})[r[1].lower()] = r[2]
    have = Catalog(tuple(
        Table(k, tuple(Column(c, kind) for c, kind in own.items()), tuple(Constraint("", "check", condition=x) for key, x in texts if key == k)) for k, own in typed.items()
    ))
    forms = Forms.of(spark, have, desired)
    listed = spark.createDataFrame([(k, x, forms[k, x]) for k, x in texts], "tbl string, text string, form string")
    by_table = listed.groupBy("tbl").agg(F.map_from_entries(F.collect_list(F.struct("text", "form"))).alias("forms"))
    actual = _live(columns.withColumnRenamed("table_name", "tbl"), found.withColumnRenamed("table_name", "tbl"), by_table, compare_conditions)
    return compared(actual, frames_of(spark, desired, forms, compare_conditions), **options)


def _live(columns: DataFrame, found: DataFrame, forms: DataFrame, conditions: bool) -> Frames:
    """A listing's definitions in the form of ``frames_of``."""
    form = lambda x: F.coalesce(F.try_element_at("forms", x), x)
    i = F.col("identity")
    identity = F.when(i.isNotNull(), F.concat(F.lit("start "), i["start"], F.lit(" step "), i["step"], F.when(i["always"], " always").otherwise("")))
    own = columns.join(forms, "tbl", "left").select(
        "tbl", F.col("name").alias("col"), "type", "nullable", "default", "comment", "computed", identity.alias("identity"),
        form(F.col("default")).alias("default_form"), form(F.col("computed")).alias("computed_form"),
    )
    held = found.join(forms, "tbl", "left")
    c, x = F.col("c"), F.explode("o.constraints").alias("c")
    options = F.transform(F.filter(c["options"], lambda p: F.lower(p[1]) != "no action"), lambda p: F.concat(F.lit(" "), F.lower(p[0]), F.lit(" "), F.lower(p[1])))
    parent, keys = F.get_json_object(c["refers"], "$[0]"), F.from_json(F.get_json_object(c["refers"], "$[1]"), "array<string>")
    foreign = F.concat(F.array_join(c["columns"], ","), F.lit("->"), parent, F.lit("("), F.array_join(keys, ","), F.lit(")"), F.array_join(F.array_sort(options), ""))
    signature = (
        F.when(c["kind"] == "unique", F.array_join(F.array_sort(c["columns"]), ",")).when(c["kind"] == "foreign", foreign)
        .when(c["kind"] == "check", form(c["condition"]) if conditions else c["name"])
    )
    constraints = held.select("tbl", "forms", x).where(c["kind"].isin("unique", "foreign", "check")).select("tbl", "c.kind", "c.name", signature.alias("signature"))
    indexes = held.select("tbl", "forms", F.explode("o.indexes").alias("i")).select(
        "tbl", F.lit("index").alias("kind"), "i.name",
        F.concat(F.initcap(F.col("i.unique").cast("string")), F.lit(":"), F.array_join(F.transform("i.columns", form), ",")).alias("signature"),
    )
    tables = columns.groupBy("tbl").agg(F.first("table_comment").alias("comment"))
    return Frames(own, constraints.unionAll(indexes), tables)
