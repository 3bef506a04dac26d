"""What a table's constraints say of new rows, without validating the old ones again.

Only the new rows are aggregated. Of what is there already, the rows with the new rows' keys are looked up: the
scan is narrowed by the keys themselves where they are few, else by their range, which reaches the files' statistics;
then a semi-join with the new keys as the smaller side, which Spark broadcasts if it knows it to be small. Old rows are
never grouped. Checks and nulls are expressions over the new rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import references
from ..spec import Constraint, Table
from .rewrite import quoted
from .validate import exclude_violations

#: So many different keys are looked for one by one; more, by their range.
FEW = 256

_ORDERED = ("byte", "short", "integer", "long", "decimal", "string", "date", "timestamp", "timestamp_ntz", "varchar", "char")


def uses(c: Constraint, t: Table) -> set[str]:
    """Columns of ``t`` that a constraint of it depends on."""
    names = [x.name for x in t.columns]
    parts = [x for e, _ in c.elements for x in ((e,) if isinstance(e, str) else e)]
    texts = [*parts, *(x for x in (c.condition, c.where) if x)]
    return reduce(set.union, (references(x, names) for x in texts), {t.column(n).name for n in c.columns if n})


def demands(t: Table) -> list[Constraint]:
    """All that rows of ``t`` have to keep: its constraints, and its unique indexes as such."""
    return [*t.constraints, *(i.constraint(t) for i in t.indexes if i.unique)]


def keys_of(c: Constraint) -> list[str]:
    """The SQL of a key's parts."""
    return [e for e, _ in c.elements] if c.elements else [quoted(n) for n in c.columns]


def near(there: DataFrame, columns: list[str], keys: DataFrame) -> DataFrame:
    """Rows of ``there`` whose ``columns`` may be among ``keys`` (same number of columns, without nulls), by filters that scans understand."""
    sample = keys.limit(FEW + 1).collect()
    if not sample:
        return there.where("false")
    able = [i for i, f in enumerate(keys.schema.fields) if f.dataType.typeName().split("(")[0] in _ORDERED]
    if len(sample) <= FEW:
        tests = [F.expr(columns[i]).isin(sorted({r[i] for r in sample})) for i in able]
    else:
        bounds = keys.agg(*(f(F.col(f"`{keys.columns[i]}`")).alias(f"{f.__name__}{i}") for i in able for f in (F.min, F.max))).first() if able else ()
        tests = [F.expr(columns[i]).between(*(F.lit(x) for x in bounds[2 * n : 2 * n + 2])) for n, i in enumerate(able)]
    return there.where(reduce(and_, tests)) if tests else there


def found(there: DataFrame, columns: list[str], keys: DataFrame) -> DataFrame:
    """Those of ``keys`` that ``there`` has."""
    own = near(there, columns, keys).select(*(F.expr(c).alias(n) for c, n in zip(columns, keys.columns)))
    # the new keys are the side that may be broadcast, the old rows stream past them
    return own.join(keys, keys.columns, "left_semi").distinct()


def _null(exprs: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.expr(e).isNull() for e in exprs))


def judged(rows: DataFrame, t: Table, data: Mapping[str, DataFrame], only: set[str] | None = None) -> DataFrame:
    """``rows`` with ``_refused``: the sorted names of what each breaks (columns that may not be null, constraints, unique indexes).

    ``rows`` are new and read more than once, so they have to be settled; ``data`` has the tables as they are without them. ``only``: what
    depends on these columns. Rows of one batch that share a key are all refused; a foreign key to the table itself may refer to a new row.
    """
    asked = [c for c in demands(t) if only is None or uses(c, t) & only]
    strict = [c.name for c in t.columns if not c.nullable and (only is None or c.name in only)]
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    plain = [F.when(F.col(quoted(n)).isNull(), F.lit(f"{t.name}.{n}")) for n in strict]
    plain += [F.when(~F.coalesce(F.expr(c.condition), F.lit(True)), F.lit(c.name)) for c in asked if c.kind == "check"]
    plain += [F.when(_null(keys_of(c)), F.lit(c.name)) for c in asked if c.kind == "primary"]
    bad = []
    for c in asked:
        if c.kind in ("primary", "unique"):
            bad.append(_taken(numbered, c, data[t.key]))
        elif c.kind == "foreign":
            parent = data[c.refers[0]]
            if c.refers[0].lower() == t.key.lower():
                parent = parent.select(*map(quoted, c.refers[1])).unionAll(rows.select(*map(quoted, c.refers[1])))
            bad.append(_orphans(numbered, c, parent))
        elif c.kind == "exclude":
            bad.append(_clashes(numbered, c, data[t.key], [x.name for x in t.columns]))
    inline = F.array_compact(F.array(*plain)) if plain else F.array().cast("array<string>")
    if not bad:
        return numbered.withColumn("_refused", F.array_sort(inline)).drop("_row")
    marks = reduce(DataFrame.unionAll, bad).groupBy("_row").agg(F.collect_set("_name").alias("_names"))  # one name a constraint at most
    both = F.array_sort(F.array_union(inline, F.coalesce("_names", F.array().cast("array<string>"))))
    return numbered.join(marks, "_row", "left").withColumn("_refused", both).drop("_row", "_names")


def _named(rows: DataFrame, c: Constraint) -> DataFrame:
    return rows.select("_row", F.lit(c.name).alias("_name"))


def _keyed(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    names = [f"_k{i}" for i in range(len(columns))]
    return rows.where(~_null(columns)).select("_row", *(F.expr(c).alias(n) for c, n in zip(columns, names))), names


def _taken(rows: DataFrame, c: Constraint, there: DataFrame) -> DataFrame:
    own, names = _keyed(rows, keys_of(c))
    counts = own.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    twice = counts.where("_n > 1").select(*names)
    return _named(own.join(twice.unionAll(found(there, keys_of(c), counts.select(*names))).distinct(), names, "left_semi"), c)


def _orphans(rows: DataFrame, c: Constraint, parent: DataFrame) -> DataFrame:
    own, names = _keyed(rows, [quoted(n) for n in c.columns])
    known = found(parent, [quoted(n) for n in c.refers[1]], own.select(*names).distinct())
    return _named(own.join(known, names, "left_anti"), c)


def _clashes(rows: DataFrame, c: Constraint, there: DataFrame, columns: list[str]) -> DataFrame:
    """New rows that clash with an old or a new one; rows are their own keys here."""
    own = [quoted(n) for n in columns]
    both = there.select(*own, F.lit(None).cast("bigint").alias("_row")).unionByName(rows.select(*own, "_row"))
    pairs = exclude_violations(both, "_row", c.elements, c.where, fresh="_row is not null")
    return _named(pairs.select(F.explode(F.array("left_key", "right_key")).alias("_row")).where("_row is not null").distinct(), c)
