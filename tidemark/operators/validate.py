"""Constraint validation: what the session catalog can't enforce is checked by queries.

Duplicates and foreign keys are first aggregated by key (partial sums on the map side), so that a hot
key is one row in what follows. Each function returns the violations; ``report`` counts them.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle
from ..spec import Constraint, Table
from .rewrite import quoted


def null_violations(df: DataFrame, columns) -> DataFrame:
    """Rows with a null in one of the columns."""
    return df.where(~reduce(and_, (F.col(quoted(c)).isNotNull() for c in columns)))


def unique_violations(df: DataFrame, columns) -> DataFrame:
    """Keys that occur more than once, with n; keys with a null don't count, as in SQL."""
    whole = reduce(and_, (F.col(quoted(c)).isNotNull() for c in columns))
    return df.where(whole).groupBy(*map(quoted, columns)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def primary_violations(df: DataFrame, columns) -> DataFrame:
    """Keys that occur more than once or have a null, with n."""
    missing = ~reduce(and_, (F.col(quoted(c)).isNotNull() for c in columns))
    return df.groupBy(*map(quoted, columns)).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | missing)


def foreign_violations(child: DataFrame, columns, parent: DataFrame, parent_columns) -> DataFrame:
    """Keys of ``child`` that ``parent`` doesn't have, with n; keys with a null pass."""
    whole = reduce(and_, (F.col(quoted(c)).isNotNull() for c in columns))
    keys = child.where(whole).groupBy(*map(quoted, columns)).agg(F.count(F.lit(1)).alias("n"))
    known = parent.select(*(F.col(quoted(p)).alias(f"_{i}") for i, p in enumerate(parent_columns))).distinct()
    return keys.join(known, reduce(and_, (F.col(quoted(c)) == F.col(f"_{i}") for i, c in enumerate(columns))), "left_anti")


def check_violations(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which the condition is false; unknown passes."""
    return df.where(~F.coalesce(F.expr(condition), F.lit(True)))


def exclude_violations(df: DataFrame, key: str, elements, where: str | None = None, fresh: str | None = None) -> DataFrame:
    """Pairs (left_key, right_key) of rows for which all of the elements' operators hold.

    ``elements`` are (expression, operator): "=", "~n" (numbers closer than n), or "&&" (open intervals that
    overlap; the expression is a pair of expressions or "low, high"). Equalities are join keys, and of the
    others the first becomes one: a number lies in a cell of width n and looks into the cells beside it. An
    interval has a level, its length as a power of two, and lies in the two cells of that width at most that it
    meets. It looks for others of its own level there, and for longer ones in the cells of each longer level
    that there is: so a pair meets in one cell of the longer one's level, or in two at most, and counts in the
    first. Cells only place rows: integers, decimals, dates and times are compared as what they are. Rows are told apart by
    numbers of their own, so that null and repeated keys clash like others. With equalities alone the rows of a
    group are paired with one of them, as one row too many is one violation, not a pair with each.

    Rows with a null in an element clash with none. A constraint of "&&" on empty intervals never fails.
    ``fresh``: SQL that holds for new rows; then pairs of old rows are not looked for.
    """
    own = df if where is None else df.where(where)
    fields, keys, rest, cell = [F.col(quoted(key)).alias("key")], [], [], None
    for i, (text, operator) in enumerate(elements):
        if operator == "=":
            fields.append(F.expr(text).alias(f"e{i}"))
            keys.append(f"e{i}")
        elif operator.startswith("~"):
            width = operator[1:].strip()
            fields.append(F.expr(text).alias(f"e{i}"))
            rest.append(lambda i=i, width=width: F.abs(F.col(f"l.e{i}") - F.col(f"r.e{i}")) <= F.expr(width))
            if cell is None and float(width) > 0:
                cell = ("near", i, float(width))
        elif operator == "&&":
            low, high = text.rsplit(",", 1) if isinstance(text, str) else text
            fields += [F.expr(low).alias(f"low{i}"), F.expr(high).alias(f"high{i}")]
            rest.append(lambda i=i: (F.col(f"l.low{i}") < F.col(f"r.high{i}")) & (F.col(f"r.low{i}") < F.col(f"l.high{i}")))
            cell = cell or ("meet", i, None)
        else:
            raise ValueError(f"operator {operator}")
    if not keys and cell is None:
        raise ValueError("an exclusion needs an element to look others up by: =, ~ or &&")
    own = own.select(*fields, (F.lit(True) if fresh is None else F.expr(fresh)).alias("fresh"), F.monotonically_increasing_id().alias("row"))
    whole = [F.col(c).isNotNull() for c in own.columns if c not in ("key", "fresh", "row")]
    if cell and cell[0] == "meet":
        whole.append(F.col(f"low{cell[1]}") < F.col(f"high{cell[1]}"))
    own = own.where(reduce(and_, whole))
    own = settle(own)  # so that a row has one number on both sides
    if not rest:
        return _surplus(own, keys)
    if cell is None:  # "~0" beside equalities
        left = right = own.withColumns({"level": F.lit(0), "cell": F.lit(0)})
    elif cell[0] == "near":
        at = F.floor(F.col(f"e{cell[1]}").cast("double") / cell[2])
        left = own.withColumns({"level": F.lit(0), "cell": at})
        right = own.withColumn("level", F.lit(0)).withColumn("cell", F.explode(F.array(at - 1, at, at + 1)))
    else:
        left, right = _leveled(own, f"low{cell[1]}", f"high{cell[1]}")
    if cell and cell[0] == "near" or cell is None:
        left, right = left.withColumn("first", F.lit(0)), right.withColumns({"first": F.lit(0), "own": F.lit(0)})
        apart = F.col("l.row") < F.col("r.row")
    else:  # of two of one level each would find the other
        apart = (F.col("r.own") < F.col("l.level")) | (F.col("l.row") < F.col("r.row"))
        apart = apart & (F.col("l.row") != F.col("r.row")) & (F.col("l.cell") == F.greatest("l.first", "r.first"))
    same = reduce(and_, (F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, "level", "cell"]))
    hit = same & reduce(and_, (r() for r in rest)) & apart
    a, b = F.col("l.key"), F.col("r.key")
    ordered = a.isNull() | (a <= b)
    pair = F.when(ordered, a).otherwise(b).alias("left_key"), F.when(ordered, b).otherwise(a).alias("right_key")

    def pairs(some, others):
        return some.alias("l").join(others.alias("r"), hit).select(*pair)

    if fresh is None:
        return pairs(left, right)
    return pairs(left.where("fresh"), right).unionAll(pairs(left.where("not fresh"), right.where("fresh")))


def _surplus(own: DataFrame, keys: list[str]) -> DataFrame:
    """Each row of a group but one, an old one if there is any, with that one."""
    first = own.groupBy(*keys).agg(F.min(F.struct(F.col("fresh"), F.col("row"), F.col("key"))).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    others = own.join(first, keys).where((F.col("row") != F.col("first.row")) & F.col("fresh"))
    a, b = F.col("first.key"), F.col("key")
    ordered = a.isNull() | (a <= b)
    return others.select(F.when(ordered, a).otherwise(b).alias("left_key"), F.when(ordered, b).otherwise(a).alias("right_key"))


def _leveled(own: DataFrame, low: str, high: str) -> tuple[DataFrame, DataFrame]:
    """Rows in the cells of their own level; and in those of their own and of each longer level that there is.

    Whole numbers are halved by shifts, which are exact at any size. A type that no long can hold goes by a
    scaled-down number that grows with it, which may place a row in a cell more than it meets, never in one less.
    """
    kind = own.schema[low].dataType
    name = kind.typeName()

    def whole(c):
        if name.startswith("timestamp"):
            return F.unix_micros(F.col(c).cast("timestamp"))
        if name == "date":
            return F.unix_date(c).cast("bigint")
        if name == "decimal" and kind.precision > 18:
            return F.floor(F.col(c).cast("double") * 10.0 ** (17 - kind.precision + kind.scale)).cast("bigint")
        return (F.col(c) * 10**kind.scale if name == "decimal" else F.col(c)).cast("bigint")

    if name in ("double", "float"):
        placed = own.withColumns({"_low": F.col(low).cast("double"), "_high": F.col(high).cast("double")})
        level = F.ceil(F.log2(F.col("_high") - F.col("_low"))).cast("int")
        size = lambda n: F.pow(F.lit(2.0), n)
        first, last = lambda n: F.floor(F.col("_low") / size(n)), lambda n: F.ceil(F.col("_high") / size(n)) - 1
    else:
        more = 1 if name == "decimal" and kind.precision > 18 else 0
        placed = own.withColumns({"_low": whole(low), "_high": whole(high) + more})
        bits = F.length(F.bin(F.col("_high") - F.col("_low") - 1))
        span = F.try_subtract("_high", "_low")
        level = F.when(span.isNull(), 63).when(span <= 1, 0).otherwise(F.least(bits, F.lit(63))).cast("int")
        half = lambda c, n: F.call_function("shiftright", c, n)
        first, last = lambda n: half(F.col("_low"), n), lambda n: half(F.col("_high") - 1, n)
    placed = placed.withColumn("level", level)
    levels = sorted(r[0] for r in placed.select("level").distinct().collect())  # lengths that are powers of two: some tens
    side = F.array(*(F.lit(n) for n in levels)) if levels else F.array().cast("array<int>")

    def cells(n):
        return F.transform(F.sequence(first(n), last(n)), lambda c: F.struct(n.alias("level"), c.alias("cell"), first(n).alias("first")))

    left = placed.withColumn("at", F.explode(cells(F.col("level")))).withColumns({"cell": F.col("at.cell"), "first": F.col("at.first")})
    longer = F.filter(side, lambda n: n >= F.col("level"))
    right = placed.withColumn("at", F.explode(F.flatten(F.transform(longer, cells)))).withColumns(
        {"own": F.col("level"), "level": F.col("at.level"), "cell": F.col("at.cell"), "first": F.col("at.first")}
    )
    return left, right


def violations(constraint: Constraint, table: Table, data: Mapping[str, DataFrame]) -> DataFrame:
    df = data[table.key]
    if constraint.kind == "primary":
        return primary_violations(df, constraint.columns)
    if constraint.kind == "unique" and constraint.elements:
        names = [f"key{i}" for i in range(len(constraint.elements))]
        return unique_violations(df.select(*(F.expr(e).alias(n) for n, (e, _) in zip(names, constraint.elements))), names)
    if constraint.kind == "unique":
        return unique_violations(df, constraint.columns)
    if constraint.kind == "check":
        return check_violations(df, constraint.condition)
    if constraint.kind == "foreign":
        parent, columns = constraint.refers
        return foreign_violations(df, constraint.columns, data[parent], columns)
    if constraint.kind == "exclude":
        return exclude_violations(df, constraint.columns[0], constraint.elements, constraint.where)
    raise ValueError(f"constraint kind {constraint.kind}")


def report(table: Table, data: Mapping[str, DataFrame]) -> DataFrame:
    """name, kind, violations: a row for each constraint and each column that may not be null.

    The null and check counts of the table are one pass; only keys need shuffles of their own.
    """
    df = data[table.key]
    rows = [("not_null", f"{table.name}.{c.name}", F.count_if(F.col(quoted(c.name)).isNull())) for c in table.columns if not c.nullable]
    rows += [
        ("check", c.name, F.count_if(~F.coalesce(F.expr(c.condition), F.lit(True))))
        for c in table.constraints if c.kind == "check"
    ]
    parts = []
    if rows:
        counts = df.agg(*(n.alias(f"n{i}") for i, (_, _, n) in enumerate(rows)))
        pairs = [
            F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.col(f"n{i}").alias("violations"))
            for i, (kind, name, _) in enumerate(rows)
        ]
        parts.append(counts.select(F.explode(F.array(*pairs)).alias("x")).select("x.*"))
    for c in table.constraints:
        if c.kind != "check":
            found = violations(c, table, data)
            parts.append(found.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(c.name).alias("name"), F.lit(c.kind).alias("kind"), "violations"))
    if not parts:
        return df.sparkSession.createDataFrame([], "name string, kind string, violations bigint")
    return reduce(DataFrame.unionAll, parts)
