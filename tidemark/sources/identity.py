"""Numbers of identity columns: gapless in one insert, from a high-water mark that the catalog keeps.

A column's next number is a property of its table. An insert counts its rows by partition, raises the mark by
what it needs, and only then writes: a failed insert leaves a gap, never a number twice. Numbers that rows bring
themselves don't move the mark.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..operators.rewrite import quoted
from ..spec import NEXT, Column, Table
from .scratch import settled


def _number(c: Column, base: int, rank) -> F.Column:
    return (F.lit(base) + (rank - 1) * c.identity.step).cast(c.type)


def allocated(db, t: Table, rows: DataFrame) -> DataFrame:
    """``rows`` of ``t`` with numbers where its identity columns are null."""
    for c in (c for c in t.columns if c.identity):
        marks = dict(t.storage.properties)
        base = int(marks.get(NEXT + c.name, c.identity.start))
        lacking, n = settled(rows.where(F.col(quoted(c.name)).isNull()))
        if not n:
            continue
        order = [F.expr(c.identity.order)] if c.identity.order else []
        db.spark.sql(f"ALTER TABLE {t.key} SET TBLPROPERTIES ('{NEXT}{c.name}' = '{base + n * c.identity.step}')")
        given = numbered(lacking, order, "_rank").withColumn(c.name, _number(c, base, F.col("_rank"))).select(*(quoted(x.name) for x in t.columns))
        rows = given.unionAll(rows.where(F.col(quoted(c.name)).isNotNull()))
    return rows


def backfilled(new: Table, rows: DataFrame, columns: list[Column]) -> tuple[DataFrame, Table]:
    """The rows there are with numbers in new identity columns, by their ``order``; and the table with its marks."""
    names = [c.name for c in new.columns]
    for c in columns:
        rows, n = settled(numbered(rows, [F.expr(c.identity.order)] if c.identity.order else [], "_rank"))
        rows = rows.withColumn(c.name, _number(c, c.identity.start, F.col("_rank"))).select(*map(quoted, names))
        marks = dict(new.storage.properties) | {NEXT + c.name: str(c.identity.start + n * c.identity.step)}
        new = replace(new, storage=replace(new.storage, properties=tuple(sorted(marks.items()))))
    return rows, new
