"""From a schema diff to the operations that carry it out, and back."""

from __future__ import annotations

import warnings
from collections import defaultdict

from pyspark.sql import SparkSession

from ..operators import ops
from ..spec import Catalog, Table
from .diff import Forms, columns_of, compare, foreign_signature, warned


def by_reference(tables: list[Table]) -> list[Table]:
    """Tables after those that their foreign keys refer to, else in order of their names."""
    left, out = {t.key: t for t in sorted(tables, key=lambda t: t.key)}, []
    while left:
        free = [k for k, t in left.items() if not any(c.refers and c.refers[0] in left and c.refers[0] != k for c in t.constraints)]
        for k in free or list(left)[:1]:  # tables that refer to each other come in order of their names
            out.append(left.pop(k))
    return out


def changes(spark: SparkSession, actual: Catalog, desired: Catalog, **options) -> list[ops.Operation]:
    """What makes ``actual`` into ``desired``: tables, then one batch of columns a table, then constraints and indexes.

    The diff's rows are read on the driver: they are as many as there are differences between two schemas. Of computed columns
    whose expression differs it is only warned.
    """
    forms = Forms.of(spark, actual, desired)
    for r in warned(columns_of(spark, actual, forms), columns_of(spark, desired, forms)).collect():
        warnings.warn(f"{r['tbl']}.{r['object']}: computed as {r['old']}, declared as {r['new']}; this can't be changed in place", stacklevel=2)
    rows = defaultdict(list)
    for r in compare(spark, actual, desired, **options).collect():
        rows[r["tbl"]].append(r)
    kinds = {t: {r["kind"] for r in found} for t, found in rows.items()}
    out: list[ops.Operation] = []
    for t in by_reference([desired[k] for k in rows if "add_table" in kinds[k]]):
        out.append(ops.CreateTable(t))  # with its constraints and indexes
    for key in sorted(k for k in rows if not kinds[k] & {"add_table", "remove_table"}):
        out += _altered(actual[key], desired[key], rows[key])
    for t in reversed(by_reference([actual[k] for k in rows if "remove_table" in kinds[k]])):
        out.append(ops.DropTable(t.key, old=t))
    return out


def _altered(old: Table, new: Table, rows) -> list[ops.Operation]:
    columns, before, after, altered = [], [], [], defaultdict(dict)
    for r in sorted(rows, key=lambda r: (r["kind"], r["object"] or "")):
        kind, name = r["kind"], r["object"]
        if kind.endswith("_table_comment"):
            after.append(ops.TableComment(new.key, new.comment, old.comment))
        elif kind == "add_column":
            columns.append(ops.AddColumn(new.key, new.column(name)))
        elif kind == "remove_column":
            columns.append(ops.DropColumn(new.key, name, old=old.column(name)))
        elif kind.startswith("modify_"):
            field = kind.removeprefix("modify_")
            if field == "default" and old.column(name).identity != new.column(name).identity:
                altered[name]["identity"] = new.column(name).identity
                if old.column(name).default == new.column(name).default:
                    continue
            altered[name][field] = getattr(new.column(name), field)
        elif kind.endswith("_index"):
            side, held = (new, after) if kind.startswith("add") else (old, before)
            index = next(i for i in side.indexes if i.name == name)
            held.append(ops.CreateIndex(new.key, index) if side is new else ops.DropIndex(new.key, name, old=index))
        else:
            side, held = (new, after) if kind.startswith("add") else (old, before)
            found = next(c for c in side.constraints if name in (c.name, _signature(c)))
            held.append(ops.AddConstraint(new.key, found) if side is new else ops.DropConstraint(new.key, found.name, old=found))
    columns += [ops.AlterColumn(new.key, n, old=old.column(n), **fields) for n, fields in sorted(altered.items())]
    return [*before, *([ops.Batch(new.key, tuple(columns))] if columns else []), *after]


def _signature(c) -> str | None:
    return foreign_signature(c) if c.refers else None
