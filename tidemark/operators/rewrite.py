"""Column changes of one table, folded into a single projection.

A table of the session catalog can't drop, rename, retype or reorder columns in place, so a group of
changes becomes one ``select`` over the old rows: Catalyst prunes what is not carried over, and there
is no shuffle however many changes there are. Values are kept as SQL texts, so that the same rewrite runs as a
DataFrame and can be written as a statement.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.casts import lenient, stored_as
from ..functions.names import references, renamed
from ..spec import Column, Table


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass
class Rewrite:
    """The new columns in order, each with its value over the old row, as SQL.

    Methods return self, so that changes chain. Names are those at that point of the chain; they are found without
    case, as Spark does. Computed columns are expressions over the new row: they follow renamed inputs and are computed
    again, in the same projection, where an input's values change.
    """

    table: Table
    columns: dict[str, Column] = field(init=False)
    values: dict[str, str] = field(init=False)
    after: list[tuple[str, str]] = field(default_factory=list)
    changed: set[str] = field(default_factory=set)

    def __post_init__(self):
        self.columns = {c.name: c for c in self.table.columns}
        self.values = {c.name: quoted(c.name) for c in self.table.columns}

    def find(self, name: str) -> str | None:
        """The column's name as it is spelled, None if there is none."""
        return name if name in self.columns else next((c for c in self.columns if c.lower() == name.lower()), None)

    def _has(self, name: str) -> str:
        found = self.find(name)
        if found is None:
            raise KeyError(f"table {self.table.name} has no column {name}")
        return found

    def add(
        self, column: Column, *, before: str | None = None, behind: str | None = None, fill: str | None = None, strict: bool = True
    ) -> Rewrite:
        """Old rows get ``fill`` (SQL over the old row), else the default, else null; not ``strict``: nulls are looked for when it runs."""
        if self.find(column.name):
            raise ValueError(f"column {column.name} is there already")
        value = fill if fill is not None else column.default
        if column.computed is not None and value is not None:
            raise ValueError(f"column {column.name} is computed and has no values or default of its own")
        if strict and value is None and not column.nullable and column.computed is None and column.identity is None:
            raise ValueError(f"column {column.name} may not be null and has no default for the rows there are")
        self.columns[column.name] = column
        self.values[column.name] = f"CAST({value if value is not None else 'NULL'} AS {column.type})"
        self.changed.add(column.name)
        if before:
            before = self._has(before)
            self.after.append((column.name, before))
            place = list(self.columns).index(before)
            if place and list(self.columns)[place - 1] != column.name:
                self.after.append((list(self.columns)[place - 1], column.name))
        if behind:
            behind = self._has(behind)
            self.after.append((behind, column.name))
            names = list(self.columns)
            place = names.index(behind)
            if place + 1 < len(names) and names[place + 1] != column.name:
                self.after.append((column.name, names[place + 1]))
        return self

    def drop(self, name: str) -> Rewrite:
        name = self._has(name)
        if users := [c.name for c in self.columns.values() if c.name != name and name in self._inputs(c)]:
            raise ValueError(f"column {name} is an input of the computed column {users[0]}")
        del self.columns[name], self.values[name]
        self.after = [p for p in self.after if name not in p]
        self.changed.discard(name)
        return self

    def rename(self, name: str, new: str) -> Rewrite:
        name = self._has(name)
        if self.find(new) not in (None, name):
            raise ValueError(f"column {new} is there already")
        swap = lambda n: new if n == name else n
        follow = lambda c: replace(c, computed=c.computed and renamed(c.computed, {name: new}))
        self.columns = {swap(k): follow(replace(c, name=swap(k))) for k, c in self.columns.items()}
        self.values = {swap(k): v for k, v in self.values.items()}
        self.after = [(swap(a), swap(b)) for a, b in self.after]
        self.changed = set(map(swap, self.changed))
        return self

    def retype(self, name: str, kind: str, *, using: str | None = None, mode: str = "strict") -> Rewrite:
        """mode: strict (errors on bad values), try (null for them), prefix (numeric prefix, else 0)."""
        name = self._has(name)
        old = self.columns[name]
        if old.computed is not None and (using is not None or mode != "strict"):
            raise ValueError(f"column {name} is computed, its values come from its expression")
        value = f"({using})" if using is not None else self.values[name]
        if mode == "prefix":
            value = lenient(value, kind)
        elif mode == "try":
            value = f"try_cast({value} AS {kind})"
        elif using is not None or old.type != kind:
            value = f"CAST({value} AS {kind})"
        self.columns[name], self.values[name] = replace(old, type=kind), value
        self.changed.add(name)
        return self

    def alter(self, name: str, *, nullable: bool | None = None, default=..., comment=..., fill: str | None = None) -> Rewrite:
        """Attributes of a column; ``fill`` replaces nulls, for a column that may no longer have them."""
        name = self._has(name)
        old = self.columns[name]
        if old.computed is not None and (fill is not None or default not in (..., None)):
            raise ValueError(f"column {name} is computed; its expression can't be changed, drop the column and add it again")
        if nullable is not None:
            old = replace(old, nullable=nullable)
        if default is not ...:
            old = replace(old, default=default)
        if comment is not ...:
            old = replace(old, comment=comment)
        if fill is not None:
            self.values[name] = f"coalesce({self.values[name]}, CAST({fill} AS {old.type}))"
            self.changed.add(name)
        self.columns[name] = old
        return self

    def reorder(self, *names: str) -> Rewrite:
        """These columns follow one another in this order; the rest keep their places as far as can be."""
        names = [self._has(n) for n in names]
        self.after += list(zip(names, names[1:]))
        return self

    def order(self) -> list[str]:
        """Names as they came, each preceded by those that ``after`` puts before it."""
        out: list[str] = []

        def place(name: str, waiting: tuple[str, ...]) -> None:
            if name in waiting:
                raise ValueError(f"contradictory column order: {' before '.join((*waiting, name))}")
            for a, b in self.after:
                if b == name and a not in out:
                    place(a, (*waiting, name))
            if name not in out:
                out.append(name)

        for name in self.columns:
            place(name, ())
        return out

    def result(self) -> Table:
        """The new table: constraints and indexes on dropped columns go, those on renamed ones stay with them."""
        return self.table.with_columns(self.columns[n] for n in self.order())

    def _inputs(self, c: Column) -> set[str]:
        return references(c.computed, self.columns) if c.computed is not None else set()

    def fresh(self) -> set[str]:
        """Columns whose values are not simply those of the old row, computed ones whose inputs are such included."""
        out = set(self.changed)
        for level in computed_levels(self.columns.values()):
            out |= {c.name for c in level if self._inputs(c) & out}
        return out

    def layers(self) -> list[list[tuple[str, str]]]:
        """Selects, one over the other: (name, SQL) of the old row's values, then of computed columns by their depth, at last in order."""
        fresh = self.fresh()
        levels = [[c for c in level if c.name in fresh] for level in computed_levels(self.columns.values())]
        late = {c.name for level in levels for c in level}
        have = [n for n in self.order() if n not in late]
        out = [[(n, self.values[n]) for n in have]]
        for level in filter(None, levels):
            out.append([(n, quoted(n)) for n in have] + [(c.name, f"CAST({c.computed} AS {c.type})") for c in level])
            have = [n for n, _ in out[-1]]
        if have != self.order():
            out.append([(n, quoted(n)) for n in self.order()])
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        """The new rows. Works on a batch and on a stream alike."""
        *inner, last = self.layers()
        for layer in inner:
            df = df.select(*(F.expr(v).alias(n) for n, v in layer))
        return df.select(*(F.expr(v).alias(n, metadata=self.columns[n].field().metadata) for n, v in last))

    def sql(self, source: str) -> str:
        """The new rows as a query over ``source``."""
        for layer in self.layers():
            source = f"(SELECT {', '.join(v if v == quoted(n) else f'{v} AS {quoted(n)}' for n, v in layer)} FROM {source})"
        return source[1:-1]


def computed_levels(columns) -> list[list[Column]]:
    """Computed columns by depth: each level's inputs are stored columns and levels before; an error where they go round."""
    columns = list(columns)
    names = [c.name for c in columns]
    waiting, out = {c.name: c for c in columns if c.computed is not None}, []
    while waiting:
        level = [c for c in waiting.values() if not references(c.computed, names) & set(waiting)]
        if not level:
            raise ValueError(f"computed columns depend on one another: {', '.join(sorted(waiting))}")
        out.append(level)
        for c in level:
            del waiting[c.name]
    return out


def with_computed(columns, df: DataFrame) -> DataFrame:
    """``df`` with the computed ones of ``columns``."""
    for level in computed_levels(columns):
        df = df.withColumns({c.name: stored_as(F.expr(c.computed), c.type) for c in level})
    return df
