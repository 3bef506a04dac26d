from __future__ import annotations

import pytest

from tidemark.operators import ops
from tidemark.plans.diff import compare
from tidemark.plans.migrate import by_reference, changes
from tidemark.queries import declared
from tidemark.sources.catalog import Database
from tidemark.spec import Catalog, Column, Constraint, Index, Table


def test_tables_after_what_they_refer_to():
    def table(name, *parents):
        return Table(name, (Column("k", "int"),), tuple(Constraint(f"fk_{p}", "foreign", ("k",), (p, ("k",))) for p in parents))

    assert [t.name for t in by_reference([table("a", "c"), table("b", "a"), table("c", "c")])] == ["c", "a", "b"]
    assert [t.name for t in by_reference([table("a", "b"), table("b", "a")])] == ["a", "b"]


def test_plan_of_the_fixture(spark):
    actual, desired = declared(spark, "/root/testdata/sf0.001")
    plan = changes(spark, actual, desired, compare_defaults=True)
    assert [type(o).__name__ for o in plan] == [
        "CreateTable", "DropIndex", "Batch", "AddConstraint", "TableComment", "DropConstraint", "AddConstraint", "TableComment", "DropTable",
    ]
    back = ops.reversed_all(plan)
    assert isinstance(back[0], ops.CreateTable) and isinstance(back[-1], ops.DropTable)
    assert changes(spark, actual, actual) == []


def test_plan_carried_out(spark):
    names = ("mig_parent", "mig_child", "mig_new")
    for n in names:
        spark.sql(f"DROP TABLE IF EXISTS {n}")
    db = Database(spark)
    parent = Table("mig_parent", (Column("k", "int"), Column("gone", "string"), Column("n", "int")), indexes=(Index("ix_n", ("n",)),))
    child = Table("mig_child", (Column("id", "int"), Column("p", "int")))
    db.run(ops.CreateTable(parent), ops.CreateTable(child))
    db.run(ops.BulkInsert(parent, ({"k": 1, "gone": "x", "n": 3},)), ops.BulkInsert(child, ({"id": 1, "p": 1},)))
    desired = Catalog((
        Table("mig_parent", (Column("k", "int", False), Column("n", "bigint"), Column("status", "string", False, "'new'"))),
        Table("mig_child", child.columns, (Constraint("fk_p", "foreign", ("p",), ("mig_parent", ("k",))),)),
        Table("mig_new", (Column("id", "int"),)),
    ))
    actual = Catalog(tuple(db.reflect(n) for n in names[:2]))
    db.run(*changes(spark, actual, desired))
    assert compare(spark, Catalog(tuple(db.reflect(n) for n in names)), desired).count() == 0
    assert [tuple(r) for r in spark.table("mig_parent").collect()] == [(1, 3, "new")]
    for n in names:
        spark.sql(f"DROP TABLE {n}")


def test_expressions_are_compared_as_they_are_read(spark):
    from tidemark.functions.expressions import canonical

    columns = {"a": "int", "B": "string", "c": "int"}
    form = canonical(spark, columns, [
        "a + c", "C + `a`", "(c)+(A)", "a - c", "c - a", "lower(b)", "LOWER( `B` )", "upper(b)", "a > 1 AND c = 2", "2 = c and (1 < a)", "nothing + 1", "'x'", "('x')", "'X'",
    ])
    same = [("a + c", "C + `a`"), ("a + c", "(c)+(A)"), ("lower(b)", "LOWER( `B` )"), ("a > 1 AND c = 2", "2 = c and (1 < a)"), ("'x'", "('x')")]
    other = [("a - c", "c - a"), ("lower(b)", "upper(b)"), ("'x'", "'X'"), ("a + c", "nothing + 1")]
    assert all(form[x] == form[y] for x, y in same) and all(form[x] != form[y] for x, y in other)


def test_diff_of_expressions_identities_and_schemas(spark):
    import warnings

    from tidemark.operators import ops
    from tidemark.plans import diff
    from tidemark.plans.migrate import changes
    from tidemark.spec import Catalog, Column, Constraint, Identity, Index, Table

    def table(index, default, condition, computed, identity, nullable=True, **more):
        columns = (Column("id", "bigint", nullable, identity=identity), Column("a", "int", True, default), Column("b", "int", computed=computed))
        return Table("t", columns, (Constraint("ck", "check", condition=condition),), (Index("ix", (index, "a")),), **more)

    old = table("a + b", "1 + 2", "a > 0 AND b > 0", "a * 2", Identity(1, 1))
    same = table("B + a", "(2 + 1)", "(b > 0) and 0 < a", "2 * a", Identity(1, 1, order="a"), False, schema="default")
    pairs = lambda *t: (Catalog(t[:1]), Catalog(t[1:]))
    assert diff.compare(spark, *pairs(old, same), compare_defaults=True, compare_conditions=True).collect() == []
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        assert changes(spark, *pairs(old, same)) == []
    new = table("a - b", "4", "a > 1 AND b > 0", "a * 3", Identity(5, 1))
    found = {(r.kind, r.object) for r in diff.compare(spark, *pairs(old, new), compare_defaults=True, compare_conditions=True).collect()}
    assert found == {("remove_index", "ix"), ("add_index", "ix"), ("modify_default", "a"), ("modify_default", "id"), ("remove_constraint", "ck"), ("add_constraint", "ck")}
    with pytest.warns(UserWarning, match="t.b: computed as a \\* 2"):
        todo = changes(spark, *pairs(old, new))
    assert [type(o) for o in todo] == [ops.DropIndex, ops.Batch, ops.CreateIndex]
    assert todo[1].changes[0].identity == Identity(5, 1) and todo[1].changes[0].reverse().identity == Identity(1, 1)
    other = Table("t", (), schema="own"), Table("v", (), schema="information_schema")
    assert diff.schemas(Catalog((same,)), Catalog(other)) == [None, "own"]
    assert diff.schemas(Catalog((same,)), Catalog(other), only=lambda kind, name: name != "own") == [None]


def test_live_diff_takes_the_same_statements_for_any_number_of_tables(spark):
    from pyspark.sql import SparkSession

    from tidemark.operators import ops
    from tidemark.plans import diff
    from tidemark.sources.catalog import Database
    from tidemark.spec import Catalog, Column, Constraint, Identity, Index, Table

    db = Database(spark)
    spark.sql("CREATE DATABASE IF NOT EXISTS live")
    try:
        def table(n, **more):
            return Table(f"t{n}", (
                Column("id", "bigint", False, identity=Identity()), Column("v", "varchar(5)", True, "'a'", "text; it's"), Column("w", "decimal(9,2)"),
                Column("x", "array<struct<a:int,b:string>>"), Column("c", "int", computed="length(v)"),
            ), (Constraint("ck", "check", condition="w > 0 AND v <> 'x]'"), Constraint("uq", "unique", ("v", "id")),
                Constraint("fk", "foreign", ("id",), ("live.t0", ("id",)), options=(("ON DELETE", "CASCADE"), ("ON UPDATE", "NO ACTION")))),
                (Index("ix", ("lower(v)", "id"), True),), comment="one", schema="live", **more)

        def diffed(n, desired):
            seen = []
            with pytest.MonkeyPatch.context() as m:
                real = SparkSession.sql
                m.setattr(SparkSession, "sql", lambda self, q, *a, **k: (seen.append(q), real(self, q, *a, **k))[1])
                return [tuple(r) for r in diff.compare_live(db, desired, "live", compare_defaults=True, compare_conditions=True).collect()], len(seen)

        for n in range(2):
            db.run(ops.CreateTable(table(n)))
        desired = Catalog(tuple(table(n) for n in range(5)))
        rows, few = diffed(2, desired)
        assert sorted((r[0], r[1]) for r in rows) == [("add_table", f"t{n}") for n in (2, 3, 4)]
        for n in range(2, 5):
            db.run(ops.CreateTable(table(n)))
        rows, many = diffed(5, desired)
        assert rows == [] and few == many <= 2  # where the reference's figures for five tables are 12 and more
        spark.sql("CREATE TABLE live.other (a INT, b DECIMAL(3,1)) USING parquet COMMENT 'plain'")
        plain = Table("other", (Column("a", "bigint"), Column("b", "decimal(3,1)", False)), schema="live")
        changed = Catalog((*desired.tables[:3], plain, Table("t3", (*desired.tables[3].columns, Column("new", "int")), (), (Index("ix", ("id", "lower(v)"), True),), "two", "live")))
        got = {r[:3] for r in diffed(6, changed)[0]}
        assert got == {
            ("remove_table", "t4", None), ("modify_type", "other", "a"), ("modify_nullable", "other", "b"), ("remove_table_comment", "other", None),
            ("add_column", "t3", "new"), ("remove_constraint", "t3", "ck"), ("remove_constraint", "t3", "uq"), ("add_table_comment", "t3", None),
            ("remove_fk", "t3", "id->live.t0(id) on delete cascade"), ("remove_index", "t3", "ix"), ("add_index", "t3", "ix"),
        }
        assert [r[1] for r in map(tuple, diff.compare_live(db, desired, "live", only="tbl = 't4' or tbl = 'other'").collect())] == ["other"]
    finally:
        spark.sql("DROP DATABASE live CASCADE")
