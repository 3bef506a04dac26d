from __future__ import annotations

import pytest

from tidemark.operators import ops
from tidemark.operators.rewrite import Rewrite
from tidemark.operators.validate import check_violations, exclude_violations, foreign_violations, primary_violations, report, unique_violations
from tidemark.sources.catalog import Database, ValidationError
from tidemark.spec import Catalog, Column, Constraint, Index, Storage, Table


@pytest.fixture
def foo(spark):
    rows = [(1, "d1", 5), (2, "22", 6), (3, "8.5", 7), (4, "9.46", 8), (5, "d5", 9)]
    return spark.createDataFrame(rows, "id int, data string, x int")


def rewrite(df, **more):
    return Rewrite(Table.of("foo", df, **more))


def test_prefix_cast(foo):
    out = rewrite(foo).retype("data", "int", mode="prefix").apply(foo)
    assert [r.data for r in out.orderBy("id").collect()] == [0, 22, 8, 9, 0]


def test_try_cast_gives_nulls(foo):
    out = rewrite(foo).retype("data", "double", mode="try").apply(foo)
    assert [r.data for r in out.orderBy("id").collect()] == [None, 22.0, 8.5, 9.46, None]


def test_drop_rename_order(foo):
    r = rewrite(foo).drop("data").rename("x", "y").add(Column("z", "string", True, "'q'"), before="y")
    assert r.apply(foo).columns == ["id", "z", "y"]
    assert r.apply(foo).first() == (1, "q", 5)


def test_one_projection(foo):
    r = rewrite(foo).drop("data").rename("x", "y").retype("y", "bigint").add(Column("k", "int", False, "7"))
    plan = r.apply(foo)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") <= 1 and "Exchange" not in plan


def test_contradictory_order(foo):
    with pytest.raises(ValueError, match="contradictory"):
        rewrite(foo).reorder("id", "x").reorder("x", "id").apply(foo)


def test_unknown_and_doubled_columns(foo):
    with pytest.raises(KeyError):
        rewrite(foo).drop("nope")
    with pytest.raises(ValueError):
        rewrite(foo).add(Column("x", "int"))
    with pytest.raises(ValueError, match="no default"):
        rewrite(foo).add(Column("n", "int", False))


def test_empty_table(spark, foo):
    assert rewrite(foo).rename("x", "y").apply(foo.limit(0)).count() == 0


def test_rewrite_of_a_stream(spark, foo, tmp_path):
    from tidemark.streaming import evolve

    foo.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(foo.schema).parquet(str(tmp_path / "in"))
    evolve(stream, rewrite(foo).rename("x", "y").drop("data"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.columns == ["id", "y"] and out.count() == 5


def test_reverse():
    table = Table("t", (Column("a", "int"), Column("b", "string")))
    add = ops.AddColumn("t", Column("c", "int"))
    assert add.reverse() == ops.DropColumn("t", "c", old=Column("c", "int"))
    assert add.reverse().reverse() == add
    assert ops.CreateTable(table).reverse().reverse() == ops.CreateTable(table)
    alter = ops.AlterColumn("t", "b", nullable=False, new_name="bb", old=Column("b", "string"))
    back = alter.reverse()
    assert (back.name, back.new_name, back.nullable) == ("bb", "b", True)
    assert ops.unique("u", "t", ["a"]).reverse().reverse() == ops.unique("u", "t", ["a"])
    assert ops.CreateIndex("t", Index("i", ("a",))).reverse().reverse() == ops.CreateIndex("t", Index("i", ("a",)))
    assert ops.TableComment("t", "x", "y").reverse() == ops.TableComment("t", "y", "x")
    with pytest.raises(ops.Irreversible):
        ops.RenameTable("a", "b").reverse() and ops.Execute("x").reverse()
    with pytest.raises(ops.Irreversible):
        ops.DropColumn("t", "a").reverse()
    batch = ops.Batch("t", (add, ops.RenameTable("t", "u")))
    assert [type(o) for o in batch.reverse().changes] == [ops.RenameTable, ops.DropColumn]


def test_diff_tuples():
    assert ops.AddColumn("t", Column("c", "int")).diff() == ("add_column", "t", "c")
    assert ops.AlterColumn("t", "c", type="int", comment="x").diff() == (("modify_type", "t", "c"), ("modify_comment", "t", "c"))
    assert ops.foreign_key("f", "t", "p", ["a"], ["b"]).diff() == ("add_fk", "t", "f")


def test_spelled():
    table = Table("t", (Column("a", "int", False), Column("b", "string", True, "'x'", "it's")), comment="c")
    text = ops.spelled([
        ops.CreateTable(table), ops.AlterColumn("t", "a", type="bigint", new_name="k"),
        ops.foreign_key("f", "t", "p", ["a"], ["b"], on_delete="CASCADE"), ops.check("ck", "t", "a > 0"),
        ops.BulkInsert(table, ({"a": 1}, {"a": 2, "b": None})), ops.DropTable("t", if_exists=True),
    ])
    assert text.splitlines() == [
        "CREATE TABLE t (`a` int NOT NULL, `b` string DEFAULT 'x' COMMENT 'it\\'s') USING parquet COMMENT 'c';",
        "ALTER TABLE t ALTER COLUMN `a` TYPE bigint;",
        "ALTER TABLE t RENAME COLUMN `a` TO `k`;",
        "ALTER TABLE t ADD CONSTRAINT f FOREIGN KEY (a) REFERENCES p (b) ON DELETE CASCADE;",
        "ALTER TABLE t ADD CONSTRAINT ck CHECK (a > 0);",
        "INSERT INTO t (a) VALUES (1);",
        "INSERT INTO t (a, b) VALUES (2, NULL);",
        "DROP TABLE IF EXISTS t;",
    ]


def test_doubled_declaration():
    t = Table("t", ())
    with pytest.raises(ValueError, match="more than once"):
        Catalog((t,)).merged(Catalog((t,)))


def test_validation_nulls(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (None, 2), (None, 2), (3, None)], "a int, b int")
    assert [tuple(r) for r in unique_violations(df, ["a", "b"]).collect()] == [(1, 1, 2)]
    assert {tuple(r) for r in primary_violations(df, ["a", "b"]).collect()} == {(1, 1, 2), (None, 2, 2), (3, None, 1)}
    assert check_violations(df, "a < 2").count() == 1  # unknown passes
    parent = spark.createDataFrame([(1,), (1,)], "k int")
    assert [tuple(r) for r in foreign_violations(df, ["a"], parent, ["k"]).collect()] == [(3, 1)]


def test_report_of_unconstrained_table(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert report(Table.of("t", df), {"t": df}).count() == 0


@pytest.fixture
def database(spark):
    db = Database(spark)
    for t in ("acct", "acct2", "owner", "owner2", "acct__new"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    yield db
    for t in ("acct", "acct2", "owner", "owner2", "acct__new"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_database_round_trip(spark, database):
    table = Table("acct", (Column("id", "int", False), Column("name", "string", True, "'nobody'"), Column("x", "int")), comment="accounts")
    database.run(
        ops.CreateTable(table),
        ops.BulkInsert(table, ({"id": 1, "x": 5}, {"id": 2, "name": "b", "x": 6}, {"id": 3, "name": None})),
        ops.primary_key("pk", "acct", ["id"]),
        ops.CreateIndex("acct", Index("ix", ("x",))),
    )
    assert {tuple(r) for r in spark.table("acct").collect()} == {(1, "nobody", 5), (2, "b", 6), (3, None, None)}
    assert database.reflect("acct").comment == "accounts"
    with pytest.raises(ValidationError):
        database.run(ops.AlterColumn("acct", "name", nullable=False))
    with pytest.raises(ValidationError):
        database.run(ops.check("ck", "acct", "x > 5"))
    database.run(ops.Batch("acct", (
        ops.AlterColumn("acct", "x", type="bigint", new_name="y"),
        ops.AlterColumn("acct", "name", nullable=False, fill="'none'"),
        ops.AddColumn("acct", Column("z", "int", False, "7"), behind="id"),
    )))
    now = database.reflect("acct")
    assert [c.name for c in now.columns] == ["id", "z", "name", "y"]
    assert now.indexes == (Index("ix", ("y",)),)
    assert [c.name for c in now.columns if not c.nullable] == ["id", "z", "name"]
    assert {tuple(r) for r in spark.table("acct").collect()} == {(1, 7, "nobody", 5), (2, 7, "b", 6), (3, 7, "none", None)}
    database.run(ops.DropColumn("acct", "id"), ops.RenameTable("acct", "acct2"), ops.TableComment("acct2", "new"))
    assert database.reflect("acct2").constraints == () or database.reflect("acct2").constraints[0].columns == ()
    database.run(ops.AddColumn("acct2", Column("w", "string")), ops.Execute("INSERT INTO acct2 VALUES (1, 'n', 2, 'w')"))
    assert spark.table("acct2").count() == 4
    database.run(ops.DropIndex("acct2", "ix"), ops.DropTable("acct2"))
    assert "acct2" not in database.tables()


def test_failed_batch_leaves_the_table(spark, database):
    table = Table("acct", (Column("id", "int"), Column("t", "string")))
    database.run(ops.CreateTable(table), ops.BulkInsert(table, ({"id": 1, "t": "x"},)))
    with pytest.raises(Exception):
        database.run(ops.AlterColumn("acct", "t", type="int"))
    assert spark.table("acct").collect() == [(1, "x")] and "acct__new" not in database.tables()


def test_foreign_key(spark, database):
    owner, acct = Table("owner", (Column("k", "int"),)), Table("acct", (Column("id", "int"), Column("o", "int")))
    database.run(ops.CreateTable(owner), ops.CreateTable(acct))
    database.run(ops.BulkInsert(owner, ({"k": 1},)), ops.BulkInsert(acct, ({"id": 1, "o": 1}, {"id": 2, "o": 2})))
    fk = ops.foreign_key("fk", "acct", "owner", ["o"], ["k"])
    with pytest.raises(ValidationError):
        database.run(fk)
    database.run(ops.BulkInsert(owner, ({"k": 2},)), fk)
    assert database.reflect("acct").constraints == (fk.constraint,)
    database.run(fk.reverse())
    with pytest.raises(KeyError):
        database.run(ops.DropConstraint("acct", "fk"))


def test_rewrite_keeps_storage(spark, database):
    storage = Storage("orc", ("p",), properties=(("note", "x"),))
    table = Table("acct", (Column("p", "string"), Column("a", "int"), Column("b", "varchar(5)", comment="c")), storage=storage)
    database.run(ops.CreateTable(table), ops.Execute("INSERT INTO acct (a, b, p) VALUES (1, 'x', 'u'), (2, 'y', 'v')"))
    database.run(ops.Batch("acct", (ops.AlterColumn("acct", "a", new_name="z", type="bigint"), ops.AlterColumn("acct", "p", new_name="q"))))
    now = database.reflect("acct")
    assert (now.storage.provider, now.storage.partitions, now.storage.properties) == ("orc", ("q",), (("note", "x"),))
    assert [(c.name, c.type) for c in now.columns] == [("z", "bigint"), ("b", "varchar(5)"), ("q", "string")]
    assert {tuple(r) for r in spark.table("acct").collect()} == {(1, "x", "u"), (2, "y", "v")}
    database.run(ops.DropColumn("acct", "q"))
    assert database.reflect("acct").storage.partitions == ()
    spark.sql("DROP TABLE acct")
    spark.sql("CREATE TABLE acct (k INT, v STRING) USING parquet CLUSTERED BY (k) SORTED BY (v) INTO 3 BUCKETS")
    database.run(ops.AlterColumn("acct", "k", new_name="kk"))
    assert database.reflect("acct").storage.buckets == (3, ("kk",), ("v",))


def test_kept_constraints_are_checked_again(spark, database):
    table = Table("acct", (Column("id", "int"), Column("t", "string")))
    database.run(ops.CreateTable(table), ops.BulkInsert(table, ({"id": 1, "t": "1a"}, {"id": 2, "t": "1b"})), ops.unique("uq", "acct", ["t"]))
    with pytest.raises(ValidationError, match="uq"):
        database.run(ops.AlterColumn("acct", "t", type="int", mode="prefix"))
    assert database.reflect("acct").column("t").type == "string" and spark.table("acct").count() == 2
    database.run(ops.DropConstraint("acct", "uq"), ops.check("ck", "acct", "length(t) = 2"))
    with pytest.raises(ValidationError, match="ck"):
        database.run(ops.AlterColumn("acct", "t", type="int", mode="prefix"))
    database.run(ops.CreateIndex("acct", Index("ix", ("id",), True)))
    with pytest.raises(ValidationError, match="ix"):
        database.run(ops.AlterColumn("acct", "id", type="int", using="0"))


def test_checks_follow_columns(spark, database):
    key = ops.exclude("ex", "acct", "id", ("y", "~2"), ("g", "="), where="y > 0")
    table = Table("acct", tuple(Column(c, "int") for c in ("id", "y", "g", "h")))
    database.run(ops.CreateTable(table), ops.BulkInsert(table, ({"id": 1, "y": 1, "g": 1, "h": 1}, {"id": 2, "y": 9, "g": 1, "h": 2})))
    database.run(ops.check("ck", "acct", "y >= 0 and h > 0"), ops.check("ck2", "acct", "'y' <> 'h' and g > 0"), key)
    database.run(ops.AlterColumn("acct", "y", new_name="new y"))
    found = {c.name: c for c in database.reflect("acct").constraints}
    assert found["ck"].condition == "`new y` >= 0 and h > 0" and found["ck2"].condition == "'y' <> 'h' and g > 0"
    assert found["ex"].elements == (("`new y`", "~2"), ("g", "=")) and found["ex"].where == "`new y` > 0"
    assert report(database.reflect("acct"), database.data()).where("violations > 0").count() == 0
    database.run(ops.DropColumn("acct", "h"))
    assert {c.name for c in database.reflect("acct").constraints} == {"ck2", "ex"}


def test_foreign_keys_of_others_follow(spark, database):
    owner, acct = Table("owner", (Column("k", "int"), Column("n", "int"))), Table("acct", (Column("id", "int"), Column("o", "int")))
    database.run(ops.CreateTable(owner), ops.CreateTable(acct), ops.BulkInsert(owner, ({"k": 1, "n": 1},)), ops.BulkInsert(acct, ({"id": 1, "o": 1},)))
    database.run(ops.foreign_key("fk", "acct", "owner", ["o"], ["k"]), ops.AlterColumn("owner", "k", new_name="kk"))
    assert database.reflect("acct").constraints[0].refers == ("owner", ("kk",))
    with pytest.raises(ValidationError, match="fk"):
        database.run(ops.AlterColumn("owner", "kk", type="int", using="kk + 1"))
    with pytest.raises(ValueError, match="can't be dropped"):
        database.run(ops.DropColumn("owner", "kk"))
    database.run(ops.RenameTable("owner", "owner2"))
    assert database.reflect("acct").constraints[0].refers == ("owner2", ("kk",))


def test_inverses_on_the_catalog(spark, database):
    table = Table("acct", (Column("a", "int"), Column("b", "string", False), Column("c", "int")))
    database.run(ops.CreateTable(table))
    drop = database.known(ops.DropColumn("acct", "b"))
    database.run(drop, drop.reverse())  # empty, so it may be NOT NULL again
    assert database.reflect("acct").columns == table.columns
    database.run(ops.BulkInsert(table, ({"a": 1, "b": "x", "c": 2},)))
    database.run(drop)
    with pytest.raises(ValidationError, match="nulls"):
        database.run(drop.reverse())
    database.run(ops.AddColumn("acct", table.columns[1], behind="a", fill="'y'"))
    batch = database.known(ops.Batch("acct", (
        ops.DropColumn("acct", "b", fill="'z'"), ops.DropColumn("acct", "a"), ops.AlterColumn("acct", "c", new_name="d", type="bigint"),
    ), ()))
    database.run(batch)
    assert spark.table("acct").collect() == [(2,)]
    database.run(batch.reverse())
    assert database.reflect("acct").columns == table.columns and spark.table("acct").collect() == [(None, "z", 2)]


def test_catalog_frame_and_filters(spark, database):
    table = Table("acct", (Column("a", "int", False), Column("b", "array<struct<x:int,y:string>>")), indexes=(Index("ix", ("a",)),))
    database.run(ops.CreateTable(table), ops.CreateTable(Table("owner", (Column("k", "int"),))))
    rows = {tuple(r) for r in database.columns().where("table_name in ('acct', 'owner')").select("table_name", "column_name", "type", "nullable").collect()}
    assert rows == {("acct", "a", "integer", False), ("acct", "b", "array", True), ("owner", "k", "integer", True)}
    got = database.catalog(only=lambda kind, name: kind != "index" and name.partition(".")[0] == "acct")
    assert [t.name for t in got.tables] == ["acct"] and got["acct"].indexes == () and len(got["acct"].columns) == 2


def test_rewrite_of_a_declared_table(spark, database):
    table = Table("acct", (Column("a", "int"), Column("b", "int")))
    database.run(ops.CreateTable(table), ops.BulkInsert(table, ({"a": 1, "b": 2},)))
    given = Table("acct", table.columns, (Constraint("ck", "check", condition="b > 0"),))
    database.rewrite(ops.Batch("acct", (ops.AlterColumn("acct", "b", new_name="c"),)), given)
    assert database.reflect("acct").constraints[0].condition == "`c` > 0"


def test_exclusion(spark):
    import random

    rnd = random.Random(7)
    rows = [(i, rnd.randrange(3), rnd.uniform(0, 60), 10.0 ** rnd.uniform(-2, 1.6), rnd.uniform(0, 9)) for i in range(220)]
    rows += [(500, None, 1.0, 1.0, 1.0), (501, 1, None, 1.0, 2.0), (502, 1, 5.0, 0.0, None)]
    df = spark.createDataFrame(rows, "id int, g int, low double, width double, v double")

    def pairs(test):
        whole = [r for r in rows if None not in r]
        return {(a[0], b[0]) for a in whole for b in whole if a[0] < b[0] and test(a, b)}

    meets = lambda a, b: a[2] < b[2] + b[3] and b[2] < a[2] + a[3]
    near = lambda i, w: lambda a, b: abs(a[i] - b[i]) <= w

    def found(*elements):
        out = [tuple(r) for r in exclude_violations(df.where("g is not null and low is not null and v is not null"), "id", elements).collect()]
        assert len(out) == len(set(out))
        return set(out)

    assert found(("low, low + width", "&&")) == pairs(meets)
    assert found((("low", "low + greatest(width, 0)"), "&&"), ("g", "=")) == pairs(lambda a, b: meets(a, b) and a[1] == b[1])
    assert found(("low", "~2"), ("v", "~1")) == pairs(lambda a, b: near(2, 2)(a, b) and near(4, 1)(a, b))
    assert found(("low, low + width", "&&"), ("v", "~0.5")) == pairs(lambda a, b: meets(a, b) and near(4, 0.5)(a, b))
    assert {500, 501, 502}.isdisjoint({x for r in exclude_violations(df, "id", (("low, low + width", "&&"), ("g", "="))).collect() for x in r})
    with pytest.raises(ValueError, match="to look others up by"):
        exclude_violations(df, "id", ())


def test_bulk_insert_of_nothing(spark, database):
    table = Table("acct", (Column("id", "int"),))
    database.run(ops.CreateTable(table), ops.BulkInsert(table, ()))
    assert spark.table("acct").count() == 0


def test_constraint_kinds():
    with pytest.raises(ValueError):
        from tidemark.operators.validate import violations

        violations(Constraint("c", "odd"), Table("t", ()), {"t": None})


def test_operations_of_the_users_own(spark, database):
    from dataclasses import dataclass

    @dataclass(frozen=True)
    class Truncate(ops.Operation):
        table: str

    @Database.implementation_for(Truncate)
    def truncate(db, o):
        db.spark.sql(f"TRUNCATE TABLE {o.table}")

    try:
        table = Table("acct", (Column("id", "int"),))
        database.run(ops.CreateTable(table), ops.BulkInsert(table, ({"id": 1},)), Truncate("acct"))
        assert spark.table("acct").count() == 0
        for kind in (Truncate, ops.DropTable):
            with pytest.raises(ValueError, match="has an implementation"):
                Database.implementation_for(kind)(truncate)
    finally:
        del Database.implementations[Truncate]


def test_naming_convention():
    t = Table("t", (Column("a", "int"),), (Constraint("", "unique", ("a", "b")), Constraint("own", "unique", ("a",)), Constraint("", "foreign", ("a",), ("p", ("k",)))), (Index("", ("a",)),))
    named = ops.conventional(t, {"unique": "uq_{table}_{columns}", "foreign": "fk_{table}_{columns}_{parent}", "index": "ix_{columns}"})
    assert [c.name for c in named.constraints] == ["uq_t_a_b", "own", "fk_t_a_p"] and named.indexes[0].name == "ix_a"
