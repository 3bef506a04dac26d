"""Rows that are written, changed and moved: validation before, recovery after."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

from tidemark.operators import ops
from tidemark.operators.validate import exclude_violations
from tidemark.plans.script import script, statements
from tidemark.sources import changes
from tidemark.sources.catalog import Database, ValidationError
from tidemark.sources.changes import When
from tidemark.sources.files import Busy, Files
from tidemark.spec import Column, Constraint, Identity, Index, Storage, Table

NAMES = ("acct", "acct2", "owner", "grp", "tree", "acct_view")


@pytest.fixture
def db(spark):
    def clean():
        spark.sql("DROP VIEW IF EXISTS acct_view")
        for n in NAMES:
            for s in ("", *changes.SUFFIXES):
                if n != "acct_view":
                    spark.sql(f"DROP TABLE IF EXISTS {n}{s}")

    clean()
    d = Database(spark)
    yield d
    d.recover()
    clean()


def content(spark, name):
    return sorted((tuple(r) for r in spark.table(name).collect()), key=str)


def accounts(db, rows=((1, "a", 1, 5), (2, "b", 1, 6), (3, None, 2, 7))):
    owner = Table("owner", (Column("k", "int", False), Column("title", "string")), (Constraint("pk_owner", "primary", ("k",)),))
    acct = Table(
        "acct", (Column("id", "int", False), Column("name", "string"), Column("o", "int"), Column("x", "int", True, "0")),
        (Constraint("pk", "primary", ("id",)), Constraint("uq", "unique", ("name",)), Constraint("ck", "check", condition="x >= 0"),
         Constraint("fk", "foreign", ("o",), ("owner", ("k",)))),
    )
    db.run(ops.CreateTable(owner), ops.BulkInsert(owner, ({"k": 1}, {"k": 2})), ops.CreateTable(acct))
    if rows:
        db.run(ops.BulkInsert(acct, tuple(dict(zip(("id", "name", "o", "x"), r)) for r in rows)))
    return acct


# writes


@pytest.mark.parametrize("row,name", [
    ({"id": 1, "name": "new"}, "pk"), ({"name": "new"}, "pk"), ({"id": 9, "name": "b"}, "uq"), ({"id": 9, "o": 7}, "fk"), ({"id": 9, "x": -1}, "ck"),
])
def test_rows_that_break_something_are_refused(spark, db, row, name):
    acct = accounts(db)
    before = content(spark, "acct")
    with pytest.raises(ValidationError, match=name):
        db.run(ops.BulkInsert(acct, ({"id": 8, "name": "good"}, row)))
    with pytest.raises(ValidationError, match=name):
        values = ", ".join("NULL" if row.get(c) is None else ops.literal(row[c]) for c in ("id", "name", "o", "x"))
        db.run(ops.Execute(f"INSERT INTO acct (id, name, o, x) VALUES ({values})"))
    assert content(spark, "acct") == before


def test_rows_of_one_batch_clash(spark, db):
    acct = accounts(db, ())
    with pytest.raises(ValidationError, match="pk, uq"):
        db.run(ops.BulkInsert(acct, ({"id": 1, "name": "q"}, {"id": 1, "name": "q"})))
    db.run(ops.BulkInsert(acct, ({"id": 1}, {"id": 2}, {"id": 3, "o": 2, "x": None})))  # nulls don't clash, unknown checks pass
    assert content(spark, "acct") == [(1, None, None, 0), (2, None, None, 0), (3, None, 2, None)]


def test_refused_rows_are_told_and_the_others_written(spark, db):
    accounts(db)
    rows = spark.createDataFrame([(1, "q", 1, 1), (10, "a", 5, -1), (11, "z", 2, 1), (None, None, None, None)], "id int, name string, o int, x int")
    bad = {r.id: r._refused for r in db.insert("acct", rows, refused="skip").collect()}
    assert bad == {1: ["pk"], 10: ["ck", "fk", "uq"], None: ["acct.id", "pk"]}
    assert [r[0] for r in content(spark, "acct")] == [1, 11, 2, 3]
    with pytest.raises(KeyError):
        db.insert("acct", rows.withColumnRenamed("x", "y"))


def test_defaults_are_those_of_the_catalog(spark, db):
    acct = accounts(db)
    db.run(ops.AlterColumn("acct", "x", default="77"), ops.BulkInsert(acct, ({"id": 50},)))
    assert (50, None, None, 77) in content(spark, "acct")


def test_old_rows_are_looked_up_and_not_grouped(spark, db):
    from tidemark.operators import writes
    from tidemark.sources.scratch import settle

    accounts(db)
    rows = settle(spark.createDataFrame([(9, "n", 1, 1)], "id int, name string, o int, x int"))
    plan = writes.judged(rows, db.reflect("acct"), db.data())._jdf.queryExecution().optimizedPlan().toString()
    scan = [line for line in plan.splitlines() if "Relation spark_catalog.default" in line]
    assert scan and all(":" in line for line in scan)
    for block in plan.split("Join"):
        if "spark_catalog.default.acct" in block:
            above = block.split("Relation spark_catalog.default.acct")[0].splitlines()
            assert not any("Aggregate" in line for line in above[1:])
    assert "id#" in plan and " = 9" in plan or "IN (9)" in plan


def test_exclusion_of_new_rows(spark, db):
    t = Table("acct", tuple(Column(c, "bigint") for c in ("id", "lo", "hi", "g")))
    db.run(ops.CreateTable(t), ops.BulkInsert(t, ({"id": 1, "lo": 0, "hi": 10, "g": 1}, {"id": 2, "lo": 5, "hi": 8, "g": 2})))
    db.run(ops.exclude("ex", "acct", "id", ("lo, hi", "&&"), ("g", "=")))
    with pytest.raises(ValidationError, match="ex"):
        db.run(ops.BulkInsert(t, ({"id": 3, "lo": 9, "hi": 12, "g": 1},)))
    db.run(ops.BulkInsert(t, ({"id": 3, "lo": 10, "hi": 12, "g": 1}, {"id": 4, "lo": 10, "hi": 12, "g": None})))
    assert spark.table("acct").count() == 4


# exclusion


def test_exclusion_of_large_numbers_and_null_keys(spark):
    big = 2**60
    df = spark.createDataFrame([(1, big, big + 3), (2, big + 2, big + 5), (3, big + 5, big + 6), (None, big + 5, big + 7), (None, 0, 1)], "k long, a long, b long")
    assert {tuple(r) for r in exclude_violations(df, "k", (("a, b", "&&"),)).collect()} == {(1, 2), (None, 3)}
    wide = spark.createDataFrame([(1, -(2**63), 2**63 - 1), (2, 7, 8), (2, 7, 9)], "k long, a long, b long")
    assert sorted(tuple(r) for r in exclude_violations(wide, "k", (("a, b", "&&"),)).collect()) == [(1, 2), (1, 2), (2, 2)]
    times = "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, {})"
    t = spark.sql(" UNION ALL ".join(f"SELECT {k} AS k, {times.format(a)} AS a, {times.format(b)} AS b" for k, a, b in ((1, 0, 1), (2, 0.999999, 2), (3, 1, 1.5))))
    assert {tuple(r) for r in exclude_violations(t, "k", (("a, b", "&&"),)).collect()} == {(1, 2), (2, 3)}


def test_exclusion_by_equality_is_linear(spark):
    df = spark.range(1000).selectExpr("id AS k", "id % 2 AS g")
    assert exclude_violations(df, "k", (("g", "="),)).count() == 998


# update, delete, merge


def files(spark, name):
    return {Path(r[0].removeprefix("file:")): os.stat(r[0].removeprefix("file:")).st_mtime_ns for r in spark.table(name).select("_metadata.file_path").distinct().collect()}


def many(spark, db, n=4, **more):
    """A table of n files of ten rows."""
    db.run(ops.CreateTable(Table("acct", (Column("id", "bigint"), Column("v", "string"), Column("x", "int")), **more)))
    spark.range(0, 10 * n, 1, n).selectExpr("id", "concat('v', id)", "cast(id % 10 as int)").write.insertInto("acct")


def test_untouched_files_stay(spark, db):
    many(spark, db)
    before = files(spark, "acct")
    db.run(ops.Execute("UPDATE acct AS a SET v = upper(a.v) || '!', x = x + 1 WHERE a.id BETWEEN 12 AND 14"))
    after = files(spark, "acct")
    assert len(before.keys() & after.keys()) == 3 and all(before[p] == after[p] for p in before.keys() & after.keys())
    assert {r.id: r.v for r in spark.table("acct").where("v like '%!'").collect()} == {12: "V12!", 13: "V13!", 14: "V14!"}
    assert spark.table("acct").count() == 40 and spark.table("acct").where("x = 10").count() == 0
    db.run(ops.Execute("DELETE FROM acct WHERE id >= 30 OR id IN (SELECT max(id) - 39 FROM acct)"))
    assert sorted(r.id for r in spark.table("acct").collect()) == list(range(1, 30))
    assert db.delete("acct", "id > 1000") == 0
    assert db.delete("acct", "v is null or id < 5") == 4
    db.run(ops.Execute("DELETE FROM acct"))
    assert spark.table("acct").count() == 0
    place = db.reflect("acct").storage.location.removeprefix("file:")
    assert not [x for x in os.listdir(place) if x.startswith("_tidemark")]


def test_only_touched_files_are_read_again(spark, db):
    many(spark, db)
    name = str(next(iter(files(spark, "acct"))))
    part = changes._Part(db, "acct")
    df = part.rows.where(changes.F.col(changes.FILE).isin(["file:" + name]))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().apply(0)
    assert df.count() == 10 and scan.metrics().apply("numFiles").value() == 1


def test_random_conditions_change_what_they_said(spark, db):
    many(spark, db)
    n = db.update("acct", {"v": "'hit'"}, "rand() < 0.5")
    assert spark.table("acct").where("v = 'hit'").count() == n and spark.table("acct").count() == 40


@pytest.mark.parametrize("storage", [Storage(), Storage("orc"), Storage(partitions=("x",)), Storage(buckets=(2, ("id",), ()))])
def test_changes_of_any_storage(spark, db, storage):
    db.run(ops.CreateTable(Table("acct", (Column("id", "bigint"), Column("v", "string"), Column("x", "int")), storage=storage)))
    db.insert("acct", spark.range(20).selectExpr("id", "'v' AS v", "cast(id % 3 as int) AS x"))
    db.run(ops.Execute("UPDATE acct SET x = 7, v = 'w' WHERE id < 4"), ops.Execute("DELETE FROM acct WHERE id % 3 = 2"))
    source = spark.createDataFrame([(0, "m", 1), (1, "m", -1), (100, "n", 9)], "id long, v string, x int")
    n = db.merge(
        "acct", source, "target.id = source.id", When("matched", "delete", condition="source.x < 0"), When("matched", "update", {"v": "source.v"}),
        When("missing", "insert"),
    )
    assert n == 3
    want = {i: ("w" if i < 4 else "v", 7 if i < 4 else i % 3) for i in range(20) if i % 3 != 2 and i != 1} | {0: ("m", 7), 100: ("n", 9)}
    assert {r.id: (r.v, r.x) for r in spark.table("acct").collect()} == want
    assert db.reflect("acct").storage.partitions == storage.partitions and bool(db.reflect("acct").storage.buckets) == bool(storage.buckets)


@pytest.mark.parametrize("external", [False, True])
def test_partitions_of_any_name_keep_their_rows(spark, db, tmp_path, external):
    storage = Storage(partitions=("p", "q d"), location=f"file:{tmp_path}/place" if external else None, external=external)
    columns = (Column("a.b", "int"), Column("ch", "char(4)"), Column("p", "string"), Column("q d", "date"))
    db.run(ops.CreateTable(Table("acct", columns, (Constraint("uc", "unique", ("ch",)), Constraint("pk", "primary", ("a.b",))), storage=storage)))
    rows = spark.sql("SELECT id AS `a.b`, 'c' || id AS ch, p, d AS `q d` FROM VALUES (1, 'x y/z%', DATE'2024-01-01'), (2, NULL, NULL), (3, 'n=1', DATE'2024-01-02') t(id, p, d)")
    db.insert("acct", rows)
    name, want = "acct", {1: "x y/z%", 2: None, 3: "n=1"}

    def same():
        key = spark.table(name).columns[0]
        assert {r[key]: r.p for r in spark.table(name).collect()} == want and spark.table(name).where("ch = 'c1  '").count() == 1

    same()
    for step in (
        lambda: db.update("acct", {"p": "'a: b'", "q d": "null"}, "`a.b` = 3"), lambda: db.run(ops.AlterColumn("acct", "a.b", new_name="odd `k`", type="bigint")),
        lambda: db.update("acct", {"p": "'2 %20'"}, "p is null"), lambda: db.run(ops.AddColumn("acct", Column("z", "int", False, "1"))),
        lambda: db.delete("acct", "p like 'none%'"), lambda: db.run(ops.RenameTable("acct", "acct2")),
    ):
        step()
        want[3] = "a: b"
        if step.__code__.co_consts and any("2 %20" in str(c) for c in step.__code__.co_consts):
            want[2] = "2 %20"
        name = "acct2" if spark.catalog.tableExists("acct2") else "acct"
        same()
    with pytest.raises(ValidationError, match="uc"):
        db.insert("acct2", spark.createDataFrame([(9, "c1")], "`odd ``k``` long, ch string"))
    assert db.reflect("acct2").constraints[1].columns == ("odd `k`",)


def test_merge_statement(spark, db):
    acct = accounts(db)
    db.run(ops.Execute("""MERGE INTO acct t USING (SELECT * FROM VALUES (1, 'a2'), (2, NULL), (7, 'n') AS s(id, name)) s ON t.id = s.id
        WHEN MATCHED AND s.name IS NULL THEN DELETE WHEN MATCHED THEN UPDATE SET name = s.name, x = t.x * 10
        WHEN NOT MATCHED THEN INSERT (id, name) VALUES (s.id, s.name) WHEN NOT MATCHED BY SOURCE THEN UPDATE SET name = 'rest'"""))
    assert content(spark, "acct") == [(1, "a2", 1, 50), (3, "rest", 2, 7), (7, "n", None, 0)]
    with pytest.raises(ValueError, match="matched by 2 rows"):
        db.merge("acct", spark.createDataFrame([(1,), (1,)], "id int"), "target.id = source.id", When("matched", "update", {"x": "1"}))
    with pytest.raises(ValidationError, match="uq"):
        db.merge("acct", spark.createDataFrame([(50, "rest")], "id int, name string"), "target.id = source.id", When("missing", "insert"))
    db.run(ops.BulkInsert(acct, ({"id": 60},)))
    assert spark.table("acct").count() == 4


def test_updates_are_validated(spark, db):
    accounts(db)
    before = content(spark, "acct")
    for values, where, name in (({"id": "1"}, "id = 2", "pk"), ({"name": "'a'"}, None, "uq"), ({"o": "9"}, "id = 1", "fk"), ({"x": "-x"}, None, "ck"), ({"id": "NULL"}, "id = 3", "acct.id")):
        with pytest.raises(ValidationError, match=name):
            db.update("acct", values, where)
    assert content(spark, "acct") == before
    db.update("acct", {"id": "id + 1"})  # all keys move at once
    assert [r[0] for r in content(spark, "acct")] == [2, 3, 4]


def referring(db, rule):
    owner = Table("owner", (Column("k", "int"), Column("g", "int")), (Constraint("pk_owner", "primary", ("k",)),))
    acct = Table("acct", (Column("id", "int"), Column("o", "int", True, "2")), (Constraint("pk", "primary", ("id",)),))
    leaf = Table("grp", (Column("n", "int"), Column("a", "int")))
    db.run(ops.CreateTable(owner), ops.CreateTable(acct), ops.CreateTable(leaf))
    db.run(ops.BulkInsert(owner, tuple({"k": k, "g": 0} for k in (1, 2, 3))), ops.BulkInsert(acct, tuple({"id": i, "o": i % 3 + 1} for i in range(9))))
    db.run(ops.BulkInsert(leaf, tuple({"n": n, "a": n % 9} for n in range(18))))
    db.run(ops.foreign_key("fk_o", "acct", "owner", ["o"], ["k"], on_delete=rule, on_update=rule))
    db.run(ops.foreign_key("fk_a", "grp", "acct", ["a"], ["id"], on_delete="CASCADE"))


def test_deletes_cascade(spark, db):
    referring(db, "CASCADE")
    db.run(ops.Execute("DELETE FROM owner WHERE k = 1"))
    assert [r[0] for r in content(spark, "owner")] == [2, 3]
    assert sorted(r.id for r in spark.table("acct").collect()) == [1, 2, 4, 5, 7, 8]
    assert sorted({r.a for r in spark.table("grp").collect()}) == [1, 2, 4, 5, 7, 8]
    db.update("owner", {"k": "k * 10"})
    assert {r.o for r in spark.table("acct").collect()} == {20, 30}


@pytest.mark.parametrize("rule,value", [("SET NULL", None), ("SET DEFAULT", 2)])
def test_deletes_set_values(spark, db, rule, value):
    referring(db, rule)
    db.delete("owner", "k = 1")
    assert {r.id: r.o for r in spark.table("acct").collect()} == {i: value if i % 3 == 0 else i % 3 + 1 for i in range(9)}
    assert spark.table("grp").count() == 18


def test_cascades_write_what_changes_once(spark, db, monkeypatch):
    referring(db, "CASCADE")
    db.run(ops.BulkInsert(db.reflect("acct"), ({"id": 20, "o": None}, {"id": 21, "o": 1})))
    written, settle = [], changes.settle

    def counted(df):
        out = settle(df)
        if changes.FILE in df.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(changes, "settle", counted)
    if hasattr(changes, "settled"):
        monkeypatch.setattr(changes, "settled", lambda df: (lambda out: (out, out.count()))(counted(df)))
    rest, asked = changes._Part.rest, []
    monkeypatch.setattr(changes._Part, "rest", lambda part, rows=None: asked.append(rest(part, rows)) or asked[-1])
    db.delete("owner", "k = 1")
    assert sorted((r.id, r.o) for r in spark.table("acct").where("o is not null").collect()) == [(i, i % 3 + 1) for i in range(9) if i % 3]
    assert [r.id for r in spark.table("acct").where("o is null").collect()] == [20]
    assert sorted({r.a for r in spark.table("grp").collect()}) == [1, 2, 4, 5, 7, 8]
    assert written == [1, 4, 6]  # of owner, acct and grp
    joins = [line for x in asked for line in x._jdf.queryExecution().analyzed().toString().splitlines() if "LeftAnti" in line]
    assert joins and not any(changes.PLACE in line for line in joins)  # by keys


def test_deletes_are_refused(spark, db):
    referring(db, "RESTRICT")
    for change in (lambda: db.delete("owner", "k = 1"), lambda: db.update("owner", {"k": "9"}, "k = 1"), lambda: db.run(ops.DropTable("owner"))):
        with pytest.raises(ValueError, match="fk_o"):
            change()
    assert spark.table("owner").count() == 3
    db.update("owner", {"g": "5"})
    db.delete("acct")  # and what refers to it
    assert spark.table("grp").count() == 0
    db.delete("owner", "k = 1")
    db.run(ops.DropTable("owner", cascade=True))
    assert [c.name for c in db.reflect("acct").constraints] == ["pk"]


def test_a_tree_goes_with_its_root(spark, db):
    t = Table("tree", (Column("id", "int"), Column("up", "int")), (
        Constraint("pk", "primary", ("id",)), Constraint("fk", "foreign", ("up",), ("tree", ("id",)), options=(("ON DELETE", "CASCADE"), ("ON UPDATE", "CASCADE"))),
    ))
    db.run(ops.CreateTable(t), ops.BulkInsert(t, tuple({"id": i, "up": (i - 1) // 2 if i else None} for i in range(31))))
    db.delete("tree", "id = 1")
    below = {i for i in range(31)} - {1, 3, 4, 7, 8, 9, 10, *range(15, 23)}
    assert {r.id for r in spark.table("tree").collect()} == below
    db.update("tree", {"id": "id + 100"}, "id in (0, 2)")
    assert {r.id: r.up for r in spark.table("tree").collect()} == {
        i + 100 if i in (0, 2) else i: None if i == 0 else (i - 1) // 2 + (100 if (i - 1) // 2 in (0, 2) else 0) for i in below
    }


# swaps that are cut off


class Cut(BaseException):
    """The driver ends here."""


def cut_after(monkeypatch, n):
    """The n-th step of a swap is the last one that is done."""
    left = [n]

    def step(f):
        def run(self, *a, **k):
            if isinstance(self, Files) or str(a[0]).startswith(("ALTER TABLE", "DROP TABLE", "CREATE TABLE")):
                if left[0] == 0:
                    raise Cut
                left[0] -= 1
            return f(self, *a, **k)

        return run

    from pyspark.sql import SparkSession

    for kind, name in ((SparkSession, "sql"), (Files, "move"), (Files, "delete"), (Files, "write_new")):
        monkeypatch.setattr(kind, name, step(getattr(kind, name)))


@pytest.mark.parametrize("external", [False, True])
def test_a_swap_cut_off_anywhere_loses_no_row(spark, db, tmp_path, external):
    storage = Storage(partitions=("p",), location=f"file:{tmp_path}/place", external=True) if external else Storage(partitions=("p",))
    rows = sorted((i, f"v{i}", f"p{i % 2}") for i in range(6))
    steps = seen = 0
    while steps == seen:  # until one goes through
        db.run(ops.DropTable("acct", if_exists=True))
        Files(spark).delete(f"file:{tmp_path}/place")
        t = Table("acct", (Column("id", "int"), Column("v", "string"), Column("p", "string")), (Constraint("uq", "unique", ("id",)),), storage=storage)
        db.run(ops.CreateTable(t), ops.BulkInsert(t, tuple(dict(zip(("id", "v", "p"), r)) for r in rows)))
        with pytest.MonkeyPatch.context() as m:
            cut_after(m, steps)
            try:
                db.run(ops.AlterColumn("acct", "id", new_name="k", type="bigint"))
            except Cut:
                seen += 1
        if steps < seen:
            assert db.recover() == ["acct"] or steps < 1
        now = db.reflect("acct")
        assert sorted(tuple(r) for r in spark.table("acct").select(now.columns[0].name, "v", "p").collect()) == rows
        assert now.constraints[0].columns == (now.columns[0].name,) and now.storage.external == external
        if external:
            assert now.storage.location == f"file:{tmp_path}/place" and sorted(os.listdir(tmp_path)) == ["place"]
        assert not [x for x in spark.catalog.listTables() if x.name.endswith(changes.SUFFIXES)]
        steps += 1
    assert steps > 8 and db.reflect("acct").columns[0].name == "k"


def test_a_change_of_files_cut_off_anywhere(spark, db):
    steps = seen = 0
    while steps == seen:
        db.run(ops.DropTable("acct", if_exists=True))
        many(spark, db, 2, storage=Storage(partitions=("x",)))
        with pytest.MonkeyPatch.context() as m:
            cut_after(m, steps)
            try:
                db.update("acct", {"v": "'new'", "x": "5"}, "id < 3")
            except Cut:
                seen += 1
        db.recover()
        new = {r.id for r in spark.table("acct").where("v = 'new' and x = 5").collect()}
        assert new in (set(), {0, 1, 2}) and spark.table("acct").count() == 20 and spark.table("acct").select("id").distinct().count() == 20
        steps += 1
    assert steps > 8 and new == {0, 1, 2}


def test_one_change_at_a_time(spark, db):
    many(spark, db)
    with changes._Change(db, "acct", {"kind": "files", "location": db.reflect("acct").storage.location}):
        with pytest.raises(Busy):
            db.delete("acct")
        with pytest.raises(Busy):
            db.run(ops.DropColumn("acct", "x"))
        db.insert("acct", spark.createDataFrame([(100,)], "id long"))  # without constraints files may be added meanwhile
    assert db.delete("acct", "id < 100") == 40 and db.recover() == []
    db.run(ops.primary_key("pk", "acct", ["id"]))
    with changes.guard(db, db.reflect("acct")), pytest.raises(Busy):
        db.insert("acct", spark.createDataFrame([(101,)], "id long"))
    db.insert("acct", spark.createDataFrame([(101,)], "id long"))
    assert content(spark, "acct") == [(100, None, None), (101, None, None)]


def test_a_failing_change_is_undone(spark, db):
    many(spark, db)
    with pytest.raises(Exception):
        db.update("acct", {"x": "cast(v as int)"})
    assert spark.table("acct").count() == 40 and db.recover() == []


# scripts


def test_a_script_does_what_running_does(spark, db, tmp_path):
    place = Storage(location=f"file:{tmp_path}/owner", external=True)
    owner = Table("owner", (Column("k", "int", False), Column("title", "string", True, "'it\\'s'", "what; it's")), storage=place)
    acct = Table("acct", (Column("id", "int"), Column("t", "string"), Column("p", "string"), Column("o", "int")), storage=Storage("orc", ("p",)))
    make = [
        ops.CreateTable(owner), ops.CreateTable(acct), ops.BulkInsert(owner, ({"k": 1, "title": "x"}, {"k": 2, "title": "y"})),
        ops.Execute("INSERT INTO acct (id, t, p, o) VALUES (1, '7up', 'a', 1), (2, 'x', 'b', 2), (3, NULL, 'a', NULL)"),
    ]
    change = [
        ops.primary_key("pk", "owner", ["k"]), ops.foreign_key("fk", "acct", "owner", ["o"], ["k"]),
        ops.Batch("acct", (
            ops.AlterColumn("acct", "t", type="int", mode="prefix", new_name="n t"), ops.AlterColumn("acct", "id", type="bigint", nullable=False),
            ops.AddColumn("acct", Column("twice", "bigint", computed="id * 2"), behind="id"), ops.AddColumn("acct", Column("c", "string", False, "'EUR'")),
            ops.check("ck", "acct", "id > 0"), ops.CreateIndex("acct", Index("ix", ("id % 10", "c"), True)),
        ), (("c", "id"),)),
        ops.Batch("owner", (ops.AlterColumn("owner", "k", new_name="key", type="bigint"), ops.AddColumn("owner", Column("z", "string"), fill="upper(title)"))),
        ops.AlterColumn("owner", "title", comment="new", default="'none'"), ops.TableComment("acct", "accounts"), ops.AddColumn("acct", Column("w", "int")),
        ops.DropConstraint("acct", "ck"), ops.RenameTable("acct", "acct2"),
    ]
    db.run(*make, *change)
    want = [(content(spark, n), db.reflect(n)) for n in ("owner", "acct2")]
    db.run(ops.DropTable("acct2"), ops.DropTable("owner"))
    Files(spark).delete(f"file:{tmp_path}/owner")
    for s in statements([*make, *change]):
        spark.sql(s).collect()
    assert [(content(spark, n), db.reflect(n)) for n in ("owner", "acct2")] == want
    assert [db.reflect(n).storage for n in ("owner", "acct2")] == [t.storage for _, t in want]
    assert script(change, [owner, acct]).count(";\n") == len(statements(change, [owner, acct]))


def test_a_script_stops_at_what_is_wrong(spark, db):
    t = Table("acct", (Column("id", "int"), Column("v", "string")))
    db.run(ops.CreateTable(t), ops.BulkInsert(t, ({"id": 1, "v": "1"}, {"id": 2, "v": "1"})))
    for change in (ops.unique("uq", "acct", ["v"]), ops.check("ck", "acct", "id > 1"), ops.AlterColumn("acct", "v", nullable=False, type="int", using="nullif(id, 1)")):
        with pytest.raises(Exception, match="acct"):
            for s in statements([change], [t]):
                spark.sql(s).collect()
        assert db.reflect("acct").column("v").type == "string"
        spark.sql("DROP TABLE IF EXISTS acct__tidemark_new")
    with pytest.raises(ValueError, match="needs its definition"):
        statements([ops.DropColumn("acct", "v")])


# identity and computed columns, indexes on expressions


def test_identity(spark, db):
    t = Table("acct", (Column("v", "string"), Column("ts", "int")))
    db.run(ops.CreateTable(t))
    spark.range(0, 100, 1, 7).selectExpr("concat('v', id)", "cast(1000 - id as int)").write.insertInto("acct")
    db.run(ops.AddColumn("acct", Column("n", "bigint", False, identity=Identity(10, 5, order="ts")), before="v"))
    assert {r.ts: r.n for r in spark.table("acct").collect()} == {1000 - i: 10 + 5 * (99 - i) for i in range(100)}
    db.insert("acct", spark.createDataFrame([("a", 3), ("b", 1), ("c", 2)], "v string, ts int"))
    assert {r.v: r.n for r in spark.table("acct").where("ts < 10").collect()} == {"b": 510, "c": 515, "a": 520}
    db.run(ops.AlterColumn("acct", "n", new_name="num"))
    db.run(ops.Execute("INSERT INTO acct (v, ts) VALUES ('d', 0)"), ops.Execute("INSERT INTO acct (num, v, ts) VALUES (7, 'e', 0)"))
    assert {r.v: r.num for r in spark.table("acct").where("ts = 0").collect()} == {"d": 525, "e": 7}
    db.run(ops.AlterColumn("acct", "num", identity=Identity(10, 1, always=True)))
    with pytest.raises(ValueError, match="always numbered"):
        db.insert("acct", spark.createDataFrame([(1, "f")], "num int, v string"))
    db.run(ops.Execute("INSERT INTO acct VALUES ('g', -1)"))
    assert spark.table("acct").where("v = 'g'").first().num == 530


def test_computed(spark, db):
    t = Table("acct", (Column("a", "int"), Column("b", "string", computed="concat('#', c)"), Column("c", "int", computed="a * 2"), Column("d", "int")))
    db.run(ops.CreateTable(t), ops.BulkInsert(t, ({"a": 1, "d": 5}, {"a": 2, "d": 6})))
    assert content(spark, "acct") == [(1, "#2", 2, 5), (2, "#4", 4, 6)]
    with pytest.raises(ValueError, match="computed"):
        db.run(ops.BulkInsert(t, ({"a": 1, "b": "x"},)))
    db.update("acct", {"a": "a + 10"}, "d = 6")
    assert content(spark, "acct") == [(1, "#2", 2, 5), (12, "#24", 24, 6)]
    db.run(ops.AlterColumn("acct", "a", type="bigint", using="a + 1", new_name="aa"), ops.AddColumn("acct", Column("e", "int", computed="length(b) + d"), before="d"))
    assert content(spark, "acct") == [(13, "#26", 26, 8 + 1, 6), (2, "#4", 4, 7, 5)]
    assert [c.computed for c in db.reflect("acct").columns] == [None, "concat('#', c)", "`aa` * 2", "length(b) + d", None]
    with pytest.raises(ValueError, match="input of"):
        db.run(ops.DropColumn("acct", "c"))
    with pytest.raises(ValueError, match="can't be changed"):
        db.run(ops.AlterColumn("acct", "c", default="5"))
    with pytest.raises(ValueError, match="depend on one another"):
        db.run(ops.Batch("acct", (ops.AddColumn("acct", Column("f", "int", computed="g")), ops.AddColumn("acct", Column("g", "int", computed="f")))))


def test_index_on_an_expression(spark, db):
    t = Table("acct", (Column("id", "int"), Column("v", "string")))
    db.run(ops.CreateTable(t), ops.BulkInsert(t, ({"id": 1, "v": "a"}, {"id": 2, "v": "B"})), ops.CreateIndex("acct", Index("ix", ("lower(v)",), True)))
    with pytest.raises(ValidationError, match="ix"):
        db.run(ops.BulkInsert(t, ({"id": 3, "v": "b"},)))
    with pytest.raises(ValidationError, match="ix2"):
        db.run(ops.CreateIndex("acct", Index("ix2", ("id % 1",), True)))
    with pytest.raises(Exception):
        db.run(ops.CreateIndex("acct", Index("ix3", ("nothing + 1",))))
    db.run(ops.AlterColumn("acct", "v", new_name="w"))
    assert db.reflect("acct").indexes == (Index("ix", ("lower(`w`)",), True),)
    db.run(ops.DropColumn("acct", "w"))
    assert db.reflect("acct").indexes == ()


# the catalog


def test_names_are_found_without_case(spark, db):
    t = Table("acct", (Column("Id", "int"), Column("Name", "string")), (Constraint("uq", "unique", ("ID",)), Constraint("ck", "check", condition="iD > 0")))
    db.run(ops.CreateTable(t), ops.BulkInsert(t, ({"ID": 1, "name": "x"},)))
    db.run(ops.Batch("ACCT", (ops.AlterColumn("acct", "id", type="bigint", new_name="Key"), ops.AddColumn("acct", Column("z", "int"), behind="NAME"))))
    now = db.reflect("acct")
    assert [c.name for c in now.columns] == ["Key", "Name", "z"]
    assert now.constraints[0].columns == ("Key",) and now.constraints[1].condition == "`Key` > 0"
    with pytest.raises(ValidationError):
        db.run(ops.Execute("insert into Acct values (1, 'y', 1)"))
    db.run(ops.DropColumn("acct", "NAME"))
    with pytest.raises(ValueError, match="already"):
        db.run(ops.AddColumn("acct", Column("KEY", "int")))


def test_views_are_no_tables(spark, db):
    db.run(ops.CreateTable(Table("acct", (Column("id", "int"),))))
    spark.sql("CREATE VIEW acct_view AS SELECT 1 AS x")
    assert "acct_view" not in db.tables() and db.columns().where("table_name = 'acct_view'").count() == 0


def test_objects_of_all_tables_at_once(spark, db, monkeypatch):
    accounts(db, ())
    db.run(ops.CreateIndex("acct", Index("ix", ("lower(name)",), True)), ops.check("odd", "acct", "name <> '\"end\": true}' and name <> ']'"))

    def count():
        seen = []
        with pytest.MonkeyPatch.context() as m:
            from pyspark.sql import SparkSession

            real = SparkSession.sql
            m.setattr(SparkSession, "sql", lambda self, q, *a, **k: (seen.append(q), real(self, q, *a, **k))[1])
            rows = {(r.table_name, r.kind, r.name): r for r in db.objects().collect()}
        return rows, len(seen)

    rows, n = count()
    assert n == 1
    assert rows["acct", "foreign", "fk"].refers == "owner" and rows["acct", "foreign", "fk"].refers_columns == ["k"]
    assert rows["acct", "unique index", "ix"].columns == ["lower(name)"] and rows["acct", "check", "odd"].condition.startswith("name <> '\"end")
    assert {k for k in rows if k[0] == "owner"} == {("owner", "primary", "pk_owner")}
    db.run(ops.CreateTable(Table("grp", (Column("a", "int"),))), ops.CreateTable(Table("tree", (Column("a", "int"),))))
    assert count()[1] == n


def test_recreate(spark, db):
    t = Table("acct", (Column("id", "int"), Column("v", "string")))
    db.run(ops.CreateTable(t), ops.BulkInsert(t, ({"id": 1, "v": "x"},)))
    before = files(spark, "acct")
    db.run(ops.Batch("acct", (ops.AlterColumn("acct", "v", comment="c"), ops.unique("uq", "acct", ["id"]))))
    assert files(spark, "acct") == before
    with pytest.raises(ValueError, match="writing its rows again"):
        db.run(ops.Batch("acct", (ops.DropColumn("acct", "v"),), recreate="never"))
    db.run(ops.Batch("acct", (ops.AlterColumn("acct", "v", comment="d"),), recreate="always"))
    assert files(spark, "acct").keys() != before.keys() and db.reflect("acct").column("v").comment == "d"
    with pytest.raises(KeyError, match="not check"):
        db.run(ops.DropConstraint("acct", "uq", kind="check"))
    db.run(ops.DropConstraint("acct", "uq", kind="unique"))
