"""Queries of what changes stored rows: validated writes, updates, merges, cascades, swaps, scripts, numbers and computed columns."""

from __future__ import annotations

import uuid
from contextlib import ExitStack

from pyspark.sql import functions as F

from .operators import ops, validate
from .plans.script import statements
from .queries import _made, query, read
from .sources.changes import When
from .sources.files import Files
from .sources.scratch import scratch, settle
from .spec import Column, Constraint, Identity, Index, Storage


@query("""WITH batch AS (SELECT CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderkey END AS k, o_orderkey % 10 < 5 AS taken,
  CASE WHEN o_orderkey % 7 = 2 THEN -1 - o_custkey ELSE o_custkey END AS c, CASE WHEN o_orderkey % 11 = 3 THEN NULL ELSE o_orderstatus END AS s, o_totalprice AS p
  FROM orders WHERE o_orderkey % 10 IN (3, 4, 5, 6)),
judged AS (SELECT k, c, concat_ws(',', CASE WHEN NOT p > 1000 THEN 'ck_price' END, CASE WHEN c < 0 THEN 'fk_customer' END, CASE WHEN s IS NULL THEN 'o_orderstatus' END,
  CASE WHEN k IS NULL OR taken THEN 'pk' END) AS refused FROM batch)
SELECT k AS o_orderkey, c AS o_custkey, refused FROM judged WHERE refused <> ''
UNION ALL SELECT k, c, NULL FROM judged WHERE refused = ''
UNION ALL SELECT o_orderkey, o_custkey, NULL FROM orders WHERE o_orderkey % 10 < 5""")
def insert_validated(spark, d):
    """Half of the orders is there; of a batch, what breaks a key, a reference, a check or a null is refused and the rest written."""
    orders = read(spark, d, "orders")
    columns = tuple(Column(f.name, f.dataType.simpleString(), f.name != "o_orderstatus") for f in orders.schema.fields)
    batch = orders.where("o_orderkey % 10 in (3, 4, 5, 6)").withColumns({
        "o_custkey": F.expr("if(o_orderkey % 7 = 2, -1 - o_custkey, o_custkey)"), "o_orderstatus": F.expr("if(o_orderkey % 11 = 3, null, o_orderstatus)"),
        "o_orderkey": F.expr("if(o_orderkey % 23 = 0, null, o_orderkey)"),
    })
    with _made(spark, d, "customer") as (_, customer), _made(
        spark, d, "orders", of=orders.where("o_orderkey % 10 < 5"), columns=columns,
        constraints=(Constraint("pk", "primary", ("o_orderkey",)), Constraint("fk_customer", "foreign", ("o_custkey",), (customer, ("c_custkey",))),
                     Constraint("ck_price", "check", condition="o_totalprice > 1000")),
    ) as (db, t):
        bad = db.insert(t, batch, refused="skip")
        names = F.array_join(F.array_sort(F.transform("_refused", lambda x: F.replace(x, F.lit(f"{t}.")))), ",")
        stored = spark.table(t).select("o_orderkey", "o_custkey", F.lit(None).cast("string").alias("refused"))
        return settle(bad.select("o_orderkey", "o_custkey", names.alias("refused")).unionAll(stored))


@query("""SELECT o_orderkey, CASE WHEN o_orderdate >= DATE '1998-01-01' OR o_orderstatus = 'P' THEN upper(o_orderpriority) ELSE o_orderpriority END AS o_orderpriority,
CASE WHEN o_orderdate >= DATE '1998-01-01' OR o_orderstatus = 'P' THEN o_custkey + 1 ELSE o_custkey END AS o_custkey FROM orders""")
def execute_update(spark, d):
    """UPDATE as a statement: files without such rows are not written again."""
    with _made(spark, d, "orders", of=read(spark, d, "orders").repartitionByRange(8, "o_orderdate")) as (db, t):
        db.run(ops.Execute(f"UPDATE {t} AS o SET o_orderpriority = upper(o.o_orderpriority), o_custkey = o_custkey + 1 WHERE o.o_orderdate >= DATE'1998-01-01' OR o_orderstatus = 'P'"))
        return settle(spark.table(t).select("o_orderkey", "o_orderpriority", "o_custkey"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type <> (SELECT min(event_type) FROM events) OR user_id % 3 = 0")
def execute_delete(spark, d):
    """DELETE as a statement, with a subquery."""
    with _made(spark, d, "events") as (db, t):
        db.run(ops.Execute(f"DELETE FROM {t} WHERE event_type = (SELECT min(event_type) FROM {t}) AND user_id % 3 <> 0"))
        return settle(spark.table(t).select("event_id", "user_id", "event_type"))


@query("""WITH s AS (SELECT c_custkey * 2 AS k, c_name AS name, c_nationkey AS nation FROM customer)
SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT k FROM s) AND c_nationkey < 20
UNION ALL SELECT c_custkey, s.name, c_nationkey FROM customer JOIN s ON c_custkey = k WHERE s.nation <> 3
UNION ALL SELECT k, name, nation FROM s WHERE k NOT IN (SELECT c_custkey FROM customer)""")
def merge_rows(spark, d):
    """MERGE with all kinds of clauses."""
    source = read(spark, d, "customer").selectExpr("c_custkey * 2 AS k", "c_name AS name", "c_nationkey AS nation")
    with _made(spark, d, "customer", of=read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")) as (db, t):
        db.run(ops.primary_key("pk", t, ["c_custkey"]))
        db.merge(
            t, source, "target.c_custkey = source.k", When("matched", "delete", condition="source.nation = 3"), When("matched", "update", {"c_name": "source.name"}),
            When("missing", "insert", {"c_custkey": "source.k", "c_name": "source.name", "c_nationkey": "source.nation"}),
            When("surplus", "delete", condition="target.c_nationkey >= 20"),
        )
        return settle(spark.table(t))


@query("""WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1), c AS (SELECT * FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM n)),
o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
SELECT 'customer' AS tbl, c_custkey AS key, c_nationkey::BIGINT AS up FROM c UNION ALL SELECT 'orders', o_orderkey, o_custkey FROM o
UNION ALL SELECT 'lineitem', CASE WHEN l_orderkey IN (SELECT o_orderkey FROM o) THEN l_orderkey END, l_linenumber FROM lineitem""")
def foreign_key_cascade(spark, d):
    """Nations go; with them their customers and these one's orders (CASCADE), whose lines stay without an order (SET NULL)."""
    with ExitStack() as made:
        names = {n: made.enter_context(_made(spark, d, n)) for n in ("nation", "customer", "orders", "lineitem")}
        db, t = names["nation"][0], {n: k for n, (_, k) in names.items()}
        db.run(
            ops.foreign_key("fk_n", t["customer"], t["nation"], ["c_nationkey"], ["n_nationkey"], on_delete="CASCADE"),
            ops.foreign_key("fk_c", t["orders"], t["customer"], ["o_custkey"], ["c_custkey"], on_delete="CASCADE"),
            ops.foreign_key("fk_o", t["lineitem"], t["orders"], ["l_orderkey"], ["o_orderkey"], on_delete="SET NULL"),
            ops.Execute(f"DELETE FROM {t['nation']} WHERE n_regionkey = 1"),
        )
        parts = [("customer", "c_custkey", "c_nationkey"), ("orders", "o_orderkey", "o_custkey"), ("lineitem", "l_orderkey", "l_linenumber")]
        rows = [spark.table(t[n]).select(F.lit(n).alias("tbl"), F.col(k).cast("long").alias("key"), F.col(u).cast("long").alias("up")) for n, k, u in parts]
        return settle(rows[0].unionAll(rows[1]).unionAll(rows[2]))


@query("SELECT p_partkey AS part_id, p_name, p_size::BIGINT AS p_size, true AS external, true AS in_place FROM part")
def swap_external(spark, d):
    """Move-and-copy of an external table: it stays external, and where it is."""
    place = f"{scratch(spark).rstrip('/')}/external-{uuid.uuid4().hex}"
    try:
        with _made(spark, d, "part", storage=Storage(location=place, external=True)) as (db, t):
            gone = ("p_brand", "p_type", "p_retailprice")
            db.run(ops.Batch(t, (
                ops.AlterColumn(t, "p_partkey", new_name="part_id"), ops.AlterColumn(t, "p_size", type="bigint"), *(ops.DropColumn(t, c) for c in gone),
            )))
            now = db.reflect(t).storage
            facts = {"external": F.lit(now.external), "in_place": F.lit(now.location.rpartition("/")[2] == place.rpartition("/")[2])}
            return settle(spark.table(t).withColumns(facts))
    finally:
        Files(spark).delete(place)


@query("""SELECT c_custkey AS id, coalesce(TRY_CAST(nullif(regexp_extract(substr(c_name, 10), '^\\s*([+-]?\\d+)', 1), '') AS INTEGER), 0) AS number, 'EUR' AS currency,
c_custkey * 2 + c_nationkey AS code, upper(c_mktsegment) AS segment, c_nationkey FROM customer""")
def script_round_trip(spark, d):
    """A batch as a script of Spark SQL, run statement by statement."""
    with _made(spark, d, "customer") as (db, t):
        batch = ops.Batch(t, (
            ops.AlterColumn(t, "c_name", type="int", using="substr(c_name, 10)", mode="prefix", new_name="number"), ops.AlterColumn(t, "c_custkey", new_name="id"),
            ops.AddColumn(t, Column("currency", "string", False, "'EUR'"), behind="number"),
            ops.AddColumn(t, Column("code", "bigint", computed="id * 2 + c_nationkey"), behind="currency"),
            ops.AlterColumn(t, "c_mktsegment", type="string", using="upper(c_mktsegment)", new_name="segment"), ops.DropColumn(t, "c_acctbal"),
            ops.check("ck", t, "code >= id"),
        ), (("id", "number"),))
        for s in statements([batch, ops.unique("uq", t, ["id"])], [db.reflect(t)]):
            spark.sql(s).collect()
        assert {c.name for c in db.reflect(t).constraints} == {"ck", "uq"}
        return settle(spark.table(t))


@query("""WITH k AS (SELECT CASE WHEN o_orderkey % 50 = 7 THEN NULL ELSE o_orderkey END AS k, o_orderkey AS row,
  1152921504606846976 + o_orderkey * 3 AS low, 1152921504606846976 + o_orderkey * 3 + 4 + CASE WHEN o_orderkey % 100 = 0 THEN 20 ELSE 0 END AS high FROM orders),
p AS (SELECT a.k AS a, b.k AS b FROM k a JOIN k b ON a.low < b.high AND b.low < a.high AND a.row < b.row AND b.row < a.row + 10)
SELECT CASE WHEN a IS NULL OR a <= b THEN a ELSE b END AS left_key, CASE WHEN a IS NULL OR a <= b THEN b ELSE a END AS right_key FROM p""")
def validate_exclude_large(spark, d):
    """Intervals beyond what doubles tell apart, some without a key."""
    big = F.lit(2**60) + F.col("o_orderkey") * 3
    rows = read(spark, d, "orders").select(
        F.expr("if(o_orderkey % 50 = 7, null, o_orderkey)").alias("k"), big.alias("low"), (big + 4 + F.expr("if(o_orderkey % 100 = 0, 20, 0)")).alias("high")
    )
    return validate.exclude_violations(rows, "k", (("low, high", "&&"),))


@query("""SELECT event_id, event_type, 1000 + 10 * (row_number() OVER (ORDER BY ts, event_id) - 1) AS number FROM events
UNION ALL SELECT -1 - event_id, 'late', 1000 + 10 * ((SELECT count(*) FROM events) + row_number() OVER (ORDER BY event_id) - 1) FROM events WHERE user_id % 5 = 0""")
def identity_backfill(spark, d):
    """An identity column for the events there are, by time; later rows go on from the mark."""
    events = read(spark, d, "events").select("event_id", "event_type", "ts", "user_id")
    with _made(spark, d, "events", of=events) as (db, t):
        db.run(ops.AddColumn(t, Column("number", "bigint", False, identity=Identity(1000, 10, order="struct(ts, event_id)"))))
        db.run(ops.AlterColumn(t, "number", identity=Identity(1000, 10, always=True, order="-event_id")))
        db.insert(t, events.where("user_id % 5 = 0").selectExpr("-1 - event_id AS event_id", "'late' AS event_type", "user_id"))
        return settle(spark.table(t).select("event_id", "event_type", "number"))


@query("""WITH t AS (SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 30 ELSE s_nationkey END AS nation FROM supplier)
SELECT s_suppkey::VARCHAR AS id, nation::BIGINT AS nation, nation * 100 + length(s_suppkey::VARCHAR) AS zone, 'zone ' || (nation * 100 + length(s_suppkey::VARCHAR)) AS label FROM t""")
def computed_columns(spark, d):
    """Computed columns, one upon another, after their inputs have been updated, retyped and renamed."""
    with _made(spark, d, "supplier", of=read(spark, d, "supplier").select("s_suppkey", "s_nationkey")) as (db, t):
        db.run(ops.Batch(t, (
            ops.AddColumn(t, Column("label", "string", computed="concat('zone ', zone)")),
            ops.AddColumn(t, Column("zone", "bigint", computed="s_nationkey * 100 + s_suppkey % 1")),
        )))
        db.run(ops.Execute(f"UPDATE {t} SET s_nationkey = 30 WHERE s_nationkey = 3"), ops.Batch(t, (ops.DropColumn(t, "label"), ops.DropColumn(t, "zone"))))
        db.run(ops.Batch(t, (
            ops.AddColumn(t, Column("label", "string", computed="concat('zone ', zone)")),
            ops.AddColumn(t, Column("zone", "bigint", computed="s_nationkey * 100 + length(cast(s_suppkey as string))"), before="label"),
        )))
        db.run(ops.Batch(t, (ops.AlterColumn(t, "s_suppkey", type="string", new_name="id"), ops.AlterColumn(t, "s_nationkey", type="bigint", new_name="nation"))))
        return settle(spark.table(t))


@query("""WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END || c_custkey // 8 AS name FROM customer)
SELECT lower(name) AS key, count(*) AS n FROM n GROUP BY 1 HAVING count(*) > 1""")
def index_expression(spark, d):
    """What keeps a unique index on an expression from being made."""
    names = read(spark, d, "customer").selectExpr(
        "c_custkey", "concat(if(c_custkey % 4 = 0, upper(c_mktsegment), lower(c_mktsegment)), cast(floor(c_custkey / 8) as string)) AS name"
    )
    with _made(spark, d, "customer", of=names) as (db, t):
        index = Index("ix", ("lower(name)",), True)
        found = validate.violations(index.constraint(db.reflect(t)), db.reflect(t), db.data())
        return settle(found.select(F.col("key0").alias("key"), "n"))


@query("""SELECT 'unique' AS kind, 'uq_' || column_name AS name, column_name AS columns, NULL AS condition FROM information_schema.columns WHERE table_name = 'lineitem'
UNION ALL SELECT 'unique index', 'ix_' || column_name, 'lower(' || column_name || ')', NULL FROM information_schema.columns WHERE table_name = 'lineitem'
UNION ALL SELECT 'check', 'ck_' || column_name, '', column_name || ' <> ''{"x": [1]}''' FROM information_schema.columns WHERE table_name = 'lineitem'""")
def catalog_objects(spark, d):
    """Constraints and indexes of a database's tables from one statement, taken apart by Spark."""
    names = read(spark, d, "lineitem").columns
    constraints = tuple(Constraint(f"uq_{n}", "unique", (n,)) for n in names)
    constraints += tuple(Constraint(f"ck_{n}", "check", condition=f"{n} <> '{{\"x\": [1]}}'") for n in names)
    empty = read(spark, d, "lineitem").limit(0)
    with _made(spark, d, "lineitem", of=empty, constraints=constraints, indexes=tuple(Index(f"ix_{n}", (f"lower({n})",), True) for n in names)) as (db, t):
        found = db.objects().where(F.col("table_name") == t)
        return settle(found.select("kind", "name", F.array_join("columns", ",").alias("columns"), "condition"))
