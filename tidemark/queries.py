"""Queries that exercise the operators on the driver's tables, each with its SQL."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.casts import file_name, revision_id, slug, stamp_parts, types_differ
from .operators import ops, validate
from .operators.rewrite import Rewrite
from .plans import diff, graph
from .plans.growing import Growing
from .sources.catalog import Database, ValidationError, bulk_rows
from .sources.scratch import settle
from .spec import Catalog, Column, Constraint, Index, Storage, Table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rewritten(spark, d, name, change) -> DataFrame:
    df = read(spark, d, name)
    return change(Rewrite(Table.of(name, df))).apply(df)


# rewrites


@query("SELECT s_suppkey, s_nationkey, s_name AS name, 0::INTEGER AS status FROM supplier")
def rewrite_rename_drop_reorder(spark, d):
    return _rewritten(spark, d, "supplier", lambda r: (
        r.drop("s_acctbal").rename("s_name", "name").add(Column("status", "int", False, "0")).reorder("s_nationkey", "name")
    ))


@query("SELECT n_nationkey, n_name, n_regionkey, 'none' AS remark, NULL::BIGINT AS area FROM nation")
def rewrite_add_column_default(spark, d):
    return _rewritten(spark, d, "nation", lambda r: r.add(Column("remark", "string", False, "'none'")).add(Column("area", "bigint")))


@query("""SELECT o_orderkey, coalesce(TRY_CAST(nullif(regexp_extract(o_orderpriority, '^\\s*([+-]?\\d+)', 1), '') AS INTEGER), 0) AS o_orderpriority
FROM orders""")
def rewrite_cast_lenient(spark, d):
    return _rewritten(spark, d, "orders", lambda r: (
        r.retype("o_orderpriority", "int", mode="prefix").drop("o_custkey").drop("o_orderstatus").drop("o_totalprice").drop("o_orderdate")
    ))


@query("SELECT event_id::VARCHAR AS event_id, strftime(ts, '%Y-%m-%d') AS ts, user_id::INTEGER AS user_id, event_type FROM events")
def rewrite_cast_types(spark, d):
    return _rewritten(spark, d, "events", lambda r: (
        r.retype("event_id", "string").retype("ts", "string", using="date_format(ts, 'yyyy-MM-dd')").retype("user_id", "int").drop("value").drop("props")
    ))


@query("SELECT l_orderkey::VARCHAR AS l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem")
def rewrite_cast_widen(spark, d):
    return _rewritten(spark, d, "lineitem", lambda r: (
        _only(r, "l_orderkey", "l_linenumber").retype("l_orderkey", "string").retype("l_linenumber", "bigint")
    ))


def _only(r: Rewrite, *names) -> Rewrite:
    for n in [n for n in r.columns if n not in names]:
        r.drop(n)
    return r


@query("SELECT c_custkey, c_name, upper(c_mktsegment) AS segment_code, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def rewrite_insert_after(spark, d):
    return _rewritten(spark, d, "customer", lambda r: r.add(Column("segment_code", "string"), behind="c_name", fill="upper(c_mktsegment)"))


@query("SELECT p_size, p_partkey, p_retailprice, p_name, p_brand, p_type FROM part")
def rewrite_partial_reordering(spark, d):
    return _rewritten(spark, d, "part", lambda r: r.reorder("p_size", "p_partkey", "p_retailprice", "p_name"))


@query("""SELECT l_orderkey AS order_id, l_linenumber::BIGINT AS line_no, l_partkey AS part_id, 'EUR' AS currency,
CASE WHEN l_returnflag = 'R' THEN true ELSE false END AS returned, l_quantity::INTEGER AS quantity, l_linestatus, l_shipdate
FROM lineitem""")
def rewrite_batch_lineitem(spark, d):
    """Twelve changes of the largest table in one projection."""
    t = "lineitem"
    batch = ops.Batch(t, (
        ops.AlterColumn(t, "l_orderkey", new_name="order_id"),
        ops.AlterColumn(t, "l_linenumber", type="bigint", new_name="line_no"),
        ops.AlterColumn(t, "l_partkey", new_name="part_id"),
        ops.AlterColumn(t, "l_quantity", type="int", new_name="quantity"),
        ops.AddColumn(t, Column("currency", "string", False, "'EUR'"), behind="part_id"),
        ops.AddColumn(t, Column("returned", "boolean"), fill="CASE WHEN l_returnflag = 'R' THEN true ELSE false END"),
        *(ops.DropColumn(t, c) for c in ("l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")),
    ), (("order_id", "line_no", "part_id"), ("currency", "returned", "quantity")))
    return _rewritten(spark, d, t, batch.change)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_totalprice >= 1000")
def execute_update_delete(spark, d):
    """UPDATE and DELETE as one rewrite."""
    df = read(spark, d, "orders")
    r = _only(Rewrite(Table.of("orders", df)), "o_orderkey", "o_orderstatus")
    return r.retype("o_orderstatus", "string", using="CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE o_orderstatus END").apply(
        df.where("o_totalprice >= 1000")
    )


@query("SELECT event_id, coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE props END, 'none') AS props FROM events")
def alter_nullable_backfill(spark, d):
    df = read(spark, d, "events").selectExpr("event_id", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE props END AS props")
    return Rewrite(Table.of("events", df)).alter("props", nullable=False, fill="'none'").apply(df)


@query("""SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL
SELECT * FROM (VALUES (100, 'NOWHERE', 0), (101, 'unnamed', NULL), (102, NULL, 1)) v(a, b, c)""")
def bulk_insert_union(spark, d):
    nation = read(spark, d, "nation")
    table = Table("nation", (Column("n_nationkey", "int"), Column("n_name", "string", True, "'unnamed'"), Column("n_regionkey", "int")))
    rows = (
        {"n_nationkey": 100, "n_name": "NOWHERE", "n_regionkey": 0}, {"n_nationkey": 101},
        {"n_nationkey": 102, "n_name": None, "n_regionkey": 1},
    )
    return nation.unionByName(bulk_rows(spark, ops.BulkInsert(table, rows)))


# validation


@query("SELECT event_id, event_type FROM events WHERE event_id % 11 = 0 OR value IS NULL")
def alter_nullable_violations(spark, d):
    df = read(spark, d, "events").withColumn("props", F.expr("CASE WHEN event_id % 11 = 0 THEN NULL ELSE props END"))
    return validate.null_violations(df, ["props", "value"]).select("event_id", "event_type")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def validate_unique(spark, d):
    return validate.unique_violations(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT k AS o_orderkey, count(*) AS n FROM
(SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 50 = 1 THEN 1 ELSE o_orderkey END AS k FROM orders)
GROUP BY 1 HAVING count(*) > 1 OR k IS NULL""")
def validate_primary_key(spark, d):
    key = F.expr("CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 50 = 1 THEN 1 ELSE o_orderkey END")
    return validate.primary_violations(read(spark, d, "orders").select(key.alias("o_orderkey")), ["o_orderkey"])


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 1")
def validate_foreign_key(spark, d):
    return validate.foreign_violations(read(spark, d, "orders"), ["o_custkey"], read(spark, d, "customer"), ["c_custkey"])


@query("""SELECT k AS l_partkey, count(*) AS n FROM (SELECT CASE WHEN l_partkey % 7 = 3 THEN -l_partkey ELSE l_partkey END AS k FROM lineitem)
WHERE k NOT IN (SELECT p_partkey FROM part) GROUP BY 1""")
def validate_foreign_key_violation(spark, d):
    key = F.expr("CASE WHEN l_partkey % 7 = 3 THEN -l_partkey ELSE l_partkey END").alias("l_partkey")
    return validate.foreign_violations(read(spark, d, "lineitem").select(key), ["l_partkey"], read(spark, d, "part"), ["p_partkey"])


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 0.05)")
def validate_check(spark, d):
    return validate.check_violations(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount"), "l_discount between 0 and 0.05")


@query("""SELECT a.s_suppkey AS left_key, b.s_suppkey AS right_key FROM supplier a JOIN supplier b
ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) <= 500""")
def validate_exclude(spark, d):
    return validate.exclude_violations(read(spark, d, "supplier"), "s_suppkey", (("s_nationkey", "="), ("s_acctbal", "~500")))


@query("""SELECT a.c_custkey AS left_key, b.c_custkey AS right_key FROM customer a JOIN customer b
ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey
AND a.c_acctbal < b.c_acctbal + 20 AND b.c_acctbal < a.c_acctbal + 20""")
def validate_exclude_interval(spark, d):
    elements = (("c_nationkey", "="), ("c_mktsegment", "="), ("c_acctbal, c_acctbal + 20", "&&"))
    return validate.exclude_violations(read(spark, d, "customer"), "c_custkey", elements)


@query("""SELECT 'ck_price' AS name, 'check' AS kind, count(*) FILTER (WHERE NOT o_totalprice > 1000) AS violations FROM orders
UNION ALL SELECT 'orders.o_orderstatus', 'not_null', count(*) FILTER (WHERE o_orderstatus IS NULL) FROM orders
UNION ALL SELECT 'pk', 'primary', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'uq', 'unique', count(*) FROM (SELECT o_custkey, o_orderdate FROM orders GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'fk', 'foreign', count(*) FROM (SELECT DISTINCT k FROM (SELECT CASE WHEN o_custkey % 3 = 1 THEN -o_custkey ELSE o_custkey END AS k FROM orders) WHERE k NOT IN (SELECT c_custkey FROM customer))""")
def validate_report(spark, d):
    orders = read(spark, d, "orders").withColumn("o_custkey", F.expr("CASE WHEN o_custkey % 3 = 1 THEN -o_custkey ELSE o_custkey END"))
    columns = tuple(Column(c.name, c.type, c.name != "o_orderstatus") for c in Table.of("orders", orders).columns)
    table = Table("orders", columns, (
        Constraint("ck_price", "check", condition="o_totalprice > 1000"),
        Constraint("pk", "primary", ("o_orderkey",)),
        Constraint("uq", "unique", ("o_custkey", "o_orderdate")),
        Constraint("fk", "foreign", ("o_custkey",), ("customer", ("c_custkey",))),
    ))
    return validate.report(table, {"orders": orders, "customer": read(spark, d, "customer")})


# revision graph: a binary tree over all part keys with second parents and dependencies

_EDGES = """edges AS (
  SELECT CAST(p_partkey AS VARCHAR) AS rev, CAST(CAST(floor((p_partkey - 1) / 2) AS BIGINT) AS VARCHAR) AS down, 'down' AS kind
  FROM part WHERE p_partkey >= 1
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), CAST(p_partkey - 4 AS VARCHAR), 'down' FROM part WHERE p_partkey >= 12 AND p_partkey % 9 = 3
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), CAST(p_partkey - 7 AS VARCHAR), 'dep' FROM part WHERE p_partkey >= 8 AND p_partkey % 5 = 0),
nodes AS (SELECT CAST(p_partkey AS VARCHAR) AS rev FROM part)"""


def _reach_sql(name: str, seeds: str, upward: bool = True, kinds: str = "") -> str:
    a, b = ("rev", "down") if upward else ("down", "rev")
    return f"{name} AS (SELECT unnest([{seeds}]) AS rev UNION SELECT e.{b} FROM {name} r JOIN edges e ON r.rev = e.{a} {kinds})"


def _graph(spark, d):
    part = read(spark, d, "part").select(F.col("p_partkey").alias("k"))
    text = lambda c: c.cast("string")
    down = part.where("k >= 1").select(text(F.col("k")).alias("rev"), text(F.floor((F.col("k") - 1) / 2)).alias("down"), F.lit("down").alias("kind"))
    second = part.where("k >= 12 and k % 9 = 3").select(text(F.col("k")), text(F.col("k") - 4), F.lit("down"))
    deps = part.where("k >= 8 and k % 5 = 0").select(text(F.col("k")), text(F.col("k") - 7), F.lit("dep"))
    return part.select(text(F.col("k")).alias("rev")), down.union(second).union(deps)


def _revs(spark, *revs):
    return spark.createDataFrame([(r,) for r in revs], "rev string")


@query(f"WITH {_EDGES} SELECT rev FROM nodes WHERE rev NOT IN (SELECT down FROM edges WHERE kind = 'down')")
def dag_heads(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.heads(nodes, graph.versioned(edges))


@query(f"WITH {_EDGES} SELECT rev FROM nodes WHERE rev NOT IN (SELECT down FROM edges)")
def dag_real_heads(spark, d):
    return graph.heads(*_graph(spark, d))


@query(f"WITH {_EDGES} SELECT rev FROM nodes WHERE rev NOT IN (SELECT rev FROM edges)")
def dag_bases(spark, d):
    return graph.bases(*_graph(spark, d))


@query(f"WITH {_EDGES} SELECT down AS rev, count(DISTINCT rev) AS n FROM edges WHERE kind = 'down' GROUP BY 1 HAVING count(DISTINCT rev) > 1")
def dag_branch_points(spark, d):
    return graph.branch_points(_graph(spark, d)[1])


@query(f"WITH {_EDGES} SELECT rev, count(DISTINCT down) AS n FROM edges WHERE kind = 'down' GROUP BY 1 HAVING count(DISTINCT down) > 1")
def dag_merge_points(spark, d):
    return graph.merge_points(_graph(spark, d)[1])


@query(f"WITH RECURSIVE {_EDGES}, {_reach_sql('r', chr(39) + '60' + chr(39) + ', ' + chr(39) + '33' + chr(39))} SELECT DISTINCT rev FROM r")
def dag_ancestors(spark, d):
    return graph.ancestors(_graph(spark, d)[1], _revs(spark, "60", "33"))


@query(f"WITH RECURSIVE {_EDGES}, {_reach_sql('r', chr(39) + '3' + chr(39), False)} SELECT DISTINCT rev FROM r")
def dag_descendants(spark, d):
    return graph.descendants(_graph(spark, d)[1], _revs(spark, "3"))


@query(f"WITH RECURSIVE {_EDGES}, {_reach_sql('a', chr(39) + '60' + chr(39))}, {_reach_sql('b', chr(39) + '14' + chr(39))} SELECT DISTINCT rev FROM a WHERE rev NOT IN (SELECT rev FROM b)")
def dag_upgrade_set(spark, d):
    return graph.upgrade_set(_graph(spark, d)[1], _revs(spark, "14"), _revs(spark, "60"))


@query(f"""WITH RECURSIVE {_EDGES}, {_reach_sql('a', chr(39) + '60' + chr(39))}, {_reach_sql('b', chr(39) + '2' + chr(39), False)}
SELECT DISTINCT rev FROM b WHERE rev <> '2' AND rev IN (SELECT rev FROM a)""")
def dag_downgrade_set(spark, d):
    return graph.downgrade_set(_graph(spark, d)[1], _revs(spark, "60"), _revs(spark, "2"))


@query(f"WITH RECURSIVE {_EDGES}, {_reach_sql('a', chr(39) + '6' + chr(39))}, {_reach_sql('b', chr(39) + '6' + chr(39), False)} SELECT rev FROM a UNION SELECT rev FROM b")
def dag_lineage(spark, d):
    return graph.lineage(_graph(spark, d)[1], _revs(spark, "6"))


_PAIRS = "pairs AS (SELECT rev, down AS up FROM edges {0} UNION SELECT p.rev, e.down FROM pairs p JOIN edges e ON p.up = e.rev {1})"


@query(f"WITH RECURSIVE {_EDGES}, {_PAIRS.format('', '')} SELECT DISTINCT up AS rev, count(*) OVER (PARTITION BY up) AS n_descendants FROM pairs")
def dag_closure_sizes(spark, d):
    return graph.descendant_counts(_graph(spark, d)[1])


@query(f"""WITH RECURSIVE {_EDGES}, {_PAIRS.format('', '')}, t AS (SELECT unnest(['6', '14', '30', '8', '33', '40']) AS rev)
SELECT rev FROM t WHERE rev NOT IN (SELECT up FROM pairs WHERE rev IN (SELECT rev FROM t))""")
def dag_branch_heads(spark, d):
    return graph.branch_heads(_graph(spark, d)[1], _revs(spark, "6", "14", "30", "8", "33", "40"))


@query(f"""WITH RECURSIVE {_EDGES}, {_PAIRS.format("WHERE kind = 'down'", "AND e.kind = 'down'")}
SELECT rev, down, kind FROM edges e WHERE kind = 'down' OR NOT EXISTS
(SELECT 1 FROM pairs p JOIN edges q ON p.up = q.rev AND q.kind = 'dep' WHERE p.rev = e.rev AND q.down = e.down)""")
def dag_normalized_dependencies(spark, d):
    return graph.normalized(_graph(spark, d)[1])


@query(f"""WITH RECURSIVE {_EDGES}, deep AS (SELECT rev, 0 AS depth FROM nodes WHERE rev NOT IN (SELECT rev FROM edges)
UNION SELECT e.rev, t.depth + 1 FROM deep t JOIN edges e ON e.down = t.rev)
SELECT rev, max(depth)::INTEGER AS depth, row_number() OVER (ORDER BY max(depth), rev)::INTEGER AS place FROM deep GROUP BY rev""")
def dag_topological_rank(spark, d):
    return graph.topological(*_graph(spark, d))


@query("SELECT CAST(p_partkey AS VARCHAR) AS rev FROM part WHERE p_partkey // 10 % 3 = 0")
def dag_cycle_check(spark, d):
    """Chains of ten revisions, every third of which is closed to a ring."""
    part = read(spark, d, "part").select(F.col("p_partkey").alias("k"))
    down = F.when(F.col("k") % 10 < 9, F.col("k") + 1).when(F.floor(F.col("k") / 10) % 3 == 0, F.col("k") - 9)
    edges = part.select(F.col("k").cast("string").alias("rev"), down.cast("string").alias("down"), F.lit("down").alias("kind"))
    return graph.cycle_members(part.select(F.col("k").cast("string").alias("rev")), edges.where("down is not null"))


@query(f"""WITH {_EDGES} SELECT DISTINCT c.down AS rev FROM edges a JOIN edges b ON a.down = b.rev JOIN edges c ON b.down = c.rev
WHERE a.rev = '57' AND a.kind = 'down' AND b.kind = 'down' AND c.kind = 'down'""")
def dag_walk_3(spark, d):
    return graph.walk(_graph(spark, d)[1], _revs(spark, "57"), -3)


@query("""SELECT rev FROM (SELECT p_name || '#' || p_partkey AS rev FROM part) WHERE rev = 'blue' OR (length(rev) > 3 AND starts_with(rev, 'blue'))""")
def dag_partial_match(spark, d):
    ids = F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string"))
    return graph.matching(read(spark, d, "part").select(ids.alias("rev")), "blue")


@query(f"""WITH RECURSIVE {_EDGES}, v AS (SELECT rev, down FROM edges WHERE kind = 'down'),
labels AS (SELECT * FROM (VALUES ('6', 'x'), ('40', 'y')) t(rev, label)),
below AS (SELECT rev, label FROM labels UNION SELECT v.rev, b.label FROM below b JOIN v ON v.down = b.rev),
narrow AS (SELECT rev, down FROM v WHERE down NOT IN (SELECT down FROM v GROUP BY 1 HAVING count(DISTINCT rev) > 1)
  AND rev NOT IN (SELECT rev FROM v GROUP BY 1 HAVING count(DISTINCT down) > 1)),
above AS (SELECT rev, label FROM labels UNION SELECT n.down, a.label FROM above a JOIN narrow n ON n.rev = a.rev)
SELECT rev, label FROM below UNION SELECT rev, label FROM above""")
def dag_branch_labels(spark, d):
    labels = spark.createDataFrame([("6", "x"), ("40", "y")], "rev string, label string")
    return graph.label_members(_graph(spark, d)[1], labels)


def _state_sql(current: str, change: str) -> str:
    return f"""WITH RECURSIVE {_EDGES}, {_reach_sql('a', current)}, applied AS ({change})
SELECT rev FROM applied WHERE rev NOT IN (SELECT down FROM edges WHERE kind = 'down' AND rev IN (SELECT rev FROM applied))"""


@query(_state_sql("'14', '8'", "SELECT DISTINCT rev FROM a UNION SELECT unnest(['29', '30', '12'])"))
def version_state_upgrade(spark, d):
    return graph.heads_after(_graph(spark, d)[1], _revs(spark, "14", "8"), added=_revs(spark, "29", "30", "12"))


@query(_state_sql("'30', '8'", "SELECT DISTINCT rev FROM a WHERE rev NOT IN ('30', '14', '8')"))
def version_state_downgrade(spark, d):
    return graph.heads_after(_graph(spark, d)[1], _revs(spark, "30", "8"), removed=_revs(spark, "30", "14", "8"))


@query(_state_sql("'5', '8'", "SELECT DISTINCT rev FROM a UNION SELECT '12'"))
def version_state_merge(spark, d):
    return graph.heads_after(_graph(spark, d)[1], _revs(spark, "5", "8"), added=_revs(spark, "12"))


@query(_state_sql("'12'", "SELECT DISTINCT rev FROM a WHERE rev <> '12'"))
def version_state_unmerge(spark, d):
    return graph.heads_after(_graph(spark, d)[1], _revs(spark, "12"), removed=_revs(spark, "12"))


@query(f"""WITH RECURSIVE {_EDGES}, {_reach_sql('a', "'6'")}, {_reach_sql('b', "'6'", False)}
SELECT '6' AS rev UNION SELECT rev FROM (SELECT unnest(['8', '14', '33']) AS rev) WHERE rev NOT IN (SELECT rev FROM a) AND rev NOT IN (SELECT rev FROM b)""")
def version_state_stamp(spark, d):
    """Stamping one branch leaves the heads of the others."""
    return graph.stamped(_graph(spark, d)[1], _revs(spark, "8", "14", "33"), _revs(spark, "6"))


@query(f"""WITH RECURSIVE {_EDGES}, v AS (SELECT rev, down FROM edges WHERE kind = 'down'), deep AS (SELECT rev, 0 AS depth FROM nodes WHERE rev NOT IN (SELECT rev FROM v)
UNION SELECT v.rev, t.depth + 1 FROM deep t JOIN v ON v.down = t.rev)
SELECT rev, max(depth)::INTEGER AS depth, rev NOT IN (SELECT down FROM v) AS is_head, rev NOT IN (SELECT rev FROM v) AS is_base FROM deep GROUP BY rev""")
def dag_growing(spark, d):
    """Depths, heads and bases of a graph to which its upper half was added."""
    nodes, edges = _graph(spark, d)
    edges = graph.versioned(edges)
    key = lambda c: F.col(c).cast("long")
    half = nodes.agg(F.max(key("rev"))).first()[0] // 2
    labels = spark.createDataFrame([], "rev string, label string")
    state = Growing.built(nodes.where(key("rev") <= half), edges.where(key("rev") <= half), labels)
    state = state.added(nodes.where(key("rev") > half), edges.where(key("rev") > half))
    marked = lambda df, name: df.select("rev", F.lit(True).alias(name))
    out = state.depths.join(marked(state.heads, "is_head"), "rev", "left").join(marked(state.bases, "is_base"), "rev", "left")
    return out.select("rev", "depth", F.coalesce("is_head", F.lit(False)).alias("is_head"), F.coalesce("is_base", F.lit(False)).alias("is_base"))


# tables of the session catalog: each query makes its own, changes it, keeps the rows and drops it


@contextmanager
def _made(spark, d, name, *, of=None, **more):
    """A database and a table in it with the rows of a driver table."""
    df = read(spark, d, name) if of is None else of
    db, key = Database(spark), f"tidemark_{uuid.uuid4().hex}"
    table = replace(Table.of(key, df), **more)
    try:
        db.run(ops.CreateTable(table))
        df.select(*spark.table(key).columns).write.insertInto(key)
        yield db, key
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {key}")


@query("""SELECT o_orderkey, o_totalprice AS price, o_orderstatus, 'orc' AS provider, 'o_orderstatus' AS partitioned_by, 'kept' AS note FROM orders""")
def swap_partitioned(spark, d):
    """Move-and-copy of a partitioned ORC table with a property."""
    storage = Storage("orc", ("o_orderstatus",), properties=(("note", "kept"),))
    with _made(spark, d, "orders", storage=storage) as (db, t):
        gone = ("o_custkey", "o_orderdate", "o_orderpriority")
        db.run(ops.Batch(t, (ops.AlterColumn(t, "o_totalprice", new_name="price"), *(ops.DropColumn(t, c) for c in gone))))
        now = db.reflect(t).storage
        facts = {"provider": now.provider, "partitioned_by": ",".join(now.partitions), "note": dict(now.properties).get("note")}
        return settle(spark.table(t).withColumns({k: F.lit(v) for k, v in facts.items()}))


@query("""SELECT c_custkey, c_name, true AS refused FROM customer""")
def batch_retype_unique(spark, d):
    """A retyping that would break a UNIQUE is refused, and the table stays as it was."""
    names = read(spark, d, "customer").select("c_custkey", F.col("c_name"), F.concat(F.col("c_custkey") % 10, F.lit("-"), "c_name").alias("code"))
    with _made(spark, d, "customer", of=names) as (db, t):
        db.run(ops.unique("uq", t, ["code"]))
        try:
            db.run(ops.AlterColumn(t, "code", type="int", mode="prefix"))
            refused = False
        except ValidationError:
            refused = True
        whole = db.reflect(t).column("code").type == "string"
        return settle(spark.table(t).select("c_custkey", "c_name", F.lit(refused and whole).alias("refused")))


@query("""SELECT 'ck_balance' AS name, 'check' AS kind, count(*) FILTER (WHERE NOT s_acctbal > 0) AS violations FROM supplier
UNION ALL SELECT 'pk', 'primary', 0""")
def drop_column_check(spark, d):
    """Checks follow a renamed column and go with a dropped one; the report runs on what is left."""
    with _made(spark, d, "supplier", constraints=(
        Constraint("ck_balance", "check", condition="s_acctbal > 0 or s_acctbal is null"), Constraint("ck_name", "check", condition="length(s_name) > 0"),
        Constraint("pk", "primary", ("s_suppkey",)),
    )) as (db, t):
        db.run(ops.Batch(t, (ops.AlterColumn(t, "s_acctbal", new_name="balance"), ops.DropColumn(t, "s_name"))))
        return settle(validate.report(db.reflect(t), {t: spark.table(t)}))


@query("""SELECT n_nationkey, 'unknown' AS n_name, n_regionkey FROM nation""")
def inverse_round_trip(spark, d):
    """A batch and its inverse: columns and their order are back, dropped values come from the fill."""
    with _made(spark, d, "nation") as (db, t):
        batch = db.known(ops.Batch(t, (
            ops.AlterColumn(t, "n_regionkey", new_name="region", type="bigint"), ops.DropColumn(t, "n_name", fill="'unknown'"),
            ops.AddColumn(t, Column("extra", "int", False, "1"), behind="n_nationkey"),
        ), (("n_nationkey", "extra", "region"),)))
        before = [(c.name, c.type) for c in db.reflect(t).columns]
        db.run(batch)
        db.run(batch.reverse())
        assert [(c.name, c.type) for c in db.reflect(t).columns] == before
        return settle(spark.table(t))


@query("""SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey + 100, upper(r_name) FROM region""")
def execute_statement(spark, d):
    """A statement of the user's own among the operations."""
    with _made(spark, d, "region") as (db, t):
        db.run(ops.Execute(f"INSERT INTO {t} SELECT r_regionkey + 100, upper(r_name) FROM {t}"))
        return settle(spark.table(t))


@query("""SELECT column_name, ordinal_position::INTEGER - 1 AS place,
  CASE data_type WHEN 'BIGINT' THEN 'long' WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'integer' WHEN 'DOUBLE' THEN 'double' END AS type,
  column_name <> 's_suppkey' AS nullable FROM information_schema.columns WHERE table_name = 'supplier'""")
def catalog_columns(spark, d):
    """The columns of a database's tables from one statement."""
    df = read(spark, d, "supplier")
    columns = tuple(Column(f.name, f.dataType.simpleString(), f.name != "s_suppkey") for f in df.schema.fields)
    with _made(spark, d, "supplier", columns=columns) as (db, t):
        return settle(db.columns().where(F.col("table_name") == t).select("column_name", F.col("place").cast("int"), "type", "nullable"))


# schema diff


def declared(spark, d) -> tuple[Catalog, Catalog]:
    """Tables as they are, with objects beside them, and what they are to become: made from one another."""
    have = {t: Table.of(t, read(spark, d, t)) for t in ("customer", "supplier", "nation")}
    customer = replace(
        have["customer"], comment="buyers", indexes=(Index("ix_segment", ("c_mktsegment",)),),
        constraints=(Constraint("fk_nation", "foreign", ("c_nationkey",), ("nation", ("n_nationkey",)), options=(("ON DELETE", "NO ACTION"),)),
                     Constraint("ck_balance", "check", condition="c_acctbal >= 0")),
    )
    supplier = replace(have["supplier"], constraints=(Constraint("fk_home", "foreign", ("s_nationkey",), ("nation", ("n_nationkey",))),))
    wanted = {
        "c_acctbal": lambda c: replace(c, type="decimal(12,2)", default="0"), "c_name": lambda c: replace(c, nullable=False, comment="full name"),
    }
    columns = tuple(wanted.get(c.name, lambda c: c)(c) for c in customer.columns if c.name != "c_mktsegment")
    after = replace(
        customer, columns=(*columns, Column("since", "date")), comment=None, indexes=(),
        constraints=(replace(customer.constraints[0], options=()), replace(customer.constraints[1], condition="c_acctbal > -1"),
                     Constraint("uq_name", "unique", ("c_name",))),
    )
    cascades = replace(supplier.constraints[0], options=(("ON DELETE", "CASCADE"),))
    moved = replace(supplier, comment="sellers", constraints=(cascades,))
    return Catalog((customer, supplier, have["nation"])), Catalog((after, moved, Table("contract", (Column("id", "int"),))))


@query(r"""WITH c AS (SELECT column_name AS col, table_name AS tbl FROM information_schema.columns)
SELECT 'add_table' AS kind, 'contract' AS tbl, NULL AS object, NULL AS old, NULL AS new
UNION ALL SELECT DISTINCT 'remove_table', tbl, NULL, NULL, NULL FROM c WHERE tbl = 'nation'
UNION ALL SELECT 'remove_column', tbl, col, 'string', NULL FROM c WHERE tbl = 'customer' AND col LIKE '%segment'
UNION ALL SELECT 'modify_type', tbl, col, 'double', 'decimal(12,2)' FROM c WHERE tbl = 'customer' AND col LIKE '%acctbal'
UNION ALL SELECT 'modify_default', tbl, col, NULL, '0' FROM c WHERE tbl = 'customer' AND col LIKE '%acctbal'
UNION ALL SELECT 'modify_nullable', tbl, col, 'true', 'false' FROM c WHERE tbl = 'customer' AND col LIKE '%\_name' ESCAPE '\'
UNION ALL SELECT 'modify_comment', tbl, col, NULL, 'full name' FROM c WHERE tbl = 'customer' AND col LIKE '%\_name' ESCAPE '\'
UNION ALL SELECT * FROM (VALUES ('add_column', 'customer', 'since', NULL, 'date'), ('remove_table_comment', 'customer', NULL, 'buyers', NULL),
 ('add_table_comment', 'supplier', NULL, NULL, 'sellers'), ('remove_index', 'customer', 'ix_segment', 'False:c_mktsegment', NULL),
 ('add_constraint', 'customer', 'uq_name', NULL, 'c_name'),
 ('remove_fk', 'supplier', 's_nationkey->nation(n_nationkey)', 's_nationkey->nation(n_nationkey)', NULL),
 ('add_fk', 'supplier', 's_nationkey->nation(n_nationkey) on delete cascade', NULL, 's_nationkey->nation(n_nationkey) on delete cascade')) v""")
def diff_catalogs(spark, d):
    return diff.compare(spark, *declared(spark, d), compare_defaults=True)


@query("""SELECT 'modify_comment' AS kind, 'customer' AS tbl, column_name AS object, NULL AS old, 'full name' AS new FROM information_schema.columns WHERE column_name = 'c_name'
UNION ALL SELECT 'modify_nullable', 'customer', column_name, 'true', 'false' FROM information_schema.columns WHERE column_name = 'c_name'
UNION ALL SELECT 'remove_table_comment', 'customer', NULL, 'buyers', NULL""")
def diff_filtered(spark, d):
    """Only one table, without some of its columns and all of its objects."""
    hidden = {"customer.c_acctbal", "customer.c_mktsegment", "customer.since"}

    def only(kind, name):
        return kind in ("table", "column") and name.startswith("customer") and name not in hidden

    return diff.compare(spark, *declared(spark, d), only=only)


@query("""WITH a AS (SELECT * FROM (VALUES ('part', 'p_partkey', 'bigint'), ('part', 'p_name', 'varchar(20)'), ('part', 'p_color', 'string'), ('old', 'x', 'int')) t(tbl, col, type)),
b AS (SELECT table_name AS tbl, column_name AS col, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' END AS type
  FROM information_schema.columns WHERE table_name IN ('part', 'nation'))
SELECT 'remove_table' AS kind, 'nation' AS tbl, NULL AS object, NULL AS old, NULL AS new
UNION ALL SELECT 'add_table', 'old', NULL, NULL, NULL
UNION ALL SELECT CASE WHEN b.col IS NULL THEN 'add_column' WHEN a.col IS NULL THEN 'remove_column' ELSE 'modify_type' END,
  'part', coalesce(a.col, b.col), b.type, a.type
FROM (SELECT * FROM a WHERE tbl = 'part') a FULL OUTER JOIN (SELECT * FROM b WHERE tbl = 'part') b ON a.col = b.col
WHERE a.type IS DISTINCT FROM b.type""")
def diff_reflected(spark, d):
    """Tables as they are against a declaration."""
    actual = Catalog(tuple(Table.of(t, read(spark, d, t)) for t in ("part", "nation")))
    desired = Catalog((
        Table("part", (Column("p_partkey", "bigint"), Column("p_name", "varchar(20)"), Column("p_color", "string"))),
        Table("old", (Column("x", "int"),)),
    ))
    return diff.compare(spark, actual, desired)


# Pairs of type texts, and whether they count as different.
_TYPES = [
    ("VARCHAR(30)", "VARCHAR(30)", False), ("VARCHAR(30)", "VARCHAR(40)", True), ("VARCHAR(30)", "INT", True),
    ("VARCHAR(30)", "VARCHAR", False), ("TEXT", "VARCHAR(255)", True), ("DECIMAL(10,5)", "DECIMAL(10,6)", True),
    ("DECIMAL(10,5)", "DECIMAL(10)", False), ("DECIMAL(10)", "DECIMAL(10,5)", False), ("DECIMAL(10,2)", "NUMERIC(10)", False),
    ("DECIMAL(10,5)", "NUMERIC(10,5)", False), ("DECIMAL(10,5)", "NUMERIC(12,5)", True), ("DECIMAL(10,5)", "TIMESTAMP", True),
    ("NUMERIC", "NUMERIC(scale=5)", False), ("INT", "INT", False), ("BIGINT", "INT", True), ("BIGINT", "BIGINT", False),
    ("BIGINT", "SMALLINT", True), ("INT", "SMALLINT", True), ("INT", "VARCHAR", True),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {x})" for a, b, x in _TYPES) + ") t(actual, desired, differs)")
def type_equivalence(spark, d):
    pairs = spark.createDataFrame([t[:2] for t in _TYPES], "actual string, desired string")
    return pairs.withColumn("differs", types_differ(F.col("actual"), F.col("desired")))


@query("""SELECT p_partkey, CASE WHEN length(s) > 12 THEN regexp_replace(substr(s, 1, 12), '_[^_]*$', '') ELSE s END AS slug
FROM (SELECT p_partkey, lower(array_to_string(regexp_extract_all(p_type || ' - ' || p_brand, '\\w+'), '_')) AS s FROM part)""")
def slug_names(spark, d):
    return read(spark, d, "part").select("p_partkey", slug(F.concat("p_type", F.lit(" - "), "p_brand"), 12).alias("slug"))


@query("""SELECT event_id, floor(epoch(ts))::BIGINT AS epoch, right(sha256(event_id::VARCHAR || chr(31) || event_type), 12) AS rev,
  strftime(ts - INTERVAL 5 HOUR, '%Y_%m_%d_%H%M') || '-' || right(sha256(event_id::VARCHAR || chr(31) || event_type), 12) || '_' || lower(event_type) AS name FROM events""")
def revision_names(spark, d):
    """Ids and file names of revisions, their time in a zone five hours behind."""
    rev = revision_id(F.col("event_id"), F.col("event_type"))
    return read(spark, d, "events").select(
        "event_id", stamp_parts(F.col("ts"))["epoch"].alias("epoch"), rev.alias("rev"),
        file_name(rev, F.col("event_type"), F.col("ts"), "-05:00").alias("name"),
    )


from . import change_queries  # noqa: E402, F401  (registers its queries here)
