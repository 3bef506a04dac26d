"""Shared pieces of the training-data operators: table reading, lineage cuts, row keys, components."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import forget, settle, settled

__all__ = ["components", "fold", "forget", "keyed", "numbered", "settle", "settled", "sliced", "table", "unfold"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of the slices in which texts are worked on in Python. Spark bounds the bytes of a batch (64 MB).
BATCH = 2000


def sliced(batches):
    """The rows of ``batches``, ``BATCH`` at a time.

    Arrow and the C library keep what was freed; a worker lives on after its task, beside the next stages' memory, and so gives it back.
    """
    pool, trim = pa.default_memory_pool(), getattr(ctypes.CDLL(None), "malloc_trim", None)
    for batch in batches:
        for i in range(0, batch.num_rows, BATCH):
            yield batch.slice(i, BATCH)
        del batch
        pool.release_unused()
        if trim:  # of glibc
            trim(0)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with a gapless 0-based rank in the given order, without a single-task sort.

    Two passes: rows are range-partitioned and numbered inside each partition, then the sums of the
    partitions before are added. Only one count per partition is brought together.
    """
    parts = settle(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    starts = (
        parts.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_base", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
        .select("_part", "_base")
    )
    return (
        parts.join(F.broadcast(starts), "_part")  # one row per partition
        .withColumn(name, F.col("_base") + F.col("_seq"))
        .drop("_part", "_seq", "_base")
    )


def keyed(docs: DataFrame, name: str = "_key") -> DataFrame:
    """``docs`` with a unique, non-null long key whose order is that of doc_id.

    Where doc_id is unique and never null, the key is doc_id. Otherwise rows are numbered by doc_id
    (nulls first) and text; rows that repeat each other entirely count as separate documents.
    """
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if odd.isEmpty():
        return docs.withColumn(name, F.col("doc_id"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    return settle(numbered(docs, order, name))


def fold(docs: DataFrame) -> DataFrame:
    """``docs`` as doc_id, text and _rest, a struct of all other columns: names in it can't clash with ours."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others, *([] if others else [F.lit(0).alias("_")])).alias("_rest"))


def unfold(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the table that was folded, in its order; n_chars counts the text as it is now."""

    def column(c):
        if c in ("doc_id", "text"):
            return F.col(c)
        old = F.col("_rest").getField(c)
        return (F.length("text").cast(df.schema["_rest"].dataType[c].dataType) if c == "n_chars" else old).alias(c)

    return df.select(*(column(c) for c in columns))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a long, b long): rows (node, root), root the smallest node.

    Alternating large-star and small-star rounds: each is a min per node and a join on it. The minima
    are settled first, so that the join is between two plain shuffles, which Spark can split for a
    node with very many neighbours; a round's tables go when the next one is written. Nodes without
    edges are not listed.
    """
    pairs = settle(_ordered(edges))
    seen = None
    state = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
    while True:
        both = pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a")))
        low = settle(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = settle(_ordered(large))
        lower = settle(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(lower, "a").select("a", "b", "m")
        small = small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        written = Observation()
        after = settle(_ordered(small).observe(written, *state))
        forget(pairs, low, large, lower)
        pairs, now = after, written.get
        if now == seen:
            break
        seen = now
    roots = pairs.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    centres = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    out = settle(roots.union(centres))
    forget(pairs)
    return out


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller end, loops dropped."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
