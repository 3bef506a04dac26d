"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

Services often log a conversation again after each turn. A rolling hash of each prefix of turns tells
which logged conversations are prefixes of longer ones: a turn's hash covers its place, role and text,
and a prefix's hash is the sum of its turns' hashes, in four 32-bit lanes, so that it comes from
running sums. Turns are placed by one range-partitioned sort of all of them, so that neither a long
conversation nor one whose turn numbers are null or equal is a group of its own; sums are taken in
two passes, within blocks of ``BLOCK`` turns and over the blocks' totals. Equal conversations are one
group (the smallest conv_id stays), and an anti-join drops the groups that are proper prefixes.
Both sides have one row for each distinct prefix, however many conversations share it. Prefixes are
told by 128 bits of hash and their length, not compared turn by turn.

What stays is rendered in ChatML, a row for each ``BLOCK`` turns of a conversation, by position.

Edge cases: repeated rows (same conv_id, turn, role and text) count once; turns with the same number
are ordered by role, then text; null turns come first, null conv_ids are one conversation, null roles
and texts are rendered as empty but differ from empty ones in the hash; extra columns are left out;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, settle

BLOCK = 256
LANES = ["l0", "l1", "l2", "l3"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, block, pos (1-based in the conversation), role, text, and the rolling prefix lanes."""
    own = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").distinct()
    own = settle(numbered(own, [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")], "place"))
    first = settle(own.groupBy(F.col("conv_id").alias("own_conv")).agg(F.min("place").alias("first")))
    pos = F.col("place") - F.col("first") + 1
    own = own.join(first, F.col("conv_id").eqNullSafe(F.col("own_conv"))).select("conv_id", "role", "text", pos.alias("pos"))
    own = own.withColumn("block", F.floor((F.col("pos") - 1) / BLOCK))
    whole = [F.isnull("role"), F.isnull("text"), F.col("pos"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    own = own.withColumn("a", F.xxhash64(*whole)).withColumn("b", F.xxhash64(F.lit("b"), *whole))
    low = F.lit((1 << 32) - 1)
    words = [F.col("a").bitwiseAND(low), F.shiftrightunsigned("a", 32), F.col("b").bitwiseAND(low), F.shiftrightunsigned("b", 32)]
    own = settle(own.select("conv_id", "block", "pos", "role", "text", *(w.alias(x) for w, x in zip(words, LANES))))
    totals = own.groupBy("conv_id", "block").agg(*(F.sum(x).alias(x) for x in LANES))
    running = Window.partitionBy("conv_id", "block").orderBy("pos")
    summed = own.select("conv_id", "block", "pos", "role", "text", *(F.sum(x).over(running).alias(x) for x in LANES))
    return settle(
        summed.join(_before(totals, LANES), _same_block(), "inner").select(
            summed["conv_id"], summed["block"], "pos", "role", "text",
            *((summed[x] + F.col(f"{x}_before")).alias(x) for x in LANES),
        )
    )


def _before(blocks: DataFrame, names: list[str]) -> DataFrame:
    """For each block, the sums of the blocks before it in its conversation: one row a block."""
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = (F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"{x}_before") for x in names)
    return blocks.select(F.col("conv_id").alias("own_conv"), F.col("block").alias("own_block"), *sums)


def _same_block():
    return F.col("conv_id").eqNullSafe(F.col("own_conv")) & (F.col("block") == F.col("own_block"))


def maximal(placed: DataFrame) -> DataFrame:
    """Of ``turns``: conv_id, n_turns, n_copies of the conversations that are no proper prefix of another."""
    key = ["pos", *LANES]
    last = placed.groupBy("conv_id").agg(F.max(F.struct(*key)).alias("k")).select("conv_id", "k.*")
    whole = settle(last.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies")))
    prefixes = settle(placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")))
    # Each of the equal conversations has its whole as a prefix once; any more are prefixes of longer ones.
    proper = whole.join(prefixes, key).where("n > n_copies").select(*key)
    return whole.join(settle(proper), key, "left_anti").select("conv_id", F.col("pos").cast("long").alias("n_turns"), "n_copies")


def chat_format(conversations: DataFrame) -> DataFrame:
    """conv_id, part_start (0-based turn), part_turns, n_turns, n_copies, text: maximal conversations in ChatML."""
    placed = turns(conversations)
    kept = settle(maximal(placed)).withColumnRenamed("conv_id", "own_conv")
    line = F.concat(
        F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n")
    )
    own = placed.select("conv_id", "block", "pos", line.alias("line")).join(
        kept, F.col("conv_id").eqNullSafe(F.col("own_conv"))
    )
    parts = own.groupBy("conv_id", "block", "n_turns", "n_copies").agg(
        F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("lines")
    )
    return parts.select(
        "conv_id",
        (F.col("lines")[0]["pos"] - 1).cast("long").alias("part_start"),
        F.size("lines").cast("long").alias("part_turns"),
        "n_turns", "n_copies",
        F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"),
    )


ORACLE = """
WITH own AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM own),
prefixed AS (
  SELECT *, md5(string_agg(md5(coalesce('r' || role, '')) || md5(coalesce('t' || text, '')), '')
                OVER (PARTITION BY conv_id ORDER BY pos)) AS h
  FROM placed),
proper AS (SELECT DISTINCT pos, h FROM prefixed WHERE pos < n_turns),
kept AS (
  SELECT min(conv_id) AS conv_id, count(*) AS n_copies
  FROM prefixed p WHERE pos = n_turns AND NOT EXISTS (SELECT 1 FROM proper q WHERE q.pos = p.pos AND q.h = p.h)
  GROUP BY pos, h)
SELECT p.conv_id, min(pos) - 1 AS part_start, count(*) AS part_turns, n_turns, n_copies,
       string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
                  ORDER BY pos) AS text
FROM placed p JOIN kept k ON p.conv_id = k.conv_id
GROUP BY p.conv_id, floor((pos - 1) / 256), n_turns, n_copies
"""
