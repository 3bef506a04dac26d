"""Sharding by fixed virtual slots.

A record's hash puts it into one of ``SLOTS`` slots for good. Bytes and rows are summed by slot, which gives ``SLOTS`` sums
however many records there are, and a map from slots to shards is made from them: the heaviest slot first, each to the
lightest shard. The map is stored as a version; rebalancing and growing edit single entries and store the next
version, so only the records of moved slots move. A version is written once: of two writers of one number the
later one fails.

The law that holds is ``bytes``: shards' sizes are near equal (they differ by little more than a slot's, or one very large
record's). A record's place in its shard is its place in its slot, plus the rows of the shard's slots before; places
in slots are numbered by ``PIECES`` pieces of each slot, so that no task gets a whole slot.

Edge cases: a null text has no bytes and counts as size 1; a null doc_id is hashed by its text; repeated rows lie in one
piece of one slot and take a place each; extra columns are left out (``write`` keeps them all); an empty table has a map and no
rows.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from .common import settle

SLOTS, SHARDS, PIECES = 8192, 16, 4


def _hash() -> Column:
    """Of the id's decimal digits; 32 bits."""
    text = F.concat(F.lit("text "), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), text).cast("binary")), 1, 8), 16, 10).cast("long")


def measured(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, piece of each record."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    own = docs.select("doc_id", "text", (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), _hash().alias("_hash"))
    return own.select(
        "doc_id", "size", "text_crc32", (F.col("_hash") % slots).cast("int").alias("virtual_slot"), F.expr(f"int(_hash div {slots} % {PIECES})").alias("piece")
    )


def weights(records: DataFrame) -> dict[int, int]:
    """Bytes of each slot that has any."""
    return {s: int(n) for s, n in records.groupBy("virtual_slot").agg(F.sum("size")).collect()}  # a row for each slot


@dataclass(frozen=True)
class SlotMap:
    """``owners``: the shard of each slot."""

    version: int
    shards: int
    owners: tuple[int, ...]

    @staticmethod
    def first(sizes: Mapping[int, int], shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
        """Heaviest slot first, each to the lightest shard; slots without records go round."""
        owners = [s % shards for s in range(slots)]
        loads = [(0, shard) for shard in range(shards)]
        for slot in sorted((s for s in sizes if sizes[s]), key=lambda s: (-sizes[s], s)):
            load, shard = loads[0]
            owners[slot] = shard
            heapq.heapreplace(loads, (load + sizes[slot], shard))
        return SlotMap(1, shards, tuple(owners))

    def loads(self, sizes: Mapping[int, int]) -> list[int]:
        out = [0] * self.shards
        for slot, n in sizes.items():
            out[self.owners[slot]] += n
        return out

    def moved(self, moves: Mapping[int, int]) -> SlotMap:
        """The next version, with the given slots' new shards."""
        owners = tuple(moves.get(s, o) for s, o in enumerate(self.owners))
        return replace(self, version=self.version + 1, owners=owners, shards=max(self.shards, *(m + 1 for m in moves.values()), 0))

    def grown(self, sizes: Mapping[int, int]) -> SlotMap:
        """One more shard, which takes from the others, the heaviest first, what they have beyond the new share; no other slot moves."""
        new, loads, moves = self.shards, self.loads(sizes), {}
        share = sum(loads) / (new + 1)
        own = self._by_shard(sizes)
        got, fullest = 0, [(-n, shard) for shard, n in enumerate(loads)]
        heapq.heapify(fullest)
        while fullest and got < share:
            load, shard = heapq.heappop(fullest)
            while own[shard] and own[shard][-1][0] > min(share - got, -load - share):  # what doesn't fit now never will
                own[shard].pop()
            if own[shard]:
                n, slot = own[shard].pop()
                moves[slot], got = new, got + n
                heapq.heappush(fullest, (load + n, shard))
        empty = [s for s in range(len(self.owners)) if not sizes.get(s)]
        moves |= dict.fromkeys(empty[:: new + 1], new)
        return replace(self.moved(moves), shards=new + 1)

    def rebalanced(self, sizes: Mapping[int, int], tolerance: float = 0.02) -> SlotMap:
        """Slots go from the heaviest shard to the lightest one while that is more than ``tolerance`` from the mean and helps."""
        loads, own, owners = self.loads(sizes), self._by_shard(sizes), {}
        mean = sum(loads) / self.shards
        while True:
            high, low = max(range(self.shards), key=lambda s: (loads[s], -s)), min(range(self.shards), key=lambda s: (loads[s], s))
            gap = loads[high] - loads[low]
            helps = [x for x in own[high] if 0 < x[0] < gap]
            fit = next((x for x in reversed(helps) if 2 * x[0] <= gap), helps[0] if helps else None)
            if loads[high] <= mean * (1 + tolerance) and loads[low] >= mean * (1 - tolerance) or fit is None:
                return self.moved(owners) if owners else self
            n, slot = fit
            own[high].remove(fit)
            own[low] = sorted([*own[low], fit])
            owners[slot], loads[high], loads[low] = low, loads[high] - n, loads[low] + n

    def _by_shard(self, sizes: Mapping[int, int]) -> list[list[tuple[int, int]]]:
        out: list[list[tuple[int, int]]] = [[] for _ in range(self.shards)]
        for slot, n in sizes.items():
            out[self.owners[slot]].append((n, slot))
        return [sorted(x) for x in out]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s, o, self.shards) for s, o in enumerate(self.owners)], "virtual_slot int, shard int, shards int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the version; an error if it is there already."""
        self.frame(spark).coalesce(1).write.mode("error").parquet(f"{path}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """That version, or the last one."""
        stored = spark.read.parquet(path)
        version = version or stored.agg(F.max("version")).first()[0]
        rows = sorted(stored.where(F.col("version") == version).select("virtual_slot", "shard", "shards").collect())  # a row for each slot
        if not rows:
            raise ValueError(f"{path} has no version {version}")
        return SlotMap(version, rows[0][2], tuple(r[1] for r in rows))


def placed(records: DataFrame, slot_map: SlotMap) -> DataFrame:
    """``records`` with ``shard`` and ``slot``, the gapless place in the shard."""
    spark = records.sparkSession
    counts = records.groupBy("virtual_slot", "piece").agg(F.count(F.lit(1)).alias("n"))
    owners = slot_map.frame(spark).select("virtual_slot", "shard")
    before = Window.partitionBy("shard").orderBy("virtual_slot", "piece")  # of SLOTS * PIECES counts at most
    bases = counts.join(F.broadcast(owners), "virtual_slot").withColumn("base", F.sum("n").over(before) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("virtual_slot", "piece").orderBy("doc_id", "text_crc32", "size"))
    ranked = records.withColumn("_row", within - 1)
    return ranked.join(F.broadcast(bases), ["virtual_slot", "piece"]).withColumn("slot", F.col("base") + F.col("_row")).drop("base", "_row", "piece")


def write(docs: DataFrame, slot_map: SlotMap, path: str, only: Iterable[int] | None = None) -> None:
    """The documents with all columns as Parquet, a folder for each shard and files by slot; ``only``: those shards.

    The shard's column is ``_shard``; documents may not have one of that name.
    """
    owners = slot_map.frame(docs.sparkSession).select("virtual_slot", F.col("shard").alias("_shard"))
    slot = (_hash() % len(slot_map.owners)).cast("int")
    own = docs.select(F.struct("*").alias("_row"), slot.alias("virtual_slot")).join(F.broadcast(owners), "virtual_slot")
    if only is not None:
        own = own.where(F.col("_shard").isin(*only))
    own.repartition("_shard", "virtual_slot").select("_row.*", "_shard").write.mode("overwrite").partitionBy("_shard").parquet(path)


def op13(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; and the virtual slot and the map's version."""
    spark = docs.sparkSession
    records = settle(measured(docs))
    maps = f"{scratch(spark).rstrip('/')}/slots-{uuid.uuid4().hex}"
    SlotMap.first(weights(records), shards).save(spark, maps)
    slot_map = SlotMap.load(spark, maps)
    return placed(records, slot_map).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot", F.lit(slot_map.version).alias("map_version"),
    )


ORACLE = f"""WITH RECURSIVE steps AS (SELECT i, 0 AS k, i AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
records AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h,
  ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT AS hash FROM documents),
hashed AS (SELECT doc_id, size, (hash % {SLOTS})::INTEGER AS virtual_slot, hash // {SLOTS} % {PIECES} AS piece,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM records, crc),
sums AS MATERIALIZED (SELECT virtual_slot, sum(size) AS n, row_number() OVER (ORDER BY sum(size) DESC, virtual_slot) AS k FROM records, LATERAL (SELECT (hash % {SLOTS})::INTEGER AS virtual_slot) GROUP BY 1),
dealt AS (SELECT 0::BIGINT AS k, -1 AS virtual_slot, -1 AS shard, list_transform(range({SHARDS}), lambda i: 0::HUGEINT) AS loads
  UNION ALL SELECT s.k, s.virtual_slot, d.at - 1, list_transform(d.loads, lambda x, i: CASE WHEN i = d.at THEN x + s.n ELSE x END)
  FROM (SELECT *, list_position(loads, list_min(loads)) AS at FROM dealt) d JOIN sums s ON s.k = d.k + 1)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, piece, doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard, virtual_slot, 1::INTEGER AS map_version
FROM hashed JOIN dealt USING (virtual_slot)"""
