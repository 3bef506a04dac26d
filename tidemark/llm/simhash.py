"""SimHash near-duplicates by pigeonring filtering.

A fingerprint is split into a ring of m segments of consecutive bits. If two fingerprints differ in at
most ``BITS`` bits, then somewhere on the ring a chain of segments starts whose every prefix of k
segments differs in at most k * BITS / m bits (the strong form of the pigeonring principle). The first
segments of the chain, whose budget is below one bit, are equal: they are the join key. The rest of the
chain is checked on the candidates before the full Hamming distance.

With 5 segments the key has two of them, about 26 of 64 bits; with 9, four and 28 bits; with 15, seven and
30 bits. More fingerprints take more segments (``segments``), so that a key tells them apart however large
the table is, for as many rows a fingerprint as segments.

A key shared by more than ``DENSE`` fingerprints is lengthened to all segments of the chain but the last: on these the
chain's budget is one bit, so a fingerprint looks under its own long key and under those one bit of a budgeted segment
away, and what it meets is checked on the chain and on the full distance. Fingerprints of one long key differ in the last
segment only, some 4 to 13 bits. Of more than ``DENSE`` such, which are the copies of one text, not all pairs are listed: each goes under itself
with at most one bit flipped that the key does not hold, and is linked, after the check, to the smallest that it meets
there. Two that meet are at most two bits apart, and two that are so do meet; that is exact and linear.

Edge cases: null texts and those without words have fingerprint zero and are linked like any other; repeated
rows fall into one component; very long texts are hashed in parts; a null doc_id is the smallest of a
component only where all are null; extra columns are left out; an empty table gives an empty result.

Equal fingerprints are one node. Components come from ``common.components``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forget, settle, sliced

BITS = 2
SHINGLE = 3
DENSE = 32

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """64 bits as an unsigned number; 0 for a null text or one without words."""
    found = _WORD.findall((text or "").encode().translate(_LOWER))
    if not found:
        return 0
    if len(found) <= words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words))))
    return bits(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64))


def bits(h: np.ndarray) -> int:
    """The fingerprint of hashes ``h``: bits that over half of them have set."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):  # a long text in parts
        part = h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


class _Fingerprints:
    """The ``text`` column of a batch replaced by _fp, its fingerprint as a signed long."""

    def __init__(self, words: int):
        self.words = words

    def __call__(self, batches):
        for batch in sliced(batches):
            at = batch.schema.names.index("text")
            fps = np.fromiter((fingerprint(x.as_py(), self.words) for x in batch.column(at)), np.uint64, len(batch))
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fps.view(np.int64))], names=[*names, "_fp"])


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """``docs`` without its text, with _fp."""
    schema = docs.drop("text").schema.add("_fp", "long")
    return docs.mapInArrow(_Fingerprints(words), schema)


def segments(count: int) -> int:
    """Segments of the ring for so many distinct fingerprints: keys of random ones stay sparse."""
    return next((m for m, most in ((5, 1 << 28), (9, 1 << 31)) if count < most), 15)


class _Ring:
    """Bits of a fingerprint as a ring of ``m`` segments."""

    def __init__(self, m: int):
        self.m = m
        self.widths = [64 * (i + 1) // m - 64 * i // m for i in range(m)]
        self.starts = [64 * i // m for i in range(m)]
        self.held = next(k for k in range(1, m + 1) if (k + 1) * BITS >= m)  # segments with a budget below one bit

    def segment(self, fp, i: int):
        i %= self.m
        return F.shiftrightunsigned(fp, self.starts[i]).bitwiseAND(F.lit((1 << self.widths[i]) - 1))

    def key(self, fp, i: int, n: int | None = None):
        """The first segments of the chain from segment i: those that are held, or ``n``."""
        out = F.lit(0).cast("long")
        for j in range(i, i + (n or self.held)):
            out = F.shiftleft(out, self.widths[j % self.m]).bitwiseOR(self.segment(fp, j))
        return out

    def chain(self, differ, i: int):
        """The budgets of the longer prefixes of the chain from segment i."""
        total, out = F.lit(0), F.lit(True)
        for k in range(self.held + 1, self.m):
            total = total + F.bit_count(self.segment(differ, i + k - 1))
            out = out & (total <= k * BITS // self.m)
        return out

    def flips(self, i: int, last: bool = True) -> list:
        """One-bit flips outside the segments that members of a key share; without the chain's ``last`` segment if so."""
        spared = range(i, i + self.held) if last else [*range(i, i + self.held), i + self.m - 1]
        held = {j % self.m for j in spared}
        bits = [self.starts[j] + b for j in range(self.m) if j not in held for b in range(self.widths[j])]
        return [F.lit(((1 << b) + (1 << 63)) % (1 << 64) - (1 << 63)).cast("long") for b in bits]

    def by_ring(self, value):
        """``value(i)`` of the column ring."""
        return F.coalesce(*(F.when(F.col("ring") == i, value(i)) for i in range(self.m)))


def links(fps: DataFrame, m: int | None = None) -> DataFrame:
    """Of distinct fingerprints ``fps`` (fp long): links (a, b), enough to connect all that differ in ``BITS`` bits or fewer.

    Every link is a true one; all true ones are there but those within a crowded long key, which are a star for each flip.
    """
    found = _links(fps, m)
    return found.select("a", "b").distinct()


def _links(fps: DataFrame, m: int | None = None) -> DataFrame:
    """a, b and by: chain (of a sparse key), long (of a lengthened one), star."""
    m = m or segments(fps.count())
    ring = _Ring(m)
    keys = [F.struct(F.lit(i).alias("ring"), ring.key(F.col("fp"), i).alias("key")) for i in range(m)]
    ringed = settle(fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.ring", "k.key"))
    counts = settle(ringed.groupBy("ring", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    shared = settle(ringed.join(counts, ["ring", "key"]))
    forget(ringed, counts)
    differ = F.col("fp").bitwiseXOR(F.col("other"))
    near = ring.by_ring(lambda i: ring.chain(differ, i)) & (F.bit_count(differ) <= BITS)
    pair = F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")

    few = shared.where(F.col("size") <= DENSE).select("ring", "key", "fp")
    others = few.select("ring", "key", F.col("fp").alias("other"))
    sparse = few.join(others, ["ring", "key"]).where((F.col("fp") < F.col("other")) & near).select(*pair, F.lit("chain").alias("by"))

    dense = shared.where(F.col("size") > DENSE).select("ring", "fp")
    dense = settle(dense.withColumn("long", ring.by_ring(lambda i: ring.key(F.col("fp"), i, m - 1))))
    cells = settle(dense.groupBy("ring", "long").agg(F.count(F.lit(1)).alias("size")))
    celled = settle(dense.join(cells, ["ring", "long"]))
    forget(dense, cells)
    none = F.lit(0).cast("long")
    asking = celled.where(F.col("size") <= DENSE).withColumn("flip", F.explode(ring.by_ring(lambda i: F.array(none, *ring.flips(i, False)))))
    asking = asking.withColumn("flipped", F.col("fp").bitwiseXOR(F.col("flip")))
    asking = settle(asking.select("ring", "fp", ring.by_ring(lambda i: ring.key(F.col("flipped"), i, m - 1)).alias("long")))
    asked = celled.select("ring", "long", F.col("fp").alias("other"), (F.col("size") > DENSE).alias("crowd"))
    longer = asking.join(asked, ["ring", "long"]).where((F.col("crowd") | (F.col("fp") < F.col("other"))) & near).select(*pair, F.lit("long").alias("by"))

    crowd = celled.where(F.col("size") > DENSE).select("ring", "fp")
    crowd = crowd.withColumn("flip", F.explode(ring.by_ring(lambda i: F.array(none, *ring.flips(i)))))
    flipped = settle(crowd.withColumn("at", F.col("fp").bitwiseXOR(F.col("flip"))).drop("flip"))
    heads = settle(
        flipped.groupBy("ring", "at").agg(F.min("fp").alias("other"), F.max("fp").alias("last")).where("other < last").drop("last")
    )
    stars = flipped.join(heads, ["ring", "at"]).where((F.col("fp") != F.col("other")) & (F.bit_count(differ) <= BITS))
    return sparse.unionAll(longer).unionAll(stars.select(*pair, F.lit("star").alias("by")))


def grouped(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """``docs`` (doc_id, text and others): doc_id and other columns but text, _fp, _component (smallest doc_id reachable).

    Null and wordless texts have fingerprint 0 and are linked like any other. Repeated rows fall into
    one component; a null doc_id is never the smallest unless all are null. Columns called _fp or _component are replaced.
    """
    docs = docs.drop("_fp", "_component")
    prints = settle(fingerprints(docs, words))
    nodes = settle(prints.groupBy(F.col("_fp").alias("fp")).agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp")))
    rooted = settle(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    lowest = settle(rooted.groupBy("root").agg(F.min("least").alias("_component")))
    classes = settle(rooted.join(lowest, "root").select(F.col("fp").alias("_fp"), "_component"))
    forget(nodes, roots, rooted, lowest)
    return prints.join(classes, "_fp")


def op6(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, fingerprint, component_id."""
    out = grouped(docs.select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.col("_component").alias("component_id"),
    )


def brute_force(rows: list[tuple[int, str]]) -> list[tuple]:
    """op6 for a small fixture: all pairs."""
    prints = {i: fingerprint(t) for i, t in rows}
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= BITS:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((i, f"{prints[i]:016x}", find(i)) for i in ids)
