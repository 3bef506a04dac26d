"""Embedding near-duplicates by spherical-cap filters.

Filter directions are a structured random product code: after a random rotation the dimensions are
cut into ``BLOCKS`` blocks, each with its own random codewords, and a direction is one codeword from
each block. A vector is list-decoded to *all* directions whose scalar product with it reaches the
cap's height: block by block, partial sums that can no longer reach it are pruned. Vectors of one
label that share a filter are compared by their cosine in double precision. The number of filters
grows with the number of vectors and the height follows from it, so that a filter has about
``OCCUPANCY`` vectors at any size. Product codes reach some vectors with few directions or none; such
a vector's caps are lowered to the height of its ``FILTERS``-th best direction.

Close vectors have close scores for every direction, so most of their lists agree: at cosine 0.98
about two filters of three, and the chance to share none of 16 is far below one in a hundred. Recall
is measured against brute force in the tests: whole on usual tables, at least 0.95 where all pairs are
just at the threshold.

Equal vectors are one class; pairs are counted between classes and never written out: a comparison
of a filter's vectors gives each class its number of linked vectors (a pair counts in the first
filter that both have) and the smallest class that it reaches there. Filters with more than ``TILE``
classes are compared in tiles of chunks, so no task holds more than two chunks.

Edge cases: null labels, null, zero or non-finite vectors (or components) link with nothing; vectors
of different lengths neither; repeated rows are linked copies; a null vec_id never names a component that
has others (a component of null ids only is null, and they are kept); vec_id has to be of an integer
type; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, settle

COSINE, FILTERS, OCCUPANCY, BLOCKS, TILE, SEED = 0.98, 16, 4.0, 3, 1024, 20_240_601


class Caps:
    """The filters for ``n`` vectors of ``dim`` dimensions."""

    def __init__(self, dim: int, n: int, filters: int = FILTERS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.dim, blocks = dim, min(BLOCKS, dim)
        self.words = max(4, int(np.ceil((filters * n / OCCUPANCY) ** (1 / blocks))))
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.cuts = np.linspace(0, dim, blocks + 1).astype(int)
        self.code = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:]):
            c = rng.normal(size=(self.words, b - a))
            self.code.append(c / np.linalg.norm(c, axis=1, keepdims=True) * np.sqrt((b - a) / dim))
        self.least = min(filters, self.words**blocks)
        self.threshold = self.cap(dim, min(0.5, filters / 2 / self.words**blocks))
        ranks = np.indices((min(self.least, self.words),) * blocks).reshape(blocks, -1)
        self.ranks = ranks[:, np.prod(ranks + 1, axis=0) <= self.least]  # the k best sums are among these ranks

    @staticmethod
    def cap(dim: int, share: float) -> float:
        """The height at which a cap has this share of the sphere."""
        x = np.linspace(-1, 1, 200_001)
        density = np.maximum(1 - x * x, 1e-12) ** ((dim - 3) / 2)
        above = 1 - np.cumsum(density) / density.sum()
        return float(x[np.argmax(above <= share)])

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and filters of all (row, filter) whose cap the row is in; rows ascend."""
        turned = unit @ self.rotation
        scores = [turned[:, a:b] @ c.T for a, b, c in zip(self.cuts[:-1], self.cuts[1:], self.code)]
        ranked = [-np.sort(-s, axis=1) for s in scores]
        best = [s[:, 0] for s in ranked]
        sums = sum(s[:, r] for s, r in zip(ranked, self.ranks))
        height = np.minimum(self.threshold, -np.partition(-sums, self.least - 1, axis=1)[:, self.least - 1]) - 1e-12
        row, filter_, got = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for i, s in enumerate(scores):
            ahead = sum(best[i + 1 :], np.zeros(len(unit)))
            need = height[row] - got - ahead[row]
            at, word = np.nonzero(s[row] >= need[:, None])
            row, filter_, got = row[at], filter_[at] * self.words + word, got[at] + s[row[at], word]
        order = np.lexsort((filter_, row))
        return row[order], filter_[order]


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # else squares of very large or small numbers leave the range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class _Valid:
    """vec_id, embedding, label to vec_id, label, vec (binary), dim: null vec where the vector is not valid."""

    def __init__(self, kind: str):
        self.kind = kind

    def __call__(self, batches):
        for batch in batches:
            raw, dim = [], []
            for x in batch.column(1):
                v = x.values
                ok = v is not None and len(v) and not v.null_count
                v = v.to_numpy(zero_copy_only=False).astype(self.kind) + 0.0 if ok else None  # + 0.0: no negative zeros
                ok = ok and np.isfinite(v).all() and v.any()
                raw.append(v.astype(self.kind).tobytes() if ok else None)
                dim.append(len(v) if ok else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(raw, pa.binary()), pa.array(dim, pa.int32())],
                names=["vec_id", "label", "vec", "dim"],
            )


class _Spread:
    """Classes to one row for each of their filters."""

    def __init__(self, caps: Caps, kind: str, narrow: bool):
        self.caps, self.kind, self.narrow = caps, kind, narrow

    def __call__(self, batches):
        for batch in batches:
            for s in range(0, len(batch), 2000):
                part = batch.slice(s, 2000)
                raw = part.column(3).to_pylist()
                row, filter_ = self.caps.decode(_unit(raw, self.kind))
                take = pa.array(row)
                columns = [part.column(1).take(take), pa.array(filter_)]
                names = ["label", "filter"]
                if not self.narrow:
                    lists = np.split(filter_, np.cumsum(np.bincount(row, minlength=len(part)))[:-1])
                    lists = pa.array([x.tobytes() for x in lists], pa.binary())
                    columns += [part.column(i).take(take) for i in (0, 2, 3)] + [lists.take(take)]
                    names += ["cid", "size", "vec", "filters"]
                yield pa.RecordBatch.from_arrays(columns, names=names)


class _Compare:
    """Rows of one filter (and tile), together in order: cid, links, least."""

    def __init__(self, kind: str, cosine: float):
        self.kind, self.cosine = kind, cosine

    def __call__(self, batches):
        rest = None
        for batch in batches:
            whole = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            keys = list(zip(*(whole.column(i).to_pylist() for i in range(4))))  # label, filter, a, b
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for s, e in zip(cuts[:-2], cuts[1:-1]):
                if e - s > 1:
                    yield from self.group(whole.slice(s, e - s), *keys[s][1:])
            rest = whole.slice(cuts[-2])
        if rest is not None and len(rest) > 1:
            yield from self.group(rest, *(rest.column(i)[0].as_py() for i in (1, 2, 3)))

    def group(self, rows, filter_, a, b):
        chunk, cid, size = (rows.column(i).to_numpy() for i in (4, 5, 6))
        unit = _unit(rows.column(7).to_pylist(), self.kind)
        near = unit @ unit.T >= self.cosine
        np.fill_diagonal(near, False)
        if a != b:
            near &= (chunk[:, None] != chunk[None, :])  # pairs inside a chunk belong to its own tile
        x, y = np.nonzero(near)
        if not len(x):
            return
        # A pair counts here if no smaller filter has both: products of the members' incidence with those filters.
        lists = [own[own < filter_] for own in (np.frombuffer(r, np.int64) for r in rows.column(8).to_pylist())]
        member = np.repeat(np.arange(len(lists)), [len(own) for own in lists])
        _, column = np.unique(np.concatenate(lists), return_inverse=True)
        shared = np.zeros(near.shape, bool)
        for s in range(0, int(column.max(initial=-1)) + 1, 2048):
            here = (column >= s) & (column < s + 2048)
            incidence = np.zeros((len(lists), 2048), np.float32)
            incidence[member[here], column[here] - s] = 1
            shared |= incidence @ incidence.T > 0
        first = ~shared[x, y]
        links = np.bincount(x, weights=size[y] * first, minlength=len(cid)).astype(np.int64)
        least = cid.copy()
        while True:
            low = least.copy()
            np.minimum.at(low, x, least[y])
            if (low == least).all():
                break
            least = low
        linked = np.bincount(x, minlength=len(cid)) > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(cid[linked]), pa.array(links[linked]), pa.array(least[linked])], names=["cid", "links", "least"]
        )


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, tile: int = TILE, filters: int = FILTERS) -> DataFrame:
    """Of ``embeddings`` (vec_id long, embedding array, label): vec_id, n_links, component_id."""
    spark = embeddings.sparkSession
    if embeddings.schema["vec_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("vec_id is not of an integer type")
    embeddings = embeddings.withColumn("vec_id", F.col("vec_id").cast("long"))
    kind = "<f4" if embeddings.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    label = embeddings.schema["label"].dataType.simpleString()
    vectors = settle(
        embeddings.select("vec_id", "embedding", "label").mapInArrow(
            _Valid(kind), f"vec_id long, label {label}, vec binary, dim int"
        )
    )
    valid = vectors.where("vec is not null and label is not null")
    classes = settle(
        valid.groupBy("label", "dim", "vec")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    found = []
    for dim, n in sorted(tuple(r) for r in classes.groupBy("dim").count().collect()):  # vector lengths: a few
        caps = Caps(dim, n, filters)
        own = classes.where(F.col("dim") == dim).select("cid", "label", "size", "vec")
        heavy = settle(
            own.mapInArrow(_Spread(caps, kind, True), f"label {label}, filter long")
            .groupBy("label", "filter").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > tile)
        )
        rows = own.mapInArrow(
            _Spread(caps, kind, False), f"label {label}, filter long, cid long, size long, vec binary, filters binary"
        )
        if heavy.isEmpty():
            rows = rows.withColumn("chunk", F.lit(0)).withColumn("tile", F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
        else:
            chunks = F.ceil(F.coalesce("members", F.lit(0)) / tile).cast("int")
            rows = settle(rows).join(heavy, ["label", "filter"], "left")
            rows = rows.withColumn("chunk", F.pmod(F.xxhash64("cid"), F.greatest(chunks, F.lit(1))).cast("int"))
            others = F.sequence(F.lit(0), F.greatest(chunks, F.lit(1)) - 1)
            pairs = F.transform(others, lambda o: F.struct(F.least("chunk", o).alias("a"), F.greatest("chunk", o).alias("b")))
            rows = rows.withColumn("tile", F.explode(pairs))
        found.append(
            rows.select("label", "filter", F.col("tile.a").alias("a"), F.col("tile.b").alias("b"), "chunk", "cid", "size", "vec", "filters")
            .repartition("label", "filter", "a", "b")
            .sortWithinPartitions("label", "filter", "a", "b")
            .mapInArrow(_Compare(kind, cosine), "cid long, links long, least long")
        )
    if found:
        links = found[0]
        for more in found[1:]:
            links = links.unionAll(more)
        links = settle(links)
    else:
        links = spark.createDataFrame([], "cid long, links long, least long")
    roots = components(links.select(F.col("cid").alias("a"), F.col("least").alias("b")))
    counts = links.groupBy("cid").agg(F.sum("links").alias("links"))
    rooted = settle(
        classes.join(counts, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
        .select("label", "dim", "vec", "size", "rep", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cid").alias("root"))
    )
    least = settle(rooted.groupBy("root").agg(F.min("rep").alias("component_id")))
    ends = settle(rooted.join(least, "root").select("label", "dim", "vec", (F.col("links") + F.col("size") - 1).alias("n_links"), "component_id"))
    alone = vectors.where("vec is null or label is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return valid.join(ends, ["label", "dim", "vec"]).select("vec_id", "n_links", "component_id").unionAll(alone)


def op10(embeddings: DataFrame) -> DataFrame:
    """The contract's columns: vec_id, n_links, component_id, kept."""
    return near_duplicates(embeddings).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: All pairs of a label; components by reachability.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT DISTINCT a AS origin, a AS node FROM links UNION SELECT r.origin, l.b FROM reach r JOIN links l ON l.a = r.node),
least AS (SELECT origin, min(node) AS component_id FROM reach GROUP BY origin),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, e.vec_id) AS component_id,
       coalesce(component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts ON counts.a = e.vec_id LEFT JOIN least ON least.origin = e.vec_id
"""


def brute_force(rows: list[tuple], cosine: float = COSINE) -> list[tuple]:
    """near_duplicates for a small fixture of (vec_id, embedding, label): all pairs."""
    def good(v, label):
        if v is None or label is None or any(x is None for x in v):
            return False
        v = np.array(v, dtype=np.float64)
        return bool(len(v) and np.isfinite(v).all() and v.any())

    links, root = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, v, label) in enumerate(rows):
        for j, w, other in rows[x + 1 :]:
            if label == other and good(v, label) and good(w, other) and len(v) == len(w):
                p, q = np.array(v, dtype=np.float64), np.array(w, dtype=np.float64)
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return sorted((i, links[i], find(i)) for i in links)
