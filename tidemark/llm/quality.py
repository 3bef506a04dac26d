"""Quality classifier by compression.

Two zstandard dictionaries are trained, on texts labelled good and on texts labelled bad. Each whole
text is compressed in blocks with either; the normalised difference of the compressed sizes,
(bad - good) / max(bad, good), says to which kind it is closer. A logistic curve turns it into a
calibrated probability of label 1. It is taken of the text and of its worst block, for large and for
small blocks, and beside it the same difference between no dictionary and the good one, and between
small and large blocks (how far the text repeats itself). Nothing but such differences, held to the
range they were fitted on, and their squares go into the score: no length, no ratio to the raw size.

Every labelled document that is not held out counts: one half of them (by a hash of the id) gives the
dictionaries, the other the curve. Blocks of whole texts are dealt to groups of about ``BLOCKS``; each group
trains a dictionary in its task, and the dictionaries' own blocks go the same way until one a class is left.
The curve is fitted by Newton's method on sums that Spark adds up, a pass a step. Only the two dictionaries and
these sums come to the driver. Classes are weighted by their counts over all labels.

Edge cases: null texts count as empty; an empty text has difference 0 and gets a score
like any other; repeated rows get the same score (of rows
with one labelled doc_id the fit takes one text); extra columns pass through; an empty table gives an
empty result; a null doc_id counts as held out; labels other than
0 and 1 are left out, of several labels of a document the smallest counts; without labels of both
classes the score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fold, forget, settle, sliced, unfold

BLOCK, BLOCKS, DICTIONARY, LEVEL = 2048, 3000, 112_640, 3
#: Rows of features that one task sums.
POINTS = 100_000
FOLDS, THRESHOLD = 5, 0.3
SMALL = 256
FEATURES = 7
COLUMNS = "abcdefg"


@dataclass(frozen=True)
class Model:
    """What the executors need: the dictionaries (bytes) and the curve; without dictionaries a constant."""

    good: bytes = b""
    bad: bytes = b""
    low: tuple = ()
    high: tuple = ()
    weights: tuple = ()
    constant: float = 0.5


@functools.cache
def _compressor(dictionary: bytes):
    settings = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if not dictionary:
        return zstandard.ZstdCompressor(**settings)
    own = zstandard.ZstdCompressionDict(dictionary)
    own.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=own, **settings)


def difference(x: int, y: int) -> float:
    """Normalised difference of two compressed sizes: over 0 if the first is smaller."""
    return (y - x) / max(x, y)


def features(text: str | None, good: bytes, bad: bytes) -> tuple[float, ...]:
    """For BLOCK and SMALL blocks: difference of good and bad, the least one of a block, that of good and none; then of BLOCK and SMALL."""
    raw = (text or "").encode()
    if not raw:
        return (0.0,) * FEATURES
    kinds = [_compressor(x).compress for x in (good, bad, b"")]
    out, wholes = [], []
    for size in (BLOCK, SMALL):
        sums, worst = [0, 0, 0], 1.0
        for i in range(0, len(raw), size):
            part = raw[i : i + size]
            x, y, z = (len(f(part)) for f in kinds)
            sums = [sums[0] + x, sums[1] + y, sums[2] + z]
            worst = min(worst, difference(x, y))
        out += [difference(sums[0], sums[1]), worst, difference(sums[0], sums[2])]
        wholes.append(sums[0])
    return *out, difference(*wholes)


def _design(x: np.ndarray, low, high) -> np.ndarray:
    """Features held to the range they were fitted on, scaled to -1..1, with their squares and the constant 1."""
    low, high = np.array(low), np.array(high)
    z = 2 * (np.clip(x, low, high) - low) / np.maximum(high - low, 1e-9) - 1
    return np.c_[np.ones(len(z)), z, z * z]


def _sums(design: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss of the logistic curve ``w`` with its slope and curvature, one after the other."""
    m = design @ w
    p = 1 / (1 + np.exp(-np.clip(m, -30, 30)))
    loss = float((weight * (np.logaddexp(0, m) - y * m)).sum())
    return np.concatenate([[loss], design.T @ (weight * (p - y)), (design.T @ (design * (weight * p * (1 - p))[:, None])).ravel()])


def _logistic(sums, size: int, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method, with halved steps where a full one would not lower the loss; ``sums`` gives those of ``_sums`` at a place."""

    def at(v):
        s = sums(v)
        return s[0] + ridge / 2 * v @ v, s[1 : 1 + size] + ridge * v, s[1 + size :].reshape(size, size) + ridge * np.eye(size)

    w = np.zeros(size)
    now, slope, curve = at(w)
    for _ in range(100):
        step, part = np.linalg.solve(curve, slope), 1.0
        then = at(w - step)
        while then[0] > now and part > 1e-6:
            part /= 2
            then = at(w - part * step)
        if now - then[0] < 1e-9 * max(1.0, now):
            break
        w, (now, slope, curve) = w - part * step, then
    return w


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


class _Blocks:
    """Labelled texts to their blocks."""

    def __call__(self, batches):
        for batch in sliced(batches):
            kind, order, block = [], [], []
            for i, text, quality in zip(*(batch.column(k).to_pylist() for k in range(3))):
                raw = (text or "").encode()
                for j in range(-(-len(raw) // BLOCK)):
                    kind.append(quality)
                    order.append(f"{i}-{j}")
                    block.append(raw[j * BLOCK : (j + 1) * BLOCK])
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array(order, pa.string()), pa.array(block, pa.binary())],
                names=["quality", "place", "block"],
            )


class _Features:
    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = good, bad

    def __call__(self, batches):
        for batch in sliced(batches):
            rows = [features(x.as_py(), self.good, self.bad) for x in batch.column(0)]
            columns = [pa.array(c, pa.float64()) for c in np.array(rows).reshape(-1, FEATURES).T]
            yield pa.RecordBatch.from_arrays([batch.column(1), *columns], names=["quality", *COLUMNS])


class _Sums:
    """Rows quality, features to the parts (place, value) of their ``_sums``."""

    def __init__(self, low, high, weights: dict, w: np.ndarray):
        self.low, self.high, self.weights, self.w = low, high, weights, w

    def __call__(self, batches):
        total = 0
        for batch in batches:
            y, *x = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1 + FEATURES))
            total += _sums(_design(np.stack(x, 1), self.low, self.high), y, np.where(y == 1, self.weights[1], self.weights[0]), self.w)
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["place", "value"])


class _Score:
    """A batch with _score appended."""

    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batches):
        m = self.model
        for batch in sliced(batches):
            if m.weights:
                text = batch.column(batch.schema.names.index("text"))
                x = np.array([features(v.as_py(), m.good, m.bad) for v in text]).reshape(-1, FEATURES)
                score = 1 / (1 + np.exp(-np.clip(_design(x, m.low, m.high) @ np.array(m.weights), -30, 30)))
            else:
                score = np.full(len(batch), m.constant)
            yield batch.append_column("_score", pa.array(score, pa.float64()))


def _dictionary(blocks: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few blocks to train on: they are the dictionary themselves
        return b"".join(blocks)[-DICTIONARY:]


def _group(table: pa.Table) -> pa.Table:
    """A group's dictionary."""
    rows = sorted(zip(table.column("place").to_pylist(), table.column("block").to_pylist()))
    own = _dictionary([block for _, block in rows])
    return pa.table({"quality": table.column("quality")[:1], "part": table.column("part")[:1], "dictionary": pa.array([own], pa.binary())})


def _dictionaries(blocks: DataFrame) -> dict[int, bytes]:
    """A dictionary for each class of ``blocks`` (quality, place, block), from all of them."""
    while True:
        blocks = settle(blocks)
        parts = {q: -(-n // BLOCKS) for q, n in blocks.groupBy("quality").count().collect()}  # at most two rows
        part = F.pmod(F.xxhash64("place"), F.when(F.col("quality") == 1, parts.get(1, 1)).otherwise(parts.get(0, 1)))
        made = blocks.withColumn("part", part).groupBy("quality", "part").applyInArrow(_group, "quality int, part long, dictionary binary")
        if max(parts.values(), default=1) == 1:
            return {r.quality: bytes(r.dictionary) for r in made.collect()}
        # of a class with one part the blocks go on as they are
        single = [q for q, n in parts.items() if n == 1]
        cut = made.where(~F.col("quality").isin(single)) if single else made
        at = F.explode(F.sequence(F.lit(0), ((F.length("dictionary") - 1) / BLOCK).cast("int")))
        cut = cut.where("length(dictionary) > 0").select("quality", "part", "dictionary", at.alias("j")).select(
            "quality", F.concat_ws("-", "part", "j").alias("place"), F.substring("dictionary", F.col("j") * BLOCK + 1, F.lit(BLOCK)).alias("block")
        )
        before, blocks = blocks, settle(cut.unionAll(blocks.where(F.col("quality").isin(single))) if single else cut)
        forget(before)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled rows that are not held out."""
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    )
    counts = dict(known.groupBy("quality").count().collect())  # at most two rows
    if len(counts) < 2:
        return Model(constant=counts.get(1, 0) / sum(counts.values()) if counts else 0.5)
    known = known.withColumn("half", F.shiftrightunsigned(F.xxhash64("doc_id"), 7) % 2)
    rows = docs.select("doc_id", "text").join(known, "doc_id")
    rows = settle(rows.groupBy("doc_id", "quality", "half").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    blocks = rows.where("half = 0").select("doc_id", "text", "quality").mapInArrow(_Blocks(), "quality int, place string, block binary")
    dictionaries = _dictionaries(blocks)
    constant = Model(constant=counts[1] / sum(counts.values()))
    if not (dictionaries.get(0) and dictionaries.get(1)):
        return constant
    schema = "quality int, " + ", ".join(f"{c} double" for c in COLUMNS)
    points = rows.where("half = 1").select("text", "quality").mapInArrow(_Features(dictionaries[1], dictionaries[0]), schema)
    points = settle(points.repartition(1 + sum(counts.values()) // POINTS))
    there = dict(points.groupBy("quality").count().collect())
    if len(there) < 2:
        return constant
    total = sum(there.values())
    weights = {q: counts[q] / there[q] * total / sum(counts.values()) for q in there}
    low, high = zip(*points.approxQuantile(list(COLUMNS), [0.002, 0.998], 1e-5))

    def sums(w):
        made = points.mapInArrow(_Sums(low, high, weights, w), "place int, value double")
        return np.array([r[1] for r in made.groupBy("place").agg(F.sum("value")).sort("place").collect()])  # a few hundred numbers

    w = _logistic(sums, 1 + 2 * FEATURES)
    forget(rows, points)
    return Model(dictionaries[1], dictionaries[0], tuple(low), tuple(high), tuple(w.tolist()))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with _score (0 to 1), which replaces a column of that name."""
    docs = docs.drop("_score")
    return docs.mapInArrow(_Score(model), StructType([*docs.schema.fields]).add("_score", "double"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier fitted on ``labels`` does not reject."""
    own = fold(docs)
    return unfold(scored(own, fit(own, labels)).where(F.col("_score") >= threshold), docs.columns)


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, held_out, score, predicted."""
    own = docs.select("doc_id", "text")
    return scored(own, fit(own, labels)).select(
        "doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted")
    )
