"""Importance resampling towards a target distribution, in two Arrow passes.

Features are runs of one and two words, hashed to buckets by CRC-32. Pass 1: each partition of the raw and of
the target texts gives one vector of bucket counts (np.bincount), and a tree merges the vectors. A bucket's gain is
the logarithm of the ratio of its smoothed shares in target and raw texts. Pass 2: the gains, a broadcast vector of
fixed length, are gathered by each document's buckets and summed by bincount weights; with Gumbel noise from a
hash of the document's id this draws without replacement in proportion to the weights.

Bytes of a batch are worked on together: CRC-32 is linear over its bits, so a word's is the exclusive or of its
bytes' tables by distance from the word's end, and a pair's follows from that of its first word. A text of any
length is cut between words, so that a worker holds ``LIMIT`` bytes and one word at a time.

Edge cases: a null or empty text has no features, weight 0 and is never drawn (it has less than ``least`` words);
texts that aren't valid UTF-8 count by their bytes; a null doc_id is hashed as ``null`` and ranks last among ties;
repeated rows are documents of their own; extra columns of any name are left alone; an empty table of documents
gives no rows, an empty target the counts 0.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, keyed, numbered, settle, sliced, unfold

BUCKETS, PERCENT, LEAST, SEED = 10_000, 25, 20, 7

#: Bytes that are worked on at a time, and the longest word that goes by tables.
LIMIT, LONG = 1 << 21, 64

_BREAK = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
_ONES = 0xFFFFFFFF


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of words in lower case (0: no word); CRC registers after n zero bytes, by the place and value of a register's byte; the same of the first register."""
    lower = np.array([0 if _BREAK.match(bytes([b])) else b for b in range(256)], np.uint8)
    lower[65:91] = np.arange(97, 123)
    step = np.array([zlib.crc32(bytes([b]), _ONES) ^ _ONES for b in range(256)], np.uint32)  # from a register of zeros
    after = np.empty((LONG + 1, 4, 256), np.uint32)
    after[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    first = np.full(LONG + 1, _ONES, np.uint32)
    for n in range(LONG):
        after[n + 1] = step[after[n] & 255] ^ (after[n] >> 8)
        first[n + 1] = step[first[n] & 255] ^ (first[n] >> 8)
    return lower, after, first


def _parts(text: bytes):
    """``text`` in parts of about ``LIMIT`` bytes, cut between words; and whether the part's first word is the last one of the part before."""
    at, carry = 0, b""
    while len(text) - at > LIMIT:
        found = _BREAK.search(text, at + LIMIT)
        cut = found.start() if found else len(text)
        part = carry + text[at:cut]
        yield part, bool(carry)
        inside = np.flatnonzero(_tables()[0][np.frombuffer(part, np.uint8)])
        if len(inside):
            gap = np.flatnonzero(np.diff(inside) > 1)
            carry = part[inside[gap[-1] + 1] if len(gap) else inside[0] : inside[-1] + 1]
        at = cut
    yield carry + text[at:], bool(carry)


def features(texts: list[bytes]):
    """Features of the texts, piece by piece: the texts' rows and the CRCs of words, then of pairs of words."""
    rows, parts, again, held = [], [], [], 0
    for row, text in enumerate(texts):
        for part, old in _parts(text):
            if held + len(part) > LIMIT and parts:
                yield _hashed(rows, parts, again)
                rows, parts, again, held = [], [], [], 0
            rows.append(row)
            parts.append(part)
            again.append(old)
            held += len(part) + 1
    if parts:
        yield _hashed(rows, parts, again)


def _hashed(rows: list[int], parts: list[bytes], again: list[bool]):
    lower, after, first = _tables()
    whole = b"\0".join(parts) + b"\0"
    low = lower[np.frombuffer(whole, np.uint8)]
    inside = low != 0
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    none = np.empty(0, np.int64)
    if not len(starts):
        return none, none, none, none
    sizes = ends - starts
    places = np.flatnonzero(inside)
    behind = np.minimum(np.repeat(ends, sizes) - places, LONG)  # 1 for a word's last byte
    terms = after[:, 0].ravel()[behind * 256 + low[places]]
    own = np.bitwise_xor.reduceat(terms, np.cumsum(sizes) - sizes)
    short = np.minimum(sizes, LONG)
    words = own ^ first[short] ^ np.uint32(_ONES)
    long = np.flatnonzero(sizes > LONG)
    spelled = {int(i): low[starts[i] : ends[i]].tobytes() for i in long}
    for i, word in spelled.items():
        words[i] = zlib.crc32(word)
    part = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), starts, "right")
    # a pair: the register after the first word, a space, and as many zero bytes as the second has, with the second's terms
    left = np.flatnonzero(part[1:] == part[:-1])
    register = words[left] ^ np.uint32(_ONES)
    space = after[1, 0, 32]
    register = after[1, 0][register & 255] ^ (register >> 8) ^ space
    n = short[left + 1]
    pairs = own[left + 1] ^ np.uint32(_ONES)
    for k in range(4):
        pairs = pairs ^ after[n, k, (register >> (8 * k)) & 255]
    if spelled:
        for j in np.flatnonzero(np.isin(left + 1, long)):
            pairs[j] = zlib.crc32(b" " + spelled[int(left[j]) + 1], int(words[left[j]]))
    row = np.array(rows)[part]
    counted = ~(np.array(again)[part] & np.diff(part, prepend=-1).astype(bool))  # a carried word has been counted
    return row[counted], words[counted], row[left], pairs


def _bytes(column) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _partition_vector(batches):
    """One vector of bucket counts for a partition."""
    counts = np.zeros(BUCKETS, np.int64)
    for batch in sliced(batches):
        for _, words, _, pairs in features(_bytes(batch.column(0))):
            for crcs in (words, pairs):
                counts += np.bincount(crcs % BUCKETS, minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], names=["counts"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features in each bucket, of all rows' ``text``."""
    vectors = texts.select("text").mapInArrow(_partition_vector, "counts binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(BUCKETS, np.int64)
    return vectors.map(lambda r: np.frombuffer(r[0], np.int64)).treeReduce(np.add)


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of (target share / raw share) of each bucket, rounded down."""
    all_raw, all_target = float(raw.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((float(t) + 1) * all_raw / ((float(s) + 1) * all_target))) for s, t in zip(raw, target)], np.int64)


def noise(doc_id, seed: int) -> int:
    """Thousandths of a standard Gumbel variable that depends on the id and the seed alone."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


class _Score:
    def __init__(self, gain, seed: int):
        self.gain, self.seed = gain, seed

    def __call__(self, batches):
        gain = self.gain.value.astype(np.float64)
        for batch in sliced(batches):
            n = batch.num_rows
            total, count, spoken = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for word_rows, words, pair_rows, pairs in features(_bytes(batch.column(1))):
                for at, crcs in ((word_rows, words), (pair_rows, pairs)):
                    total += np.bincount(at, gain[crcs % BUCKETS], n)
                    count += np.bincount(at, minlength=n)
                spoken += np.bincount(word_rows, minlength=n)
            weight = total.astype(np.int64) // np.maximum(count, 1)
            ids = batch.column(0).to_pylist()
            score = weight + np.array([noise(i, self.seed) for i in ids], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x) for x in (spoken, count, weight, score)), *batch.columns[2:]],
                names=["doc_id", "n_words", "n_features", "weight", "score", *batch.schema.names[2:]],
            )


def scored(docs: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each document (doc_id, text; a ``_key`` long is passed on)."""
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs), bucket_counts(target)))
    keys = [c for c in docs.columns if c == "_key"]
    schema = "doc_id long, n_words long, n_features long, weight long, score long" + ", _key long" * len(keys)
    return docs.select(F.col("doc_id").cast("long"), "text", *keys).mapInArrow(_Score(gain, seed), schema)


def ranked(scores: DataFrame, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """``scores`` with ``rank``: 1 and on for the drawn ``percent`` of the documents of ``least`` words and more, else null."""
    rows = settle(scores.withColumn("_long", F.col("n_words") >= least))
    n = rows.where("_long").count()
    order = [F.col("_long").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = numbered(rows, order, "_at")
    return placed.withColumn("rank", F.when(F.col("_long") & (F.col("_at") < percent * n // 100), F.col("_at") + 1)).drop("_long", "_at")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """The drawn documents, with all their columns."""
    own = settle(keyed(fold(docs)))
    drawn = ranked(scored(own.select("doc_id", "text", "_key"), target, seed), percent, least).where("rank is not null")
    return unfold(own.join(drawn.select("_key"), "_key"), docs.columns)


def op11(docs: DataFrame, target: DataFrame) -> DataFrame:
    return ranked(scored(docs.select("doc_id", "text"), target)).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""WITH RECURSIVE steps AS (SELECT i, 0 AS k, i AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT NULL, text FROM benchmark),
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
counted AS (SELECT doc_id, f, count(*) AS n FROM features GROUP BY ALL),
spelled AS (SELECT f, hex(encode(f)) AS h FROM counted GROUP BY f),
hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM spelled, crc),
placed AS (SELECT doc_id, bucket, n FROM counted JOIN hashed USING (f)),
shares AS (SELECT bucket, coalesce(sum(n) FILTER (doc_id IS NOT NULL), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (doc_id IS NULL), 0)::DOUBLE AS t FROM placed GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM shares) + 10000) / ((s + 1) * ((SELECT sum(t) FROM shares) + 10000)))) AS g FROM shares),
weights AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * g) / sum(n))::BIGINT AS weight FROM placed JOIN gain USING (bucket) WHERE doc_id IS NOT NULL GROUP BY 1),
scores AS (SELECT w.doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)
  + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words w LEFT JOIN weights USING (doc_id) WHERE w.doc_id IS NOT NULL),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scores WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 25 * (SELECT count(*) FROM ranks) // 100 THEN r END::BIGINT AS rank
FROM scores LEFT JOIN ranks USING (doc_id)"""
