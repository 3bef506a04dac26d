"""Packing by concatenate and cut.

Pass 1 encodes each document, appends the separator, and writes the ids with their place in their
partition's token stream. The partitions' totals (one row each) are summed up in order: that gives
every document its place in one global stream. Pass 2 cuts the stream at multiples of the sequence
length; a document that crosses a cut gives a piece on each side, the boundary records. All
sequences are full but the last.

Edge cases: a null or empty text is the separator alone; repeated rows are packed once each; extra
columns are left out; an empty table gives no pieces.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PATTERN, Vocabulary
from .common import settle, sliced

SEQUENCE, SEPARATOR = 2048, 1


class Ranked(Vocabulary):
    """Pieces that are not remembered are encoded by tiktoken, from the same merges and pattern, all of a text at once."""

    remembered = 300_000

    def __init__(self, path: str):
        super().__init__(path)
        made = [uv for *_, uv in self.merges]
        if made != sorted(made):  # ids in the order of the merges are what it takes as ranks
            raise ValueError(f"the ids of {path} don't follow its merges")
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ids, special_tokens={})
        self.sizes = np.array([len(x) for x in self.labels])

    def joined(self, pieces: list[str]) -> list[bytes]:
        new, older = self.words, self.older
        out = [new.get(p) for p in pieces]
        gaps = [i for i, ids in enumerate(out) if ids is None]
        unknown = {}
        for i in gaps:
            p = pieces[i]
            if (ids := older.get(p)) is None:
                unknown[p] = len(unknown)
            else:
                new[p] = ids
        if unknown:
            # In this order too, a piece begins with a space before a non-space, or begins the text.
            ids = np.array(self.encoding.encode_ordinary("".join(unknown)), "<u2")
            want = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in unknown])
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), want) + 1
            raw, at = ids.tobytes(), 0
            for p, end in zip(unknown, (2 * ends).tolist()):
                new[p] = raw[at:end]
                at = end
        for i in gaps:
            out[i] = new[pieces[i]]
        for p in unknown:
            if len(p) > 64:  # rare ones, which would fill the memory
                del new[p]
        if len(new) >= self.remembered:
            self.older, self.words = new, {}
        return out


@functools.cache
def ranked(path: str) -> Ranked:
    """One encoder for each worker and vocabulary."""
    return Ranked(path)


class _Stream:
    """Documents to their ids and place in the partition's stream."""

    def __init__(self, path: str, separator: int):
        self.path, self.separator = path, separator

    def __call__(self, batches):
        encode, end = ranked(self.path).encode, np.uint16(self.separator).tobytes()
        part, at = TaskContext.get().partitionId(), 0
        for batch in sliced(batches):
            ids = [encode(x.as_py()) + end for x in batch.column(1)]
            ends = at + np.cumsum([len(x) // 2 for x in ids], dtype=np.int64)
            if len(ids):
                at = int(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(np.full(len(ids), part, np.int32)), pa.array(ends)],
                names=["doc_id", "ids", "part", "end"],
            )


class _Cut:
    """Documents with their place in the global stream to pieces."""

    def __init__(self, length: int, with_ids: bool):
        self.length, self.with_ids = length, with_ids

    def __call__(self, batches):
        for batch in sliced(batches):
            doc, start, size, crc, total, place, piece_ids = [], [], [], [], [], [], []
            for i, raw, at in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                s = 0
                while s < len(ids):
                    e = min(len(ids), s + self.length - (at + s) % self.length)
                    raw_ids = ids[s:e].tobytes()
                    doc.append(i)
                    start.append(s)
                    size.append(e - s)
                    crc.append(zlib.crc32(raw_ids))
                    total.append(len(ids))
                    place.append(at + s)
                    if self.with_ids:
                        piece_ids.append(raw_ids)
                    s = e
            place = np.array(place, dtype=np.int64)
            longs = (start, size, crc, total, place // self.length, place % self.length)
            columns = [pa.array(doc, pa.int64()), *(pa.array(x, pa.int64()) for x in longs)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if self.with_ids:
                columns, names = [*columns, pa.array(piece_ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def pack(docs: DataFrame, path: str, length: int = SEQUENCE, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; and ids (binary, 32-bit) if asked for."""
    stream = settle(
        docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
            _Stream(path, separator), "doc_id long, ids binary, part int, end long"
        )
    )
    totals = stream.groupBy("part").agg(F.max("end").alias("n"))
    bases = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    placed = stream.join(F.broadcast(bases), "part")  # one row for each partition of the input
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.select(
        "doc_id", "ids", (F.col("base") + F.col("end") - F.expr("length(ids) div 2")).alias("at")
    ).mapInArrow(_Cut(length, with_ids), schema + ", ids binary" * with_ids)


def sequences(pieces: DataFrame, length: int = SEQUENCE, pad: int = 0) -> DataFrame:
    """Pieces with ids to sequence_id, tokens (array of ``length`` ids, padded), n (ids that are no padding)."""

    def build(batches):
        for batch in sliced(batches):
            ids, tokens = batch.column(1).to_pylist(), []
            for parts in ids:
                own = b"".join(x["ids"] for x in parts)
                tokens.append(np.frombuffer(own, "<u4").astype(np.int32))
            n = [len(t) for t in tokens]
            tokens = [np.pad(t, (0, length - len(t)), constant_values=pad) for t in tokens]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens, pa.list_(pa.int32())), pa.array(n, pa.int32())],
                names=["sequence_id", "tokens", "n"],
            )

    grouped = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return grouped.mapInArrow(build, "sequence_id long, tokens array<int>, n int")
