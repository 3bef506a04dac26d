"""Vector compression by product codes whose codebooks are learned with Yinyang Lloyd rounds, in integers.

Each vector is cut into parts, and each part gets the index of the nearest entry of its position's codebook. The
entries of a codebook are clustered into a few groups. A vector keeps, for each part and group, one lower bound of
the distance to the group's entries (its own entry left out). When the entries move, the bounds fall by the group's
largest drift; the distance to the own entry is computed, and only groups whose bound does not exceed it are
scanned. Bounds are only a filter: they are rounded down, a bound that equals the distance fails, and what is
scanned is decided by exact squared distances of integers, ties to the lower index.

A round is one Arrow pass over the vectors' state, which writes the next state and each task's sums by entry; the sums
are added by Spark, and only the codebooks (parts x entries, a bound of the parameters) come to the driver.

Edge cases: vectors that are null or empty, or hold null, NaN or infinite components, are dropped, and so are those of
another length than the first kept one's; a length that the parts don't divide is filled up with zeros; components
beyond ``largest`` after scaling (2**27 for 64 of them) count as that, so that errors fit a long; with fewer vectors than entries the codebook
has as many entries as there are; a null vec_id comes last; repeated rows are vectors of their own; null labels are one label;
extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle, sliced

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Groups of entries a codebook, about a tenth as many as entries.
GROUPS = 6
#: Below this, products and sums of distances are exact in doubles, which are multiplied faster than integers.
EXACT = 1 << 22

_STATE = "vec_id long, label int, ints binary, codes binary, bounds binary, sums binary, scanned long"


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding (array of doubles) of the vectors that can be coded."""
    own = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), F.col("embedding").cast("array<double>"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return own.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~odd)


def largest(dim: int) -> int:
    """The largest integer of which ``dim`` can differ twice as much each, and the squares' sum is below 2**62."""
    return 1 << (60 - (dim - 1).bit_length()) // 2


def _integers(values: np.ndarray, parts: int, scale: int) -> np.ndarray:
    """Rows of doubles to rows of integers, [row, part, place]."""
    top = largest(values.shape[1])
    out = np.clip(np.floor(values * scale), -top, top).astype(np.int64)
    width = -(-out.shape[1] // parts)
    return np.pad(out, ((0, 0), (0, parts * width - out.shape[1]))).reshape(len(out), parts, width)


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries."""
    if max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) < EXACT // x.shape[1]:
        x, entries = x.astype(np.float64), entries.astype(np.float64)
    return ((x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)).astype(np.int64)


def grouped(entries: np.ndarray, groups: int) -> np.ndarray:
    """The group of each entry: a few Lloyd rounds over the entries themselves, begun from entries far from one another."""
    groups = max(1, min(groups, len(entries)))
    at = [0]
    for _ in range(groups - 1):
        at.append(int(_squares(entries, entries[at]).min(1).argmax()))
    centres = entries[at]
    for _ in range(5):
        own = _squares(entries, centres).argmin(1)
        centres = np.array([entries[own == g].sum(0) // n if (n := (own == g).sum()) else centres[g] for g in range(groups)])
    return own


@dataclass(frozen=True)
class Codebooks:
    """``entries`` [part, entry, place]; ``groups`` [part, entry]."""

    entries: np.ndarray
    groups: np.ndarray

    @staticmethod
    def first(entries: np.ndarray, groups: int = GROUPS) -> Codebooks:
        return Codebooks(entries, np.array([grouped(e, groups) for e in entries]))

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Each entry at the mean of its parts, rounded down; unused ones stay."""
        means = sums // np.maximum(counts, 1)[:, :, None]
        return Codebooks(np.where(counts[:, :, None] > 0, means, self.entries), self.groups)

    def drifts(self, after: Codebooks) -> np.ndarray:
        """The largest move of an entry, by part and group, rounded up."""
        moved = np.sqrt(((after.entries - self.entries).astype(np.float64) ** 2).sum(2)) * (1 + 1e-9)
        return np.array([[m[g == k].max(initial=0) for k in range(self.groups.max() + 1)] for m, g in zip(moved, self.groups)])

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _down(bounds: np.ndarray) -> np.ndarray:
    """Bounds in 16 bits, never above what they were."""
    out = np.clip(bounds, 0, 65504).astype(np.float16)
    return np.where(out > bounds, np.nextafter(out, np.float16(-1)), out).clip(0)


def _full(x: np.ndarray, entries: np.ndarray, groups: np.ndarray):
    """Codes, their squared distances, and the bounds, of one part."""
    d = _squares(x, entries)
    codes = d.argmin(1)
    rows = np.arange(len(x))
    own = d[rows, codes]
    others = np.sqrt(d.astype(np.float64))
    others[rows, codes] = np.inf
    bounds = np.stack([others[:, groups == g].min(1, initial=np.inf) for g in range(groups.max() + 1)], 1)
    return codes, own, bounds, d.size


def _filtered(x: np.ndarray, entries: np.ndarray, groups: np.ndarray, before: np.ndarray, bounds: np.ndarray):
    """The same after the entries have moved: groups are scanned only where their bound fails."""
    apart = x - entries[before]
    own = (apart * apart).sum(1)
    codes, best, scanned, seen = before.copy(), own.copy(), len(x), []
    for g in range(bounds.shape[1]):
        members = np.flatnonzero(groups == g)
        rows = np.flatnonzero(bounds[:, g] <= np.sqrt(best.astype(np.float64)) * (1 + 1e-9))
        if not len(rows) or not len(members):
            continue
        d = _squares(x[rows], entries[members])
        scanned += d.size
        nearest = d.argmin(1)
        least, index = d[np.arange(len(rows)), nearest], members[nearest]
        better = (least < best[rows]) | (least == best[rows]) & (index < codes[rows])
        codes[rows[better]], best[rows[better]] = index[better], least[better]
        seen.append((g, members, rows, d))
    bounds = bounds.copy()
    changed = np.flatnonzero(codes != before)  # the entry that was its own is one of its group now
    left = groups[before[changed]]
    bounds[changed, left] = np.minimum(bounds[changed, left], np.sqrt(own[changed].astype(np.float64)))
    for g, members, rows, d in seen:
        others = np.sqrt(d.astype(np.float64))
        others[codes[rows][:, None] == members] = np.inf
        bounds[rows, g] = others.min(1)
    return codes, best, bounds, scanned


class _Round:
    """Vectors (first) or states to states with codes for ``books``; at a task's end its sums by entry.

    With ``last`` the rows are vec_id, label, code, error instead.
    """

    def __init__(self, books: Codebooks, drifts: np.ndarray | None, dim: int, scale: int, last: bool = False):
        self.books, self.drifts, self.dim, self.scale, self.last = books, drifts, dim, scale, last

    def __call__(self, batches):
        parts, k, width = self.books.entries.shape
        n_groups = int(self.books.groups.max()) + 1
        sums, counts, scanned = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64), 0
        for batch in sliced(batches):
            n = batch.num_rows
            if not n:
                continue
            codes = np.empty((n, parts), np.uint8 if k <= 256 else np.uint16)
            error, bounds = np.zeros(n, np.int64), np.empty((n, parts, n_groups), np.float16)
            if self.drifts is None:
                x = _integers(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, self.dim), parts, self.scale)
            else:
                x = np.stack([np.frombuffer(b, "<i2" if len(b) == 2 * parts * width else "<i4") for b in batch.column(2).to_pylist()])
                x = x.astype(np.int64).reshape(n, parts, width)
                before = np.frombuffer(b"".join(batch.column(3).to_pylist()), codes.dtype).reshape(n, parts).astype(np.int64)
                low = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.float16).reshape(bounds.shape).astype(np.float64)
                low = low - self.drifts
            for p in range(parts):
                entries, groups = self.books.entries[p], self.books.groups[p]
                if self.drifts is None:
                    own, d, b, m = _full(x[:, p], entries, groups)
                else:
                    own, d, b, m = _filtered(x[:, p], entries, groups, before[:, p], low[:, p])
                scanned += m
                error += d
                codes[:, p], bounds[:, p] = own, _down(b)
                counts[p] += np.bincount(own, minlength=k)
                for j in range(width):  # exact: below 2**53
                    sums[p, :, j] += np.bincount(own, x[:, p, j], k).astype(np.int64)
            out = [row.tobytes() for row in codes]
            if self.last:
                columns = [batch.column(0), batch.column(1), pa.array(out, pa.binary()), pa.array(error)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])
                continue
            flat = x.reshape(n, -1)
            small = flat.astype("<i2") if np.abs(flat).max(initial=0) < 1 << 15 else flat.astype("<i4")
            own = [[r.tobytes() for r in small], out, [r.tobytes() for r in bounds]]
            columns = [batch.column(0), batch.column(1), *(pa.array(c, pa.binary()) for c in own), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=_names(_STATE))
        if not self.last:
            total = np.concatenate([counts[:, :, None], sums], 2).tobytes()
            nothing = [pa.nulls(1, t) for t in (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array([total], pa.binary()), pa.array([scanned], pa.int64())], names=_names(_STATE))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _numbers(batches):
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            total = np.frombuffer(raw, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "n"])


def _moved(state: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after the tasks' sums have been added."""
    parts, k, width = books.entries.shape
    total = np.zeros(parts * k * (width + 1), np.int64)
    sums = state.where("sums is not null").select("sums").mapInArrow(_numbers, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    for at, n in sums.collect():  # a number for each entry's component
        total[at] = n
    total = total.reshape(parts, k, width + 1)
    return books.moved(total[:, :, 1:], total[:, :, 0])


@dataclass
class Compressed:
    """``codes``: vec_id, label, code (binary, an index a part), error (squared distance); ``scanned``: distances computed in each round but the last.

    ``forget(codes)`` drops the state that the codes are read from.
    """

    codes: DataFrame
    books: Codebooks
    scanned: list[int]


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, groups: int = GROUPS) -> Compressed:
    """Codebooks begin as the parts of the ``entries`` smallest vec_ids; each round assigns all parts and moves the entries; then all are assigned again."""
    own = kept(vectors)
    seeds = own.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    if not seeds:
        empty = own.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
        return Compressed(empty, Codebooks(np.zeros((parts, 0, 0), np.int64), np.zeros((parts, 0), np.int64)), [])
    dim = len(seeds[0][0])
    own = own.where(F.size("embedding") == dim)
    first = np.array([s[0] for s in seeds if len(s[0]) == dim], np.float64)
    if len(first) < len(seeds):
        more = own.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
        first = np.array([s[0] for s in more], np.float64)
    books = Codebooks.first(_integers(first, parts, scale).transpose(1, 0, 2), groups)
    state, drifts, scanned = own, None, []
    for _ in range(rounds):
        before, state = state, settle(state.mapInArrow(_Round(books, drifts, dim, scale), _STATE))
        forget(before)
        scanned.append(state.agg(F.sum("scanned")).first()[0])
        after = _moved(state, books)
        drifts, books = books.drifts(after), after
        state, held = state.where("sums is null"), state
        state._settled = held._settled
    last = _Round(books, drifts, dim, scale, last=True)
    codes = state.mapInArrow(last, "vec_id long, label int, code binary, error long")
    codes._settled = getattr(state, "_settled", None)
    return Compressed(codes, books, scanned)


def restored(codes: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """``codes`` with ``embedding``: the entries' components, in the middle of their integer steps (filled-up zeros at the end included)."""
    entries = (books.entries + 0.5) / scale
    width = 1 if entries.shape[1] <= 256 else 2
    index = codes.schema.names.index("code")

    def decode(batches):
        for batch in sliced(batches):
            code = np.frombuffer(b"".join(batch.column(index).to_pylist()), np.uint8 if width == 1 else np.uint16).reshape(batch.num_rows, len(entries))
            found = np.stack([e[c] for e, c in zip(entries, code.T)], 1).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(found), pa.list_(pa.float64()))], names=[*batch.schema.names, "embedding"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema.fields)
    return codes.mapInArrow(decode, f"{names}, embedding array<double>")


def op12(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256; label_error is a label's sum, at most the largest long."""
    made = compress(vectors)
    codes = settle(made.codes.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error"))
    forget(made.codes)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    sums = settle(codes.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "_label"))
    joined = codes.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(made.books.sha256).alias("codebooks_sha256"))


def _oracle() -> str:
    """Plain Lloyd rounds."""

    def assign(n: int) -> str:
        return f"""a{n} AS (SELECT v.vec_id, v.part, arg_min(b.entry, b.d * 64 + b.entry) AS entry, min(b.d) AS d FROM parts v, LATERAL
  (SELECT b.entry, list_sum(list_transform(range(1, {PARTS_WIDTH} + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i])))::BIGINT AS d
   FROM b{n} b WHERE b.part = v.part) b GROUP BY 1, 2)"""

    def move(n: int) -> str:
        means = ", ".join(f"floor(sum(x[{i}])::DOUBLE / count(*))::BIGINT" for i in range(1, PARTS_WIDTH + 1))
        return f"""m{n} AS (SELECT part, a.entry, [{means}] AS x FROM a{n} a JOIN parts USING (vec_id, part) GROUP BY 1, 2),
b{n + 1} AS (SELECT part, b.entry, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN m{n} m USING (part, entry))"""

    return f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, p AS part, v[p * {PARTS_WIDTH} + 1 : p * {PARTS_WIDTH} + {PARTS_WIDTH}] AS x FROM kept, range({PARTS}) t(p)),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {ENTRIES}),
b0 AS (SELECT part, entry, x FROM seeds JOIN parts USING (vec_id)),
{assign(0)}, {move(0)}, {assign(1)}, {move(1)}, {assign(2)},
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
(SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256 FROM coded JOIN kept USING (vec_id)"""


#: Of the vectors of TESTDATA.md, which have 64 components.
PARTS_WIDTH = 64 // PARTS
ORACLE = _oracle()
