"""Suffix-array dedup: remove every byte covered by a passage of ``length`` bytes that starts earlier.

Method: hash-compared suffix sort. Sorting a suffix for every byte would shuffle many times the
input, so suffixes are sorted at *anchors*: of the hashed ``gram``-byte grams of each ``length``-byte
window the rarest, then smallest, then leftmost. Equal windows have equal anchors at equal places, so
only suffixes at equal anchors can share a window, and the windows of one anchor make one run of bytes.

1. A pass over all texts counts grams in ``BUCKETS`` hash buckets; grams of crowded buckets are common,
   in three steps of eight times. A window has a common anchor only if it has no rarer gram: one that
   reaches beyond a widespread passage is anchored outside it, and what keeps a common anchor are, but
   for odd texts, true copies. Counts steer how rows are dealt out and never what is removed.
2. Each task hashes its texts (prefix polynomial hashes), finds anchors, and writes one row for each
   run: hash of the anchor gram, digest of the run's bytes. Copies of a run in one buffer of a task, and
   at common anchors in all of a task, keep the earliest only; the others are removed spans already.
3. One shuffle by anchor gram (common ones salted by content) brings runs together in order; copies of
   a run become spans. Runs that alone have their anchor gram are done: no other window can equal theirs.
4. For the rest (a few in a hundred), the bytes are fetched and sorted as suffixes from the anchor in
   each group, by a mergesort whose comparisons find the common extension by binary search on prefix
   hashes. Longest-common-prefix intervals, split by the hash of what lies left of the anchor, are
   the sets of equal windows. Order, prefixes and matches are verified byte for byte.
5. Groups of more than ``group`` runs of different content are not sorted as they are. Their windows are
   parted by the anchor's place in them into halves, whose windows share more bytes than the gram: these
   are the new anchor, and step 3 follows. After log2(length - gram + 1) such rounds at most the anchor is
   the whole window, and its group is copies. No group is too large for a task, and no pair is written.

Equal runs are told by 128 bits of BLAKE2b, a cryptographic digest, and not compared on their bytes.
Polynomial hashes, which odd texts can make collide, only place rows, and their verdicts are verified.

Edge cases: null and short texts (under ``length`` bytes) lose nothing; repeated rows and repeated or
null doc_ids are separate documents, ordered by doc_id (nulls first), then a hash of the text; very long
texts go through in overlapping parts (their spans, as their text, are one row); extra columns, whatever
their names, pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fold, keyed, settle, sliced, unfold
from .rolling import PIECE, U, common_extension, mix, rolling

LENGTH, GRAM, GROUP = 100, 32, 2048
SPAN, RUN = 1, 2
#: Buckets of grams that are counted. Common are those of CROWDED times the mean and of FEW grams or more.
BUCKETS, CROWDED, FEW = 1 << 21, 6, 256
#: Contents at common anchors that a task remembers; parts that one common anchor is dealt to.
SEEN, SALTS = 1 << 16, 64

ROWS = "kind int, key long, pos long, n long, off int, salt int, mh long, h1 long, h2 long"
RUNS = "mh long, key long, pos long, n int, off int, bytes binary"


def _ranks(texts: DataFrame, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Common buckets of grams, at most BUCKETS / CROWDED, and how common (1 to 3)."""
    counts = settle(texts.mapInArrow(_Heat(_Scan(length, gram)), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")))
    total = counts.where("bucket < 0").select("n").first()
    least = max(FEW, CROWDED * (total.n if total else 0) // BUCKETS)
    found = counts.where((F.col("bucket") >= 0) & (F.col("n") >= least)).collect()
    bucket = np.fromiter((r.bucket for r in found), np.int32, len(found))
    n = np.fromiter((r.n for r in found), np.int64, len(found))
    return bucket, (1 + (n >= 8 * least) + (n >= 64 * least)).astype(np.uint8)


def _copies(rows: DataFrame, length: int) -> DataFrame:
    """Of ``rows`` (ROWS): spans of copies, and runs whose gram others have too."""
    dealt = rows.repartition("mh", "salt").sortWithinPartitions("mh", "salt", "h1", "h2", "key", "pos")
    return settle(dealt.mapInArrow(_Copies(length), ROWS))


def _fetched(texts: DataFrame, runs: DataFrame, step, schema: str) -> DataFrame:
    """``step`` over the texts with their runs of ``runs``."""
    wanted = runs.groupBy("key").agg(F.collect_list(F.struct("pos", "n", "off", "mh")).alias("runs"))
    return texts.join(wanted, texts["_key"] == wanted["key"]).select("key", "text", "runs").mapInArrow(step, schema)


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int | None = None) -> DataFrame:
    """Of ``docs`` (_key long unique, text string): rows (_key, spans array<struct<pos,n>>), unmerged spans to remove."""
    group = group or GROUP
    texts = docs.select("_key", "text")
    found = _copies(texts.mapInArrow(_Scan(length, gram, _ranks(texts, length, gram)), ROWS), length)
    spans, width = [], length - gram + 1  # places an anchor can have in a window
    while True:
        spans.append(found.where(F.col("kind") == SPAN))
        runs = found.where(F.col("kind") == RUN).select("key", "pos", "n", "off", "mh")
        sizes = runs.groupBy("mh").agg(F.count(F.lit(1)).alias("c"))
        crowded = settle(sizes.where(F.col("c") > group).select("mh"))
        more = not crowded.isEmpty()
        few = runs
        if more or len(spans) > 1:
            few = runs.join(settle(sizes.where(F.col("c").between(2, group)).select("mh")), "mh", "left_semi")
        sorted_ = _fetched(texts, few, _Fetch(length), RUNS).repartition("mh").sortWithinPartitions("mh", "key", "pos")
        spans.append(settle(sorted_.mapInArrow(_Compare(length), "key long, pos long, n long")))
        if not more:
            break
        half = 1 << max(0, width.bit_length() - 2)  # powers of two: classes of a round lie in those before
        parted = _fetched(texts, runs.join(crowded, "mh", "left_semi"), _Part(length, length - gram + 1, half), ROWS)
        found, width = _copies(parted, length), half
    union = spans[0].select("key", "pos", "n")
    for x in spans[1:]:
        union = union.unionAll(x.select("key", "pos", "n"))
    return union.groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("pos", "n")).alias("spans"))


def _removed(docs: DataFrame, length: int, as_text: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, maybe _rest) with _kept (binary, the bytes left), _n_bytes, _n_removed, _n_spans.

    ``as_text``: only ``docs`` with its text cut. Texts that lose nothing stay as they are.
    """
    own = keyed(docs)
    spans = removed_spans(own, length)
    schema = StructType([*docs.schema.fields])
    for name, kind in () if as_text else (("_kept", "binary"), ("_n_bytes", "long"), ("_n_removed", "long"), ("_n_spans", "long")):
        schema = schema.add(name, kind)
    return own.join(spans, "_key", "left").select(*docs.columns, "spans").mapInArrow(_Cut(as_text), schema)


def dedup_substrings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes cut from its text; bytes of a character that a cut has split go too.

    A null text stays null; n_chars, where it is there, is counted again.
    """
    return unfold(_removed(fold(docs), length, as_text=True), docs.columns)


def op8(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return _removed(docs.select("doc_id", "text"), LENGTH).select(
        "doc_id",
        F.col("_n_bytes").alias("n_bytes"),
        F.col("_n_removed").alias("n_removed"),
        F.col("_n_spans").alias("n_spans"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )


def merged(spans) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the union of (start, length) spans."""
    if not len(spans):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.fromiter((s["pos"] for s in spans), np.int64, len(spans))
    end = start + np.fromiter((s["n"] for s in spans), np.int64, len(spans))
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:], len(start)) - 1
    return start[new], reach[last]


class _Cut:
    def __init__(self, as_text: bool):
        self.as_text = as_text

    def __call__(self, batches):
        for batch in sliced(batches):
            names = batch.schema.names
            at, text_at = names.index("spans"), names.index("text")
            kept, total, gone, runs = [], [], [], []
            for value, spans in zip(batch.column(text_at).to_pylist(), batch.column(at).to_pylist()):
                raw = (value or "").encode()
                start, end = merged(spans or ())
                edges = [0, *np.stack([start, end], 1).ravel().tolist(), len(raw)]
                left = b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                # A split character's other bytes can't stay in a text.
                kept.append((left.decode("utf-8", "ignore") if len(start) else value) if self.as_text else left)
                total.append(len(raw))
                gone.append(int((end - start).sum()))
                runs.append(len(start))
            columns = dict(zip(names, batch.columns))
            del columns["spans"]
            if self.as_text:
                columns["text"] = pa.array(kept, pa.string())
            else:
                columns["_kept"] = pa.array(kept, pa.binary())
                for n, x in (("_n_bytes", total), ("_n_removed", gone), ("_n_spans", runs)):
                    columns[n] = pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _batch(**columns) -> pa.RecordBatch:
    """Columns of ROWS as numbers or arrays."""
    size = max(len(x) for x in columns.values() if isinstance(x, np.ndarray))
    names, kinds = zip(*(x.split() for x in ROWS.split(", ")))
    arrays = []
    for name, kind in zip(names, kinds):
        x = columns[name]
        x = x if isinstance(x, np.ndarray) else np.full(size, x)
        arrays.append(pa.array(x.view(np.int64) if x.dtype == U else x.astype(np.int32 if kind == "int" else np.int64)))
    return pa.RecordBatch.from_arrays(arrays, names=list(names))


class _Scan:
    """Texts to runs of windows with one anchor, and spans of runs copied within a buffer (at common anchors: within a task)."""

    def __init__(self, length: int, gram: int, common: tuple[np.ndarray, np.ndarray] | None = None):
        self.length, self.gram, self.common = length, gram, common

    def __call__(self, batches):
        rank = np.zeros(BUCKETS, np.uint8)
        if self.common is not None:
            rank[self.common[0]] = self.common[1]
        seen: dict[bytes, tuple] = {}
        for buf, lens, keys, base in self.pieces(batches):
            yield from self.runs(buf, lens, keys, base, rank, seen)
        if seen:
            key, pos, n, off, mh = (np.array(x) for x in zip(*seen.values()))
            h1, h2 = _digests(b"".join(seen))
            yield _batch(kind=0, key=key, pos=pos, n=n, off=off, salt=1 + h2 % SALTS, mh=mh, h1=h1, h2=h2)

    def pieces(self, batches):
        """Buffers of PIECE bytes at most: (bytes, lengths of its texts, their keys, place of the first byte in its text)."""
        for batch in sliced(batches):
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = texts.buffers()[2]
            if data is None or not len(keys):
                continue
            data = np.frombuffer(data, np.uint8)
            i = 0
            while i < len(keys):
                j = int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1
                if j > i:
                    yield data[offsets[i] : offsets[j]], np.diff(offsets[i : j + 1]), keys[i:j], 0
                    i = j
                    continue
                step = PIECE - self.length + 1  # a long text in overlapping parts: each window lies in one
                for s in range(0, int(offsets[i + 1] - offsets[i]), step):
                    part = data[offsets[i] + s : min(offsets[i] + s + PIECE, offsets[i + 1])]
                    yield part, np.array([len(part)]), keys[i : i + 1], s
                i += 1

    def grams(self, buf):
        r = rolling(1)
        p = r.prefix(buf)
        return mix((p[self.gram :] - p[: -self.gram]) * r.inverse[: len(buf) - self.gram + 1])

    def runs(self, buf, lens, keys, base, rank, seen):
        length, width = self.length, self.length - self.gram + 1
        if len(buf) < length:
            return
        low = U(PIECE - 1)
        grams = self.grams(buf)
        common = rank[(grams & U(BUCKETS - 1)).astype(np.int64)]
        least = (((grams >> U(2)) | (common.astype(U) << U(62))) & ~low) | np.arange(len(grams), dtype=U)
        d = 1
        while 2 * d <= width:
            least = np.minimum(least[:-d], least[d:])
            d *= 2
        if d < width:
            least = np.minimum(least[: d - width], least[width - d :])
        doc = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
        w = np.flatnonzero(doc[: len(least)] == doc[length - 1 : length - 1 + len(least)])
        if not len(w):
            return
        anchor, doc = (least[w] & low).astype(np.int64), doc[w]
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
        start, n = w[first], np.diff(np.append(first, len(w)))
        anchor, doc = anchor[first], doc[first]
        end = start + n + length - 1
        h1, h2 = _contents(buf.tobytes(), start, end)
        text_at = np.cumsum(lens) - lens
        key, pos = keys[doc], start - text_at[doc] + base
        order = np.lexsort((pos, key, h2, h1))
        copy = np.zeros(len(order), bool)
        copy[order[1:]] = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        gone = [(key[copy], pos[copy], (pos + n + length - 1)[copy])]
        out = {"key": key, "pos": pos, "n": n, "off": anchor - start, "mh": grams[anchor].view(np.int64)}
        if len(hot := np.flatnonzero(~copy & (common[anchor] > 0))):
            stay, late = [], []
            names = np.stack([h1[hot], h2[hot]], 1).tobytes()
            for i, row in enumerate(zip(*(x[hot].tolist() for x in out.values()))):
                name = names[16 * i : 16 * i + 16]
                old = seen.get(name)
                if old is None:
                    if len(seen) < SEEN:
                        seen[name] = row
                    else:
                        stay.append(hot[i])
                    continue
                seen[name] = min(row, old)  # by key, then pos
                late.append(max(row, old))
            if late:
                k, p, m, *_ = (np.array(x) for x in zip(*sorted(late)))
                gone.append((k, p, p + m + length - 1))
            go = np.array(stay, np.int64)
            if len(go):
                yield _batch(kind=0, **{k: v[go] for k, v in out.items()}, salt=1 + h2[go] % SALTS, h1=h1[go], h2=h2[go])
        if len(k := np.flatnonzero(~copy & (common[anchor] == 0))):
            yield _batch(kind=0, **{c: v[k] for c, v in out.items()}, salt=0, h1=h1[k], h2=h2[k])
        for key, pos, end in gone:  # in order: runs that meet become one span
            if len(key):
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (pos[1:] > end[:-1])])
                last = np.append(np.flatnonzero(new)[1:], len(new)) - 1
                key, pos, n = key[new], pos[new], end[last] - pos[new]
                deal = mix(mix(key.astype(U)) + pos.astype(U))
                yield _batch(kind=SPAN, key=key, pos=pos, n=n, off=0, salt=0, mh=deal, h1=0, h2=0)


def _digests(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(joined, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _contents(raw: bytes, start, end) -> tuple[np.ndarray, np.ndarray]:
    """Digests of raw[start:end] as two numbers each."""
    digest = hashlib.blake2b
    return _digests(b"".join([digest(raw[i:j], digest_size=16).digest() for i, j in zip(start.tolist(), end.tolist())]))


class _Heat:
    """Texts to the number of their grams in each crowded bucket, and in bucket -1 in all."""

    def __init__(self, scan: _Scan):
        self.scan = scan

    def __call__(self, batches):
        n = np.zeros(BUCKETS, np.int32)
        for buf, *_ in self.scan.pieces(batches):
            if len(buf) >= self.scan.gram:
                n += np.bincount((self.scan.grams(buf) & U(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS).astype(np.int32)
        total = int(n.sum())
        # What is common in all has over twice this task's mean in some: buckets below that are not worth a row.
        bucket = np.flatnonzero(n > 2 * total // BUCKETS + 8)
        columns = [np.append(bucket, -1).astype(np.int32), np.append(n[bucket], total).astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["bucket", "n"])


class _Copies:
    """Sorted runs: all but the first of each content become spans; others of a shared anchor go on.

    Holds one row between batches, however large a group is. A part of a salted group can't tell whether
    its anchor is shared, so all its contents go on.
    """

    def __init__(self, length: int):
        self.length = length

    def __call__(self, batches):
        last, held = None, None
        for batch in batches:
            c = {k: batch.column(i).to_numpy() for i, k in enumerate(batch.schema.names)}
            if len(done := np.flatnonzero(c["kind"] == SPAN)):
                yield _batch(kind=SPAN, **{k: c[k][done] for k in ("key", "pos", "n")}, off=0, salt=0, mh=0, h1=0, h2=0)
                c = {k: v[c["kind"] != SPAN] for k, v in c.items()}
            size = len(c["key"])
            if not size:
                continue
            names = ("mh", "salt", "h1", "h2")
            before = last or (None,) * 4
            fresh, new = np.zeros(size, bool), np.zeros(size, bool)  # a new group, a new content
            fresh[0] = (c["mh"][0], c["salt"][0]) != before[:2]
            for k in names[:2]:
                fresh[1:] |= c[k][1:] != c[k][:-1]
            new[0] = tuple(c[k][0] for k in names) != before
            for k in names:
                new[1:] |= c[k][1:] != c[k][:-1]
            if len(copy := np.flatnonzero(~new)):
                yield _batch(
                    kind=SPAN, key=c["key"][copy], pos=c["pos"][copy], n=c["n"][copy] + self.length - 1,
                    off=0, salt=0, mh=0, h1=0, h2=0,
                )
            last = tuple(c[k][-1] for k in names)
            at = np.flatnonzero(new)
            if not len(at):
                continue
            if held is not None and not fresh[at[0]]:
                yield held
            go = ~fresh[at] | (c["salt"][at] > 0)
            go[:-1] |= ~fresh[at][1:]
            out = {k: c[k][at] for k in ("key", "pos", "n", "off", "salt", "mh", "h1", "h2")}
            if go.any():
                yield _batch(kind=RUN, **{k: v[go] for k, v in out.items()})
            held = None if go[-1] else _batch(kind=RUN, **{k: v[-1:] for k, v in out.items()})


class _Fetch:
    """Texts and the runs wanted of them to the runs' bytes."""

    def __init__(self, length: int):
        self.length = length

    def __call__(self, batches):
        for batch in sliced(batches):
            rows = []
            for key, text, runs in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = text.encode()
                rows += [(x["mh"], key, x["pos"], x["n"], x["off"], raw[x["pos"] : x["pos"] + x["n"] + self.length - 1]) for x in runs]
                if len(rows) >= 20_000:
                    yield self.batch(rows)
                    rows = []
            if rows:
                yield self.batch(rows)

    @staticmethod
    def batch(rows):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        names = ["mh", "key", "pos", "n", "off", "bytes"]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)


class _Part:
    """Texts and runs of crowded anchors to runs of fewer places of the anchor: those that all windows in a class of ``half`` places share."""

    def __init__(self, length: int, places: int, half: int):
        self.length, self.places, self.half = length, places, half

    def __call__(self, batches):
        for batch in sliced(batches):
            rows, names = [], []
            for key, text, runs in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = text.encode()
                for x in runs:
                    anchor = x["pos"] + x["off"]
                    low = x["off"] - x["n"] + 1
                    for c in range(low // self.half, x["off"] // self.half + 1):
                        lo, hi = c * self.half, min((c + 1) * self.half, self.places) - 1  # windows start so far before the anchor
                        name = raw[anchor - lo : anchor + self.length - hi]
                        lo, hi = max(lo, low), min(hi, x["off"])
                        body = raw[anchor - hi : anchor - lo + self.length]
                        names.append(hashlib.blake2b(name, digest_size=8, salt=c.to_bytes(4)).digest() + hashlib.blake2b(body, digest_size=16).digest())
                        rows.append((key, anchor - hi, hi - lo + 1, hi))
                if len(rows) >= 20_000:
                    yield self.batch(rows, names)
                    rows, names = [], []
            if rows:
                yield self.batch(rows, names)

    @staticmethod
    def batch(rows, names):
        key, pos, n, off = (np.array(x) for x in zip(*rows))
        mh, h1, h2 = np.frombuffer(b"".join(names), np.int64).reshape(-1, 3).T
        return _batch(kind=0, key=key, pos=pos, n=n, off=off, salt=1 + h2 % SALTS, mh=mh, h1=h1, h2=h2)


class _Compare:
    """Runs of a shared anchor, group by group: suffix sort, common-prefix intervals, spans (key, pos, n)."""

    def __init__(self, length: int):
        self.length = length

    def __call__(self, batches):
        rest = None
        for batch in sliced(batches):
            whole = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()[0]
            mh = whole.column(0).to_numpy()
            cut = np.flatnonzero(mh != mh[-1])
            cut = int(cut[-1]) + 1 if len(cut) else 0  # the last group may go on
            rest = whole.slice(cut)
            if cut:
                yield from self.groups(whole.slice(0, cut))
        if rest is not None and len(rest):
            yield from self.groups(rest)

    def groups(self, batch):
        length = self.length
        mh, key, pos, n, off = (batch.column(i).to_numpy().astype(np.int64) for i in range(5))
        raw = batch.column(5).to_pylist()
        size = np.array([len(x) for x in raw], dtype=np.int64)
        text = b"".join(raw)
        begin = np.cumsum(size) - size
        r = rolling(1)
        buf = np.frombuffer(text, np.uint8)
        prefix = r.prefix(buf)
        new = np.concatenate([[True], mh[1:] != mh[:-1]])
        group = np.cumsum(new) - 1
        count = np.bincount(group)
        first = np.flatnonzero(new)
        anchor, right = begin + off, size - off

        def order(a, b):
            """-1, 0, 1 as the suffix of run a is less, equal, greater than that of run b."""
            most = np.minimum(right[a], right[b])
            same = common_extension(r, prefix, anchor[a], anchor[b], most)
            out = np.sign(right[a] - right[b])
            differ = np.flatnonzero(same < most)
            x, y = a[differ], b[differ]
            out[differ] = np.where(
                buf[anchor[x] + same[differ]] < buf[anchor[y] + same[differ]], -1, 1
            )
            return out

        by = self.mergesort(group, first, count, order)
        lcp = np.zeros(len(by), dtype=np.int64)
        near = np.flatnonzero(group[by][1:] == group[by][:-1])
        a, b = by[near], by[near + 1]
        lcp[near + 1] = common_extension(r, prefix, anchor[a], anchor[b], np.minimum(right[a], right[b]))

        # Neighbours that are in order and have the common prefix claimed make the whole order right.
        def in_order(x, n, y, m, same):
            if text[x : x + same] != text[y : y + same]:
                return False
            return n == same or m > same and text[x + same] < text[y + same]

        ends = (v.tolist() for v in (anchor[a], right[a], anchor[b], right[b], lcp[near + 1]))
        true = np.fromiter((in_order(*v) for v in zip(*ends)), bool, len(near))
        collided = set(group[a[~true]].tolist())

        firsts = []  # of each window (run, d): the run that has it first
        for d in range(int(off.max()) + 1):
            has = (off >= d) & (off - n < d)
            interval = np.cumsum(lcp < length - d)
            at = np.flatnonzero(has[by])
            if not len(at):
                continue
            run, interval = by[at], interval[at]
            left = r.of(prefix, anchor[run] - d, anchor[run])
            o = np.lexsort((run, left, interval))  # rows come in (key, pos) order within a group
            run, interval, left = run[o], interval[o], left[o]
            fresh = np.concatenate([[True], (interval[1:] != interval[:-1]) | (left[1:] != left[:-1])])
            head = run[np.maximum.accumulate(np.where(fresh, np.arange(len(run)), 0))]
            later = np.flatnonzero(run != head)
            firsts.append((run[later], np.full(len(later), d), head[later]))
        run, d, head = (np.concatenate(x) for x in zip(*firsts))
        o = np.lexsort((d, head, run))
        run, d, head = run[o], d[o], head[o]
        if len(run):
            new = np.concatenate([[True], (run[1:] != run[:-1]) | (head[1:] != head[:-1]) | (d[1:] != d[:-1] + 1)])
            tail = np.append(np.flatnonzero(new)[1:], len(new)) - 1
            run, head, low, high = run[new], head[new], d[new], d[tail]
            true = np.fromiter(
                (
                    text[x - h : x - l + length] == text[y - h : y - l + length]
                    for x, y, l, h in zip(*(z.tolist() for z in (anchor[run], anchor[head], low, high)))
                ),
                bool,
                len(run),
            )
            collided |= set(group[run[~true]].tolist())
        for g in collided:  # hashes collided: these groups again by their bytes
            yield from self.by_bytes(range(first[g], first[g] + count[g]), key, pos, n, raw)
        if len(run):
            ok = ~np.isin(group[run], list(collided))
            run, low, high = run[ok], low[ok], high[ok]
            yield self.spans(key[run], pos[run] + off[run] - high, high - low + length)

    @staticmethod
    def spans(*columns):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in columns], names=["key", "pos", "n"])

    def by_bytes(self, runs, key, pos, n, raw):
        """The same for one group without hashes, for the case that they collide."""
        seen, out = set(), []
        for i in runs:
            for p in range(int(n[i])):
                w = raw[i][p : p + self.length]
                if w in seen:
                    out.append((int(key[i]), int(pos[i]) + p, self.length))
                seen.add(w)
        if out:
            yield self.spans(*zip(*out))

    @staticmethod
    def mergesort(group, first, count, order):
        """Row numbers, each group's in suffix order: bottom-up, all merges of a level at once.

        A row's place in a merged run is its place in its own half plus its rank in the other, found
        by binary search with suffix comparisons.
        """
        by = np.arange(len(group))
        width, most = 1, int(count.max())
        place = np.arange(len(group)) - first[group]
        while width < most:
            act = np.flatnonzero(count[group] > width)  # slots of groups that are not one run yet
            me, slot, g = by[act], place[act], group[act]
            block = slot // width
            other = np.minimum((block ^ 1) * width, count[g])
            lo = np.zeros(len(act), dtype=np.int64)
            hi = np.minimum(other + width, count[g]) - other
            is_right = (block & 1).astype(bool)
            while len(o := np.flatnonzero(lo < hi)):
                mid = (lo[o] + hi[o]) >> 1
                c = order(by[first[g[o]] + other[o] + mid], me[o])
                goes = (c < 0) | ((c == 0) & is_right[o])
                lo[o[goes]] = mid[goes] + 1
                hi[o[~goes]] = mid[~goes]
            to = first[g] + (block & ~1) * width + (slot - block * width) + lo
            by[to] = me
            width *= 2
        return by


#: The definition, window by window, on hexadecimal text (two characters a byte).
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d)),
later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS nth FROM w) WHERE nth > 1),
marked AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM later),
numbered AS (SELECT doc_id, p, sum(CASE WHEN gap IS NULL OR gap > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
runs AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, run, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS f, a AS t FROM runs
  UNION ALL SELECT doc_id, max(run) + 1, max(b), NULL FROM runs GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(CASE WHEN t IS NULL THEN substr(h, 2 * f + 1) ELSE substr(h, 2 * f + 1, 2 * (t - f)) END, '' ORDER BY run) AS h
  FROM pieces JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def brute_force(rows: list[tuple[int, str]], length: int = LENGTH) -> list[tuple]:
    """op8 for a small fixture, straight from the definition."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda x: x[0]):
        raw = (text or "").encode()
        mask = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                mask[p : p + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for i, m in enumerate(mask) if m and not (i and mask[i - 1]))
        kept = bytes(b for b, m in zip(raw, mask) if not m)
        out.append((doc_id, len(raw), sum(mask), runs, hashlib.sha256(kept).hexdigest()))
    return out
