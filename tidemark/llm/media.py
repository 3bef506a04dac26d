"""Media columns: interleaved document sequences.

HTML is parsed into an ordered sequence of text and media elements; a media element keeps its place,
its caption and the digest of its payload. Payloads are in a media store, a table (digest, media) of
PNG images of 8-bit RGB samples, 64 pixels (192 bytes) a row. A join on the digest resolves the
references with what is read back from the store; only small feature rows are joined, one for each
digest, so that a digest that a third of all documents share is a skewed but small join, which
Spark splits.

``op5`` makes a page of each text and keeps its whole sequence, texts by their length, beside the payload's
features; ``sequences`` does so for pages as they are, texts and all. ``composed`` makes pages of several paragraphs and media, and
the store that their references are resolved in, of documents.

Edge cases: a null text is an empty one; an empty payload is one row of spaces; repeated rows have
equal values; references without a stored payload stay, unresolved; a null html has no elements;
broken HTML is read as the standard library's parser reads it; a very long text is one payload in one
row, as it is in the table; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, sliced

ROW, DEEP = 192, 3
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_ELEMENT = pa.struct(
    [("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]
)
_PLACE = pa.struct(
    [("pos", pa.int32()), ("kind", pa.string()), ("chars", pa.int64()), ("ref", pa.string()), ("caption", pa.string())]
)
PLACES = "array<struct<pos: int, kind: string, chars: bigint, ref: string, caption: string>>"
ELEMENTS = "array<struct<pos: int, kind: string, text: string, ref: string, caption: string>>"
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_MEDIA = {"img": "image", "video": "video", "audio": "audio"}
_SILENT = {"script", "style"}
_BREAKS = {"p", "div", "article", "section", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "table", "figure"}


class _Interleaved(HTMLParser):
    """Elements in document order. A figure's caption belongs to its media; else the alternative text is the caption."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.text: list[str] = []
        self.silent = 0
        self.figure: list[int] | None = None
        self.caption: list[str] | None = None

    def _flush(self):
        text = "".join(self.text)
        self.text = []
        if text.strip():
            self._add("text", text=text)

    def _add(self, kind, text=None, ref=None, caption=None):
        self.out.append({"pos": len(self.out), "kind": kind, "text": text, "ref": ref, "caption": caption})

    def handle_starttag(self, tag, attrs):
        if tag in _MEDIA:
            self._flush()
            own = dict(attrs)
            self._add(_MEDIA[tag], ref=own.get("src"), caption=own.get("alt"))
            if self.figure is not None:
                self.figure.append(len(self.out) - 1)
        elif tag == "figcaption":
            self.caption = []
        elif tag in _SILENT:
            self.silent += 1
        elif tag in _BREAKS:
            self._flush()
            if tag == "figure":
                self.figure = []

    def handle_endtag(self, tag):
        if tag == "figcaption" and self.caption is not None:
            for i in self.figure or ():
                self.out[i]["caption"] = "".join(self.caption)
            self.caption = None
        elif tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in _BREAKS:
            self._flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data):
        if self.caption is not None:
            self.caption.append(data)
        elif not self.silent:
            self.text.append(data)


def elements(page: str | None) -> list[dict]:
    parser = _Interleaved()
    parser.feed(page or "")
    parser.close()
    parser._flush()
    return parser.out


def payload(text: str | None) -> tuple[bytes, int]:
    """The text in UTF-8 with spaces up to a positive multiple of ``ROW``, and its length before."""
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, b" "), len(raw)


def to_png(data: bytes) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = np.zeros((len(data) // ROW, ROW + 1), np.uint8)  # each line after its filter, 0: none
    lines[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW // 3, len(lines), 8, 2, 0, 0, 0)
    return b"".join([_SIGNATURE, chunk(b"IHDR", head), chunk(b"IDAT", zlib.compress(lines, DEEP)), chunk(b"IEND", b"")])


def from_png(media: bytes) -> np.ndarray:
    """Samples of an image that ``to_png`` wrote: lines by ROW bytes."""
    if not media.startswith(_SIGNATURE):
        raise ValueError("not a PNG")
    at, body, size = len(_SIGNATURE), [], None
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", data)
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[1], 3 * size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not written here")
    return lines[:, 1:]


def image_feature(lines: np.ndarray) -> str:
    """Height, the channels' sums, and a 64-bit average hash of the columns' luminance (sums, so exact)."""
    pixels = lines.reshape(len(lines), -1, 3)
    channels = pixels.sum(axis=(0, 1), dtype=np.int64)
    light = pixels.sum(axis=0, dtype=np.int64) @ np.array([299, 587, 114])
    bits = light * len(light) > light.sum()
    return f"{len(lines)}:{':'.join(map(str, channels))}:{np.packbits(bits).tobytes().hex()}"


class _Compose:
    """doc_id, text to doc_id, n_bytes, html, digest, media (null for a payload that the batch has stored already)."""

    def __call__(self, batches):
        for batch in sliced(batches):
            n_bytes, pages, digests, media, seen = [], [], [], [], set()
            for text in batch.column(1).to_pylist():
                data, n = payload(text)
                digest = hashlib.sha256(data).hexdigest()
                n_bytes.append(n)
                digests.append(digest)
                media.append(None if digest in seen else to_png(data))
                seen.add(digest)
                pages.append(
                    f"<article><p>{html.escape(text or '', quote=False)}</p><figure>"
                    f'<img src="sha256:{digest}"><figcaption>{n} bytes</figcaption></figure></article>'
                )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n_bytes, pa.int64()), self.sequence(pages),
                    pa.array(digests, pa.string()), pa.array(media, pa.binary()),
                ],
                names=["doc_id", "n_bytes", "sequence", "digest", "media"],
            )

    @staticmethod
    def sequence(pages):
        out = [[{"pos": x["pos"], "kind": x["kind"], "chars": len(x["text"] or ""), "ref": x["ref"], "caption": x["caption"]} for x in elements(p)] for p in pages]
        return pa.array(out, pa.list_(_PLACE))


#: Of the paragraphs of a document, each so many-th is a media element too.
FIGURES = 3


class _Paragraphs:
    """page_id, text to page_id, html (its lines as paragraphs, some with a figure of the line's payload) and stored (digest, media)."""

    def __call__(self, batches):
        kind = pa.list_(pa.struct([("digest", pa.string()), ("media", pa.binary())]))
        for batch in sliced(batches):
            pages, stored, seen = [], [], set()
            for text in batch.column(1).to_pylist():
                page, own = [], []
                for i, line in enumerate(x for x in (text or "").split("\n") if x.strip()):
                    page.append(f"<p>{html.escape(line, quote=False)}</p>")
                    if i % FIGURES == 0:
                        data, n = payload(line)
                        digest = hashlib.sha256(data).hexdigest()
                        if digest not in seen:
                            own.append({"digest": digest, "media": to_png(data)})
                            seen.add(digest)
                        page.append(f'<figure><img src="sha256:{digest}" alt=""><figcaption>paragraph {i}, {n} bytes</figcaption></figure>')
                pages.append(f"<article>{''.join(page)}</article>")
                stored.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages, pa.string()), pa.array(stored, kind)], names=["page_id", "html", "stored"])


def composed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages (page_id, html) made of documents (doc_id, text), and the store (digest, media) of their media; a payload may be there more than once."""
    made = settle(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_Paragraphs(), "page_id long, html string, stored array<struct<digest: string, media: binary>>"))
    return made.select("page_id", "html"), made.select(F.explode("stored").alias("x")).select("x.*")


def document_sequences(docs: DataFrame) -> DataFrame:
    """The whole sequences of pages composed of ``docs``, with what the store has of each media element."""
    return sequences(*composed(docs)).withColumnRenamed("page_id", "doc_id")


class _Parse:
    """The ``html`` column of a batch replaced by its elements."""

    def __call__(self, batches):
        for batch in sliced(batches):
            at = batch.schema.names.index("html")
            yield batch.set_column(at, "elements", pa.array([elements(x.as_py()) for x in batch.column(at)], pa.list_(_ELEMENT)))


class _ReadBack:
    """digest, media to digest and the features of the stored bytes."""

    def __call__(self, batches):
        for batch in sliced(batches):
            rows = []
            for media in batch.column(1).to_pylist():
                lines = from_png(media)
                data = lines.tobytes()
                rows.append((
                    len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media),
                    hashlib.sha256(media).hexdigest(), image_feature(lines),
                ))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            names = [x.split()[0] for x in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["digest", *names])


def interleaved(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, html) to page_id, elements."""
    return pages.select("page_id", "html").mapInArrow(_Parse(), f"{pages.select('page_id').schema.simpleString()[7:-1].replace(':', ' ')}, elements {ELEMENTS}")


def media_features(store: DataFrame) -> DataFrame:
    """Of a store (digest, media): one row of features for each digest."""
    names = [x.split()[0] for x in FEATURES.split(", ")]
    read = store.select("digest", "media").mapInArrow(_ReadBack(), f"digest string, {FEATURES}")
    return settle(read.groupBy("digest").agg(*(F.min(x).alias(x) for x in names)))


def resolve(references: DataFrame, features: DataFrame) -> DataFrame:
    """Rows with a ``ref`` (sha256:digest) to the same with the features of what the store has under it."""
    own = references.withColumn("_digest", F.regexp_extract("ref", "^sha256:([0-9a-f]{64})$", 1))
    return own.join(features, own["_digest"] == features["digest"], "left").drop("_digest", "digest")


def sequences(pages: DataFrame, store: DataFrame) -> DataFrame:
    """``pages`` (page_id, html) to page_id, n_texts, n_media, sequence: ordered structs of texts and of media with what ``store`` has of them.

    A page is parsed once, and numbered as it is written. Only references go through the join, a page's elements come together again by their places.
    """
    own = settle(interleaved(pages).withColumn("_row", F.monotonically_increasing_id()))
    refs = own.select("_row", F.explode("elements").alias("x")).where("x.ref is not null").select("_row", "x.pos", "x.ref")
    found = resolve(refs, media_features(store)).where("media_bytes is not null")
    found = found.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct("media_bytes", "media_sha256", "feature")))).alias("_found"))
    known = F.coalesce("_found", F.create_map().cast("map<int, struct<media_bytes: bigint, media_sha256: string, feature: string>>"))
    whole = F.transform("elements", lambda x: F.struct(
        x["pos"].alias("pos"), x["kind"].alias("kind"), x["text"].alias("text"), x["ref"].alias("ref"), x["caption"].alias("caption"),
        F.try_element_at(F.col("_known"), x["pos"]).alias("media"),
    ))
    return own.join(found, "_row", "left").withColumn("_known", known).select(
        "page_id", F.size(F.filter("elements", lambda x: x["kind"] == "text")).alias("n_texts"),
        F.size(F.filter("elements", lambda x: x["kind"] != "text")).alias("n_media"), whole.alias("sequence"),
    )


def page_sequences(pages: DataFrame) -> DataFrame:
    """The sequences of ``pages`` without a store: references stay unresolved."""
    return sequences(pages, pages.sparkSession.createDataFrame([], "digest string, media binary"))


def op5(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; then pos, caption, sequence."""
    schema = f"doc_id long, n_bytes long, sequence {PLACES}, digest string, media binary"
    stored = settle(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_Compose(), schema))
    features = media_features(stored.where("media is not null"))
    refs = stored.select("doc_id", "n_bytes", "sequence", F.explode("sequence").alias("x")).where("x.ref is not null")
    refs = refs.select("doc_id", "n_bytes", "sequence", "x.pos", "x.caption", "x.ref")
    return resolve(refs, features).select(
        "doc_id", "n_bytes", *(x.split()[0] for x in FEATURES.split(", ")), "pos", "caption", "sequence"
    )
