"""Interleaved sequences against a reader and a feature of their own."""

from __future__ import annotations

import hashlib
import struct
import zlib

from tests.llm.test_llm_operators import DOC, SF, clashing
from tidemark.llm import media
from tidemark.llm.queries import QUERIES


def read_png(data):
    """Rows of bytes of an 8-bit RGB image with any filters, by the format's definition."""
    assert data[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, packed = 8, b""
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        kind, body, crc = data[at + 4 : at + 8], data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        assert zlib.crc32(kind + body) == int.from_bytes(crc, "big")
        if kind == b"IHDR":
            width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", body)
            assert (depth, colour, rest) == (8, 2, [0, 0, 0])
        packed += body if kind == b"IDAT" else b""
        at += 12 + n
    raw, step, rows = zlib.decompress(packed), 3 * width, []
    assert kind == b"IEND" and len(raw) == height * (step + 1)
    above = [0] * step
    for y in range(height):
        rule, line = raw[y * (step + 1)], list(raw[y * (step + 1) + 1 : (y + 1) * (step + 1)])
        for x in range(step):
            a, b, c = (line[x - 3] if x > 2 else 0), above[x], (above[x - 3] if x > 2 else 0)
            nearest = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            line[x] = (line[x] + (0, a, b, (a + b) // 2, nearest)[rule]) % 256
        rows.append(bytes(line))
        above = line
    return rows


def feature(rows):
    """Height, sums of the channels, and which columns are lighter than the mean."""
    sums = [sum(sum(r[k::3]) for r in rows) for k in range(3)]
    light = [sum(299 * r[3 * x] + 587 * r[3 * x + 1] + 114 * r[3 * x + 2] for r in rows) for x in range(64)]
    bits = "".join(str(int(v * 64 > sum(light))) for v in light)
    return f"{len(rows)}:{':'.join(map(str, sums))}:{int(bits, 2):016x}"


def expected(text):
    """(pos, kind, text, ref, caption, feature) of a document's page."""
    out = []
    for i, line in enumerate(x for x in (text or "").split("\n") if x.strip()):
        out.append((len(out), "text", line, None, None, None))
        if i % 3 == 0:
            raw = line.encode()
            data = raw + b" " * ((-len(raw)) % 192 if raw else 192)
            rows = [data[k : k + 192] for k in range(0, len(data), 192)]
            ref, caption = f"sha256:{hashlib.sha256(data).hexdigest()}", f"paragraph {i}, {len(raw)} bytes"
            out.append((len(out), "image", None, ref, caption, (len(data), feature(rows))))
    return out


def found(df):
    return sorted(
        ((r.doc_id, [(x.pos, x.kind, x.text, x.ref, x.caption, x.media and (len(r.sequence) and _size(x), x.media.feature)) for x in r.sequence]) for r in df.collect()),
        key=str,
    )


def _size(x):
    return int(x.media.feature.partition(":")[0]) * 192


def test_whole_sequences_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = found(QUERIES["media_document_sequences"](spark, SF))
    assert got == sorted(((i, expected(t)) for i, t in rows), key=str)
    assert sum(len(s) > 4 for _, s in got) > 20 and all(x[5] for _, s in got for x in s if x[1] == "image")


def test_stored_images_read_back(spark):
    pages, store = media.composed(spark.read.parquet(f"{SF}/documents.parquet"))
    for r in store.limit(60).collect():
        rows = read_png(bytes(r.media))
        assert hashlib.sha256(b"".join(rows)).hexdigest() == r.digest
        assert media.image_feature(media.from_png(bytes(r.media))) == feature(rows)


def test_payload_query_against_its_own_reader(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op5_media_columns"](spark, SF).collect():
        data = docs[r.doc_id] + b" " * ((-len(docs[r.doc_id])) % 192 if docs[r.doc_id] else 192)
        assert r.feature == feature([data[k : k + 192] for k in range(0, len(data), 192)])


def test_odd_documents(spark):
    long = "\n".join(f"line {i} <b>&amp;" for i in range(5000))
    rows = [(1, None), (2, ""), (3, "\n \n"), (4, "a\n\nb & <i>c</i>\nd\ne"), (4, "a\n\nb & <i>c</i>\nd\ne"), (None, "x"), (5, long)]
    df = spark.createDataFrame(rows, DOC)
    assert found(media.document_sequences(df)) == sorted(((i, expected(t)) for i, t in rows), key=str)
    assert media.document_sequences(df.where("false")).count() == 0
    assert media.document_sequences(clashing(spark)).count() == 5


def test_pages_are_parsed_once(spark, monkeypatch):
    parsed, own = spark.sparkContext.accumulator(0), media._Parse

    class Counting:
        def __call__(self, batches):
            for batch in own()(batches):
                parsed.add(batch.num_rows)
                yield batch

    monkeypatch.setattr(media, "_Parse", Counting)
    rows = [(i % 70, f"line {i}\nother {i % 3}") for i in range(100)]
    df = spark.createDataFrame(rows, DOC).repartition(3)
    assert found(media.document_sequences(df)) == sorted(((i, expected(t)) for i, t in rows), key=str)
    assert parsed.value == 100
