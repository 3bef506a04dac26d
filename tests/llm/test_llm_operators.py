"""The training-data operators against brute force, round trips and held-out labels, with their edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from tests.oracle import connection, rows
from tidemark.llm import (
    bpe,
    chat,
    common,
    embedding_dedup,
    line_dedup,
    media,
    near_dedup,
    packing,
    quality,
    simhash,
    suffix_dedup,
    url_filter,
)
from tidemark.llm.queries import ORACLE_SQL, QUERIES

SF, VOCABULARY = "/root/testdata/sf0.001", public_tokenizers.path("byte_bpe_50k.json")
DOC = "doc_id long, text string"


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts(spark):
    return [tuple(r) for r in documents(spark).select("doc_id", "text").collect()]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def clashing(spark):
    """Documents with other columns that have names the operators might use, and nulls in all columns."""
    schema = "n int, doc_id long, _key string, spans string, text string, _rest string, label int, n_chars int, _score string, key long"
    values = [
        (1, 5, "k", None, "one two three\nfour five six\nseven", "r", 1, 3, "s", 1),
        (None, None, None, None, None, None, None, None, None, None),
        (2, 7, "k", "x", "one two three\nfour five six\nseven", "r", 1, 3, "s", 1),
        (2, 7, "k", "x", "one two three\nfour five six\nseven", "r", 1, 3, "s", 1),
        (3, 8, "k", "x", "", "r", 1, 3, "s", 1),
    ]
    return spark.createDataFrame(values, schema)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, name):
    frame = QUERIES[name](spark, SF).toPandas()
    want = connection(SF).execute(ORACLE_SQL[name]).df()
    assert sorted(frame.columns) == sorted(want.columns)
    assert rows(frame) == rows(want)


# quality


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = QUERIES["op1_quality_classifier"](spark, sf)
    assert out.count() == documents(spark, sf).count()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = out.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").toPandas()
    assert (held.predicted == held.quality).mean() > 0.98
    assert ((held.quality == 1) & (held.predicted == 0)).mean() < 0.01
    assert ((held.quality == 0) & (held.predicted == 1)).sum() < 0.12 * (held.quality == 0).sum()
    # calibrated: the mean square error is small, and scores add up to the labels in the parts above and below one half
    assert ((held.score - held.quality) ** 2).mean() < 0.02
    for part in (held[held.score < 0.5], held[held.score >= 0.5]):
        assert abs(part.score.mean() - part.quality.mean()) < 0.05


def test_quality_brute_force(spark):
    """Each score again: compressed sizes by plain calls, differences, and the curve term by term."""
    import math

    import zstandard

    model = quality.fit(documents(spark), spark.read.parquet(f"{SF}/labels.parquet"))
    out = {r.doc_id: r._score for r in quality.scored(documents(spark), model).collect()}

    def size(part, dictionary):
        own = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        z = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False, **own)
        return len(z.compress(part))

    def score(text):
        raw, x = text.encode(), []
        sums = {}
        for n in (2048, 256):
            parts = [raw[i : i + n] for i in range(0, len(raw), n)]
            g, b, p = ([size(part, d) for part in parts] for d in (model.good, model.bad, b""))
            sums[n] = sum(g)
            x += [(sum(b) - sum(g)) / max(sum(b), sum(g)), min((v - u) / max(u, v) for u, v in zip(g, b)), (sum(p) - sum(g)) / max(sum(p), sum(g))]
        x.append((sums[256] - sums[2048]) / max(sums.values()))
        z = [2 * (min(max(v, lo), hi) - lo) / max(hi - lo, 1e-9) - 1 for v, lo, hi in zip(x, model.low, model.high)]
        return 1 / (1 + math.exp(-sum(w * v for w, v in zip(model.weights, [1, *z, *(v * v for v in z)]))))

    short = [(i, t) for i, t in texts(spark) if t and len(t) < 3000][:25]
    assert len(short) == 25
    for i, t in short:
        assert abs(out[i] - score(t)) < 0.02  # a dictionary that is digested in advance may differ by a byte


def test_quality_folds_and_scores(spark):
    out = QUERIES["op1_quality_classifier"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x" * 100_000)], DOC)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.op1(docs, none).collect()} == {0.5}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(documents(spark), labels)
    assert len({r._score for r in quality.scored(docs.where("doc_id = 2"), model).collect()}) == 1
    assert quality.scored(docs.limit(0), model).count() == 0
    assert quality.op1(docs.limit(0), labels).count() == 0
    assert quality.op1(clashing(spark), labels).columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    kept = quality.accepted(clashing(spark), spark.createDataFrame([(5, None), (7, 2)], "doc_id long, quality int"))
    assert kept.columns == clashing(spark).columns and kept.count() == 5


# chat


def test_chat_prefixes_and_copies(spark):
    long = [("user", "a"), ("assistant", "b"), ("user", "c")]
    logs = {1: long[:1], 2: long[:2], 3: long, 4: long, 5: [("user", "z")], 6: [("user", None)], 7: [("user", "")]}
    data = [(i, t, role, text) for i, turns in logs.items() for t, (role, text) in enumerate(turns)]
    data += [data[0], (None, None, None, None)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.chat_format(df.withColumn("l0", F.lit("clash"))).collect()}
    assert set(out) == {3, 5, 6, 7, None}
    assert out[3].n_copies == 2 and out[3].n_turns == 3
    assert out[3].text == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in long)
    assert chat.chat_format(df.limit(0)).count() == 0


def test_chat_very_long_conversation(spark):
    data = [(1, t, "user", f"turn {t}") for t in range(1000)] + [(2, t, "user", f"turn {t}") for t in range(700)]
    out = chat.chat_format(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()
    assert {r.conv_id for r in out} == {1} and sum(r.part_turns for r in out) == 1000
    whole = "".join(r.text for r in sorted(out, key=lambda r: r.part_start))
    assert whole.count("<|im_start|>") == 1000 and whole.index("turn 299<") < whole.index("turn 300<")


def test_chat_runs_no_python(spark):
    plan = chat.chat_format(spark.read.parquet(f"{SF}/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# tokens


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts():
    rnd = random.Random(5)
    letters = "ab  \n\t'sdlrvtm 012 éüñß!?.,\x1c\x85\xa0​　日本🙂́A"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + [
        "", " ", "<|endoftext|>", " <|endoftext|>x  <|endoftext|> ", "a" * 5000, " " * 700, "the of and " * 300, "<|endoftext|",
    ]


def test_automaton_encodes_as_the_library(library):
    own, ranked = bpe.Automaton(VOCABULARY), packing.Ranked(VOCABULARY)
    own.remembered = 50  # memories of two generations must not change results
    for text, want in zip(odd_texts(), library.encode_batch(odd_texts(), add_special_tokens=False)):
        ids = np.frombuffer(own.encode(text), "<u2").tolist()
        assert ids == want.ids, repr(text)
        assert own.decode(ids).decode() == library.decode(ids, skip_special_tokens=False) == text
        assert ranked.encode(text) == own.encode(text)


def gadget_automaton(letters, merges):
    """States and arcs by successive merge gadgets, written out: arcs[state][token] = state."""
    arcs = [{x: 0 for x in letters}]
    for u, v in merges:
        held = sorted({a[u] for a in arcs if u in a and v in arcs[a[u]]})
        copies, led = {}, {q: arcs[q][v] for q in held}
        for q in held:
            copies[q] = len(arcs)
            arcs.append({t: to for t, to in arcs[q].items() if t != v})
        for a in arcs:
            if u in a and a[u] in copies:
                q = a[u]
                a[u] = copies[q]
                a[u + v] = led[q]
    return arcs


@pytest.mark.parametrize("seed", range(6))
def test_automaton_of_few_merges(tmp_path, seed):
    """The subset automaton, the written-out gadgets and plain merging agree on all short words."""
    import itertools
    import json

    rnd = random.Random(seed)
    tokens, merges = ["a", "b", "c"], []
    while len(merges) < 7:
        u, v = rnd.choice(tokens), rnd.choice(tokens)
        if u + v not in tokens and len(u + v) < 6:
            tokens.append(u + v)
            merges.append((u, v))
    spec = {"model": {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": [f"{u} {v}" for u, v in merges]}, "added_tokens": []}
    (tmp_path / "v.json").write_text(json.dumps(spec))
    own = bpe.Automaton(str(tmp_path / "v.json"))
    arcs = gadget_automaton("abc", merges)
    assert len(arcs) <= 1 + sum(2**k for k in range(len(merges)))

    def merged(word):
        out = list(word)
        for u, v in merges:
            i = 0
            while i < len(out) - 1:
                if out[i] == u and out[i + 1] == v:
                    out[i : i + 2] = [u + v]
                i += 1
        return out

    for n in range(1, 8):
        for word in map("".join, itertools.product("abc", repeat=n)):
            want = merged(word)
            assert [tokens[i] for i in own.word(word.encode())] == want
            state = 0
            for t in want:  # the canonical encoding is a path of the written-out automaton
                state = arcs[state][t]
    for n in range(1, 4):  # and it has no others
        for path in itertools.product(tokens, repeat=n):
            state = 0
            for t in path:
                state = arcs[state].get(t) if state is not None else None
            assert (state is not None) == (merged("".join(path)) == list(path)), path
    assert len(own.subsets) < 400 and len(own.table) <= 3 * len(own.subsets)


def test_table_starts_anew(library, monkeypatch):
    own = bpe.Automaton(VOCABULARY)
    monkeypatch.setattr(bpe, "STATES", 40)
    text = "the quick brown fox jumps over the lazy dog, unbelievably"
    for word in text.split(" "):
        assert own.word(word.encode()) == library.encode(word, add_special_tokens=False).ids
    assert len(own.subsets) < 80


def test_codec_query(spark, library):
    out = {r.doc_id: r for r in QUERIES["op3_bpe_codec"](spark, SF).collect()}
    for i, text in texts(spark):
        ids = library.encode(text, add_special_tokens=False).ids
        assert out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_codec_edges(spark):
    out = bpe.op3(spark.createDataFrame([(1, None), (None, ""), (1, None)], DOC), VOCABULARY).collect()
    assert len(out) == 3 and {r.n_tokens for r in out} == {0}
    assert {r.ids_sha256 for r in out} == {hashlib.sha256(b"").hexdigest()}
    assert bpe.op3(clashing(spark), VOCABULARY).count() == 5 and bpe.op3(clashing(spark).limit(0), VOCABULARY).count() == 0
    with pytest.raises(ValueError, match="_ids"):
        bpe.encode(clashing(spark).withColumn("_ids", F.lit(1)), VOCABULARY)
    assert bpe.encode(clashing(spark), VOCABULARY).columns == [c if c != "text" else "_ids" for c in clashing(spark).columns]


def test_packing_query(spark, library):
    pieces = [r.asDict() for r in QUERIES["op9_packing"](spark, SF).collect()]
    for i, text in texts(spark):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        own = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        at = 0
        for p in own:
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append(p)
    sizes = []
    for own in by.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        sizes.append(at)
    assert sorted(sizes)[1:] == [2048] * (len(sizes) - 1)  # all but the last are full


def test_sequences(spark):
    pieces = packing.pack(documents(spark), VOCABULARY, length=64, with_ids=True)
    out = packing.sequences(pieces, 64, pad=-1).collect()
    assert all(len(r.tokens) == 64 for r in out) and sum(r.n for r in out) == pieces.agg(F.sum("length")).first()[0]


def test_packing_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a b")], DOC)
    out = packing.pack(docs, VOCABULARY).collect()
    assert sorted(r.length for r in out) == [1, 1, 1, 3] and {r.sequence_id for r in out} == {0}
    assert packing.pack(docs.limit(0), VOCABULARY).count() == 0
    assert packing.pack(clashing(spark), VOCABULARY).count() == 5


# lines


def test_lines_brute_force(spark):
    rnd = random.Random(1)
    data = []
    for i in range(300):
        n = rnd.randint(0, 12)
        data.append((i * 8 % 301, None if rnd.random() < 0.03 else "\n".join(rnd.choice(["", " \t", *"abcdefghijk"]) for _ in range(n))))
    df = spark.createDataFrame(data, DOC)
    assert got(line_dedup.op4(df)) == sorted(line_dedup.brute_force(data), key=str)
    for m in (1, 4):
        ours = line_dedup._deleted(df, m).select("doc_id", "_lines", "_deleted", "_runs", F.sha2(F.coalesce("text", F.lit("")), 256))
        assert got(ours) == sorted(line_dedup.brute_force(data, m), key=str)


def test_line_runs_brute_force(spark):
    """Open intervals with their lengths and copies, by comparing all suffixes."""
    rnd = random.Random(5)
    block = [f"line {i}" for i in range(11)]
    data = [(i, "\n".join(block[rnd.randrange(4) :][: rnd.randint(1, 9)] + [rnd.choice("abc") for _ in range(rnd.randint(0, 6))])) for i in range(60)]
    df = spark.createDataFrame(data, "_key long, text string")
    found = line_dedup.repeated_runs(df)[0].collect()
    ours = {(r.head._key, r.head.seq, r.len, r.n) for r in found}
    suffixes = [(i, s, tuple(t.split("\n")[s:])) for i, t in data for s in range(len(t.split("\n")))]
    want, depth = set(), 2
    while depth <= 16:
        groups = {}
        for i, s, run in suffixes:
            if len(run) >= depth:
                groups.setdefault(run[:depth], []).append((i, s, run))
        for g in groups.values():
            length = depth
            while len({run[: length + 1] for *_, run in g}) == 1 and len(g[0][2]) > length and all(len(r[2]) > length for r in g):
                length += 1
            if len(g) > 1 and length < 2 * depth:
                want.add((*min((i, s) for i, s, _ in g), length, len(g)))
        depth *= 2
    assert ours == want and max(r[2] for r in want) > 7


def test_lines_long(spark):
    """A long line goes also where it repeats alone; short ones stay."""
    long = " ".join(f"w{i}" for i in range(50))
    data = [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd"), (3, long[4:]), (4, f"x\n{long[4:]}"), (5, "a\nq")]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(data, DOC)).collect()}
    assert out == {1: data[0][1], 2: "c\nd", 3: data[2][1], 4: data[3][1], 5: "a\nq"}
    assert got(line_dedup.op4(spark.createDataFrame(data, DOC))) == sorted(line_dedup.brute_force(data), key=str)


def test_lines_edges(spark):
    out = line_dedup.dedup_lines(clashing(spark))
    assert out.columns == clashing(spark).columns
    kept = {(r.doc_id, r.text, r.n_chars) for r in out.collect()}
    assert kept == {(None, None, None), (5, "one two three\nfour five six\nseven", 33), (7, "", 0), (8, "", 0)}
    assert line_dedup.op4(clashing(spark).limit(0)).count() == 0


# media


def test_media_query(spark):
    out = {r.doc_id: r for r in QUERIES["op5_media_columns"](spark, SF).collect()}
    for i, text in texts(spark):
        raw = text.encode()
        data = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        r, png = out[i], media.to_png(data)
        assert media.from_png(png).tobytes() == data
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(data))
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest() and r.tail_crc32 == zlib.crc32(data[-16:])
        assert r.media_bytes == len(png) and r.media_sha256 == hashlib.sha256(png).hexdigest()
        assert r.caption == f"{len(raw)} bytes"
        assert [x.kind for x in r.sequence][-1] == "image" and r.sequence[r.pos].ref == f"sha256:{r.payload_sha256}"
        assert sum(x.chars for x in r.sequence) == len(text) if text.strip() else True


def test_media_edges(spark):
    out = media.op5(spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "é" * 96 + "<b>&amp;\0")], DOC)).collect()
    assert len(out) == 4 and len({r.feature for r in out if r.n_bytes == 0}) == 1
    assert [r.payload_bytes for r in out if r.doc_id is None] == [384]
    assert media.op5(spark.createDataFrame([], DOC)).count() == 0
    assert media.op5(clashing(spark)).count() == 5
    long = "wörd " * 300_000
    (row,) = media.op5(spark.createDataFrame([(1, long)], DOC)).collect()
    assert row.n_bytes == len(long.encode()) and row.payload_bytes % 192 == 0


def test_page_sequences(spark):
    """Texts, images and captions stay in their order, with what the store has of them."""
    png = media.to_png(b"abc" * 64)
    digest = hashlib.sha256(b"abc" * 64).hexdigest()
    image = f"<figure><img src='sha256:{digest}'><figcaption>cap</figcaption></figure>"
    rows = [(1, f"<p>one{image}two</p>{image}"), (2, "<img src='sha256:" + "0" * 64 + "' alt='gone'>"), (None, None), (1, f"<p>one{image}two</p>{image}"), (3, "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, html string, elements string")
    store = spark.createDataFrame([(digest, png)], "digest string, media binary")
    out = media.sequences(pages, store).collect()
    assert sorted((str(r.page_id), r.n_texts, r.n_media) for r in out) == [("1", 2, 2), ("1", 2, 2), ("2", 0, 1), ("3", 0, 0), ("None", 0, 0)]
    first = next(r for r in out if r.page_id == 1)
    assert [x.kind for x in first.sequence] == ["text", "image", "text", "image"] and [x.pos for x in first.sequence] == [0, 1, 2, 3]
    assert [x.media and x.media.media_sha256 for x in first.sequence] == [None, hashlib.sha256(png).hexdigest()] * 2
    assert first.sequence[1].caption == "cap" and next(r for r in out if r.page_id == 2).sequence[0].media is None
    assert media.sequences(pages.limit(0), store).count() == 0
    got = {r.page_id: [(x.pos, x.kind, x.text) for x in r.sequence] for r in QUERIES["media_page_sequences"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        assert got[r.page_id] == [(x["pos"], x["kind"], x["text"]) for x in media.elements(r.html)]


def test_interleaved_elements(spark):
    page = (
        "<h1>T &amp; U</h1><p>one<figure><img src='sha256:00' alt='x'><figcaption>cap</figcaption></figure>two"
        "<script>var a='<p>'</script><img src='b.png' alt='alt'><p>three"
    )
    found = [(e["pos"], e["kind"], e["text"] or e["ref"], e["caption"]) for e in media.elements(page)]
    assert found == [
        (0, "text", "T & U", None), (1, "text", "one", None), (2, "image", "sha256:00", "cap"), (3, "text", "two", None),
        (4, "image", "b.png", "alt"), (5, "text", "three", None),
    ]
    pages = spark.createDataFrame([(1, page), (2, None), (3, "<p")], "page_id long, html string")
    assert {r.page_id: len(r.elements) for r in media.interleaved(pages).collect()}[1] == 6
    assert media.interleaved(spark.read.parquet(f"{SF}/pages.parquet")).where("size(elements) > 0").count() == 50
    refs = spark.createDataFrame([(1, "sha256:" + "0" * 64)], "id long, ref string")
    store = media.media_features(spark.createDataFrame([], "digest string, media binary"))
    assert media.resolve(refs, store).first().feature is None


# simhash


def test_fingerprint():
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("A b C d") == simhash.fingerprint("a  B\nc D")
    assert simhash.fingerprint("one") == 0x0 ^ simhash.xxhash.xxh64_intdigest(b"one", 42)


@pytest.mark.parametrize("dense", [32, 2])
def test_simhash_brute_force(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    data = texts(spark)
    words = data[5][1].split()
    for i in range(120):
        own = list(words)
        own[i % len(own)] = f"zz{i}"
        data.append((10_000 + i, " ".join(own)))
    data += [(20_000, None), (20_001, ""), (20_002, "one two")]
    out = got(simhash.op6(spark.createDataFrame(data, DOC)))
    assert out == sorted(simhash.brute_force(data), key=str)
    assert {i: fp for i, fp, _ in out} == {i: f"{plain_fingerprint(t):016x}" for i, t in data}


def plain_fingerprint(text):
    """The contract's fingerprint, written apart: bit by bit."""
    import re

    import xxhash

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", lower)
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("m", [5, 7, 9, 15])
def test_pigeonring_is_complete(spark, m):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(40)]
    near = {b ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for b in base}
    all_ = sorted({*base, *near})
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in all_]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), m)
    ours = {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in edges.collect()}
    want = {frozenset((x, y)) for x in all_ for y in all_ if x < y and (x ^ y).bit_count() <= 2}
    assert ours == want


def test_simhash_edges(spark):
    out = simhash.grouped(clashing(spark).drop("_key"))
    assert {r._component for r in out.collect()} == {5, 8}  # the null text and the empty one: fingerprint zero
    assert simhash.op6(clashing(spark).limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(350)] + [(1000, 1000 + i) for i in range(1, 200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    want = {x: find(x) for a, b in pairs if a != b for x in (a, b)}
    found = common.components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == want


# URLs


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]


def url_rule(host, path):
    best = (None, None)
    for kind, h, p in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and len(h + p) > len(best[0] or ""):
            best = (h + p, kind)
    return best


def test_url_rules(spark):
    odd = [
        None, "", "x", "http://", "https://Example.ORG/es/1?q=/de/", "a://b://c/d", "http://example.org", "http://xexample.org/es/",
        "http://a.example.org/en/12#x", "http://org/", "http://a.com?x/fr/", "http://a.com/fr/?", "HTTP://A.COM/de/x", "//a.com/de/",
    ]
    pages = [(i, u, "x", "x") for i, u in enumerate(odd)]
    pages += [(100 + r.page_id, r.url, "x", "x") for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    df = spark.createDataFrame(pages, "page_id long, url string, host string, verdict string")
    out = url_filter.judged(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    want = sorted(((i, *(h := url_parts(u)), (r := url_rule(*h))[0], r[1] or "allow") for i, u, *_ in pages), key=str)
    assert got(out) == want


def test_url_mining_brute_force(spark):
    """Rules by counting all token sets, and the verdicts that follow."""
    from itertools import combinations

    rnd = random.Random(4)
    urls = [f"http://{rnd.choice('ab')}.{rnd.choice(['x', 'y'])}.net/{rnd.choice(['p', 'q'])}/{rnd.randrange(9)}" for _ in range(300)]
    bad = [int("y.net/q" in u or rnd.random() < 0.1) for u in urls]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, b) for i, b in enumerate(bad) if i % 2], "doc_id long, quality int, toxic int")
    own = url_filter.with_parts(pages)
    sets = {r.page_id: frozenset(r.t) for r in own.select("page_id", url_filter.tokens().alias("t")).collect()}
    baskets = [(sets[i], bad[i]) for i in range(300) if i % 2]
    rules = set()
    for found in {frozenset(c) for t, _ in baskets for n in range(1, len(t) + 1) for c in combinations(sorted(t), n)}:
        n, hit = sum(found <= t for t, _ in baskets), sum(found <= t and b for t, b in baskets)
        if hit / len(baskets) >= url_filter.SUPPORT and hit / n >= url_filter.CONFIDENCE:
            rules.add(found)
    assert {frozenset(r.antecedent) for r in url_filter.mine(own, labels).collect()} == rules
    out = {r.page_id: r.verdict for r in url_filter.judged(pages, labels).collect()}
    assert out == {i: "block" if any(r <= t for r in rules) else "allow" for i, t in sets.items()}


# suffixes


def passages(n=700):
    rnd = random.Random(3)

    def word(k):
        return "".join(rnd.choice("abcdé ") for _ in range(k))

    shared = [word(150) for _ in range(6)] + [word(k) for k in (99, 100, 101)]
    data = []
    for i in range(n):
        x = rnd.random()
        if x < 0.3 and data:
            text = rnd.choice(data)[1]
        elif x < 0.6:
            text = word(rnd.randint(0, 60)) + rnd.choice(shared) + word(rnd.randint(0, 60)) + rnd.choice(shared)
        elif x < 0.7:
            text = rnd.choice(["a", "ab", "abc"]) * rnd.randint(0, 200)
        else:
            text = word(rnd.randint(0, 300)) if x < 0.97 else None
        data.append((i * 7 % 701, text))
    return data


@pytest.mark.parametrize("group, few", [(2048, 256), (3, 1 << 30), (3, 2), (2, 20)])
def test_substrings_brute_force(spark, monkeypatch, group, few):
    """Groups of any size and any choice of common grams give the same result."""
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "FEW", few)
    data = passages()
    assert got(suffix_dedup.op8(spark.createDataFrame(data, DOC).repartition(5))) == sorted(suffix_dedup.brute_force(data), key=str)


def test_substrings_thue_morse(spark):
    """Texts whose polynomial hashes modulo 2^64 collide: the string of two letters and its complement."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    data = [(1, word), (2, other), (3, "c" + word[:1024] + "d" + other[:1024]), (4, word[512:640] + other[700:900] + "e" * 150)]
    assert got(suffix_dedup.op8(spark.createDataFrame(data, DOC))) == sorted(suffix_dedup.brute_force(data), key=str)


def test_substrings_long_text_in_parts(monkeypatch):
    """A text longer than a buffer is scanned in overlapping parts: same runs of windows, each window once."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 12)
    import pyarrow as pa

    rnd = random.Random(9)
    text = "".join(rnd.choice("abcdefgh") for _ in range(20_000))
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([text])], names=["_key", "text"])
    runs = [r for b in suffix_dedup._Scan(100, 32)([batch]) for r in b.to_pylist() if r["kind"] == 0]
    windows = sorted(p for r in runs for p in range(r["pos"], r["pos"] + r["n"]))
    assert windows == list(range(20_000 - 99))


def test_substrings_collisions(monkeypatch):
    """Where all polynomial hashes are equal the bytes decide."""
    import pyarrow as pa

    compare = suffix_dedup._Compare(100)
    a, b, c = b"x" * 40 + b"q" * 80, b"x" * 40 + b"q" * 60 + b"z" * 20, b"y" * 19 + b"x" + b"q" * 80
    rows = suffix_dedup._Fetch.batch([(5, k, 0, n, 20, v) for k, n, v in ((1, 21, a), (2, 21, b), (3, 1, c), (4, 21, a))])
    right = pa.Table.from_batches(compare([rows])).to_pylist()
    monkeypatch.setattr(suffix_dedup.rolling(1), "of", lambda prefix, start, end: np.zeros(len(start), np.uint64))
    wrong = pa.Table.from_batches(compare([rows])).to_pylist()

    def bytes_of(spans):
        return {(r["key"], p) for r in spans for p in range(r["pos"], r["pos"] + r["n"])}

    assert bytes_of(right) == bytes_of(wrong) == {(2, p) for p in range(100)} | {(4, p) for p in range(120)}


def test_substrings_edges(spark):
    long = "".join(chr(200 + i) for i in range(120))
    data = [(1, long + "ß"), (2, "x" + long), (2, "y" + long), (None, None), (3, None), (4, "")]
    df = spark.createDataFrame([(*r, "c", 1) for r in data], DOC + ", spans string, n_chars long")
    out = suffix_dedup.dedup_substrings(df)
    assert out.columns == df.columns
    want = [(1, long + "ß", 121), (2, "x", 1), (2, "y", 1), (None, None, None), (3, None, None), (4, "", 0)]
    assert got(out.select("doc_id", "text", "n_chars")) == sorted(want, key=str)
    assert suffix_dedup.op8(df.limit(0)).count() == 0


# embeddings


def test_embeddings_brute_force(spark):
    rnd = np.random.default_rng(6)
    data = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(rnd.normal(size=(150, 16)))]
    for i in range(100):
        v = np.array(data[i % 20][1]) + rnd.normal(size=16) * 0.03 * (1 + i % 4)
        data.append((1000 + i, v.tolist(), data[i % 20][2]))
    v = data[3][1]
    data += [
        (2000, None, 1), (2001, [0.0] * 16, 1), (2002, [1.0, None] * 8, 1), (2003, [float("nan")] * 16, 1), (2004, v, None),
        (2005, [-2 * x for x in v], data[3][2]), (2006, [2 * x for x in v], data[3][2]), (2007, v, data[3][2]), (2008, v, data[3][2]),
        (2009, [1.0, 2.0], 1), (2010, [1.0, 2.0], 1), (2011, [], 1), (2012, [1e300] * 16, 1), (2013, [1e-300] * 16, 1),
    ]
    df = spark.createDataFrame([(*r, "x") for r in data], "vec_id long, embedding array<double>, label int, cid string")
    want = [r for r in embedding_dedup.brute_force([r for r in data if r[0] not in (2012, 2013)])]
    for tile in (1024, 16):
        out = [r for r in got(embedding_dedup.near_duplicates(df, tile=tile)) if r[0] not in (2012, 2013)]
        assert sorted(out) == want
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_recall(spark):
    rnd = np.random.default_rng(7)
    x = rnd.normal(size=(1500, 64))
    y = x[:1500] + rnd.normal(size=(1500, 64)) * np.linalg.norm(x, axis=1, keepdims=True) / 8 * 0.2  # cosines about 0.98
    all_ = np.concatenate([x, y]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(all_)], "vec_id long, embedding array<float>, label int")
    unit = all_.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    found = embedding_dedup.near_duplicates(df).agg(F.sum("n_links")).first()[0]
    assert 0.95 * near.sum() <= found <= near.sum() and near.sum() > 500


# pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = documents(spark)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "simhash near-dedup", "suffix-array dedup", "packing",
    ]
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = [(r.doc_id, r.text) for r in quality.scored(docs, model).where("_score >= 0.3").collect()]
    seen, lines = set(), []
    for i, text in sorted(want):
        own = text.split("\n")
        at = [k for k, x in enumerate(own) if x.strip(" \t\x0b\x0c\r")]
        gone = set()
        for s in range(len(at) - 1):
            pair = (own[at[s]], own[at[s + 1]])
            if pair in seen:
                gone |= {at[s], at[s + 1]}
            seen.add(pair)
        for k in at:
            if own[k] in seen and len(own[k].split()) >= 50:
                gone.add(k)
            seen.add(own[k])
        lines.append((i, "\n".join(x for k, x in enumerate(own) if k not in gone)))
    roots = set(near_dedup.brute_force(lines))
    seen, kept = set(), {}
    for i, text in sorted(r for r in lines if r[0] in roots):
        raw = text.encode()
        mask = bytearray(len(raw))
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                mask[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept[i] = bytes(b for b, m in zip(raw, mask) if not m).decode("utf-8", "ignore")
    encode = packing.Ranked(VOCABULARY).encode
    sizes = {i: len(encode(t)) // 2 + 1 for i, t in kept.items()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.doc_tokens for r in out} == sizes
    assert sum(r.length for r in out) == sum(sizes.values())


def test_pipeline_edges(spark, tmp_path):
    """Nulls in all columns, repeated rows, clashing names and an empty table go through all stages."""
    import corpus_pipeline

    extra = [(9, i, None, None, f"w{i} " * 20 + "\n" + "same words in this line\nand in that one too", "r", 1, 3, "s", 1) for i in (40, 41, 41)]
    docs = clashing(spark).union(spark.createDataFrame(extra, clashing(spark).schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    own = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, own, str(tmp_path))
        assert out.columns == own.columns, name
        assert stage(spark, own.limit(0), str(tmp_path)).count() == 0, name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} >= {5, 40, 41} and all(r.doc_tokens >= 1 for r in out)
    assert corpus_pipeline.pack(spark, own.limit(0), str(tmp_path)).count() == 0
