"""Importance resampling, vector codes and sharding against versions of their own, with their edge cases."""

from __future__ import annotations

import math
import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest

from tests.llm.test_llm_operators import SF, clashing, got
from tidemark.llm import resampling, sharding, vector_codes

DOC, VECTORS = "doc_id long, text string", "vec_id long, embedding array<float>, label int"


# importance resampling


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def crcs_of(text):
    w = words_of(text)
    return [zlib.crc32(x.encode()) for x in w], [zlib.crc32(f"{a} {b}".encode()) for a, b in zip(w, w[1:])]


@pytest.mark.parametrize("limit", [1 << 21, 50, 7])
def test_features_of_any_bytes_and_lengths(monkeypatch, limit):
    monkeypatch.setattr(resampling, "LIMIT", limit)
    rnd = random.Random(1)
    texts = ["", "   ", "a", "é" * 70 + " b " + "c" * 200 + " d", "x" * 64 + " " + "y" * 65 + " " + "z" * 63, "w" * 1000]
    texts += ["".join(rnd.choice("abzAZ09 ,.\n\0éß漢🙂-") for _ in range(rnd.randint(0, 300))) for _ in range(300)]
    found = [([], []) for _ in texts]
    for rows, words, left, pairs in resampling.features([t.encode() for t in texts]):
        for r, x in zip(rows, words):
            found[r][0].append(int(x))
        for r, x in zip(left, pairs):
            found[r][1].append(int(x))
    assert found == [crcs_of(t) for t in texts]


def resampled(docs, target, percent=25, least=20):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) pairs, plainly."""
    def buckets(text):
        return [c % 10_000 for part in crcs_of(text) for c in part]

    raw, aim = np.zeros(10_000, int), np.zeros(10_000, int)
    for _, t in docs:
        np.add.at(raw, buckets(t), 1)
    for t in target:
        np.add.at(aim, buckets(t), 1)
    gain = [math.floor(1000 * math.log((t + 1) * (raw.sum() + 10_000) / ((s + 1) * (aim.sum() + 10_000)))) for s, t in zip(raw.tolist(), aim.tolist())]
    out = []
    for i, t in docs:
        own = [gain[b] for b in buckets(t)]
        weight = sum(own) // len(own) if own else 0
        h = int(sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words_of(t))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = place
    return [tuple(r[:5]) for r in out]


def test_resampling_of_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(resampling.op11(docs, target)) == sorted(resampled(rows, [r.text for r in target.collect()]), key=str)


def test_resampling_odd_inputs(spark):
    rnd = random.Random(3)
    long = " ".join(rnd.choice("abcdef") * rnd.randint(1, 9) for _ in range(400_000))
    rows = [(1, long), (2, None), (3, ""), (None, "a b " * 15), (None, None), (4, "a b " * 15), (4, "a b " * 15), (5, "one two"), (6, "é" * 500)]
    docs, target = spark.createDataFrame(rows, DOC), spark.createDataFrame([(1, "a b"), (2, None)], "item_id long, text string")
    assert got(resampling.op11(docs, target)) == sorted(resampled(rows, ["a b", None]), key=str)
    none = docs.where("false")
    assert resampling.op11(none, target).count() == 0
    assert got(resampling.op11(docs, target.where("false"))) == sorted(resampled(rows, []), key=str)


def test_resampling_keeps_columns(spark):
    docs = clashing(spark)
    aim = spark.createDataFrame([("one two",)], "text string")
    out = resampling.resample(docs, aim, percent=100, least=1)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [5, 7, 7]
    assert resampling.resample(docs, aim, percent=50, least=1).count() == 1


def test_target_like_documents_are_preferred(spark):
    rows = [(i, ("alpha beta gamma " if i % 10 == 0 else "delta epsilon zeta ") * 10) for i in range(1000)]
    aim = spark.createDataFrame([("alpha beta gamma " * 50,)], "text string")
    drawn = [r.doc_id for r in resampling.op11(spark.createDataFrame(rows, DOC), aim).where("rank is not null").collect()]
    assert len(drawn) == 250 and sum(i % 10 == 0 for i in drawn) == 100


# vector codes


def lloyd(vectors, parts=16, entries=64, rounds=2):
    """{row: (vec_id, code, error, label)} and the codebooks, by plain rounds over Python integers; components of 2**27 and more are cut."""
    top = vector_codes.largest(max((len(v) for _, v, _ in vectors if v), default=1))
    good = [(i, v, label) for i, v, label in vectors if v and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(good[0][1]) if good else 0
    width = -(-dim // parts)
    rows = []
    for i, v, label in (r for r in good if len(r[1]) == dim):
        x = [max(-top, min(top, math.floor(256 * float(np.float32(c))))) for c in v] + [0] * (parts * width - dim)
        rows.append((i, [x[p * width : p * width + width] for p in range(parts)], label))
    books = [[list(x[p]) for _, x, _ in rows[:entries]] for p in range(parts)]

    def assigned():
        return [
            [min((sum((a - b) ** 2 for a, b in zip(x[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for _, x, _ in rows
        ]

    for _ in range(rounds):
        own = assigned()
        for p in range(parts):
            for k in range(len(books[p])):
                members = [x[p] for (_, x, _), a in zip(rows, own) if a[p][1] == k]
                if members:
                    books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    out = [(i, "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a), label) for (i, _, label), a in zip(rows, assigned())]
    digest = sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    sums = {}
    for *_, error, label in out:
        sums[label] = sums.get(label, 0) + error
    return [(i, code, error, min(sums[label], 2**63 - 1), digest) for i, code, error, label in out], books


def test_codes_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want, _ = lloyd([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    assert got(vector_codes.op12(df)) == sorted(want, key=str)


@pytest.mark.parametrize("seed,spread,dim", [(1, 1, 16), (2, 0.02, 32), (3, 40, 40), (4, 2000, 64)])
def test_codes_with_ties_and_other_widths(spark, seed, spread, dim):
    rnd = np.random.default_rng(seed)
    rows = [(i, (np.round(rnd.normal(0, spread, dim) * 64) / 64).tolist(), int(i % 3) or None) for i in range(400)]
    rows += [(1000 + i, v, label) for i, (_, v, label) in enumerate(rows[:50])]
    want, _ = lloyd(rows)
    assert got(vector_codes.op12(spark.createDataFrame(rows, VECTORS).repartition(5))) == sorted(want, key=str)


def test_codes_odd_inputs(spark):
    one = [0.5] * 16
    rows = [
        (5, one, 1), (3, [0.25] * 16, None), (None, one, None), (7, None, 1), (8, [], 1), (9, [float("nan")] * 16, 1), (10, [float("inf")] * 16, 1),
        (11, [None] * 16, 1), (12, [0.5] * 15, 1), (13, [3e38] * 16, 2), (14, [-3e38] * 16, 2), (5, one, 1), (15, [-0.0] * 16, None),
    ]
    df = spark.createDataFrame(rows, VECTORS)
    want, _ = lloyd(rows)
    assert got(vector_codes.op12(df)) == sorted(want, key=str)
    more = df.selectExpr("*", "1 as code", "2 as error", "3 as _label", "4 as ints")
    assert got(vector_codes.op12(more)) == sorted(want, key=str)
    assert vector_codes.op12(df.where("false")).count() == 0
    assert vector_codes.op12(df.where("vec_id = 7")).count() == 0


def test_fewer_distances_than_lloyd(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    made = vector_codes.compress(df)
    whole = df.count() * 16 * 64
    assert made.scanned[0] == whole and made.scanned[1] < whole / 2


def test_codes_restore_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    made = vector_codes.compress(df)
    back = vector_codes.restored(made.codes, made.books).join(df.select("vec_id", df.embedding.alias("true")), "vec_id").toPandas()
    off = np.stack(back.embedding) - np.stack(back.true)
    bound = np.sqrt(back.error) / 256 + np.sqrt(64) / 256
    assert (np.sqrt((off**2).sum(1)) <= bound).all()
    # nearer than the smallest ids' own parts, with which the codebooks begin
    assert back.error.sum() < vector_codes.compress(df, rounds=0).codes.agg({"error": "sum"}).first()[0]


# sharding


def test_shards_hold_the_law(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = sharding.op13(df).toPandas()
    texts = {r.doc_id: (r.text or "").encode() for r in df.collect()}
    assert len(out) == len(texts) and set(out.doc_id) == set(texts)
    assert all(s == len(texts[i]) + 1 and c == zlib.crc32(texts[i]) for i, s, c in zip(out.doc_id, out["size"], out.text_crc32))
    sizes = out.groupby("shard")["size"].sum()
    assert set(sizes.index) == set(range(16)) and sizes.max() - sizes.min() < 0.01 * sizes.mean()
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert set(out.law) == {"bytes"} and out.grown_shard.isna().all()


def test_shards_odd_inputs(spark):
    rows = [(1, None), (1, None), (None, "a"), (None, None), (2, ""), (3, "é" * 100_000), (3, "x")]
    out = sharding.op13(spark.createDataFrame(rows, DOC)).toPandas()
    assert sorted(out["size"]) == [1, 1, 1, 1, 2, 2, 200_001]
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert sharding.op13(spark.createDataFrame([], DOC)).count() == 0
    assert sharding.op13(clashing(spark)).count() == 5


def weights(seed, slots=8192):
    rnd = random.Random(seed)
    return {s: int(rnd.paretovariate(2.5) * 1000) for s in range(slots) if rnd.random() < 0.9}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_growing_moves_rows_only_into_the_new_shard(seed):
    sizes = weights(seed)
    before = sharding.SlotMap.first(sizes)
    after = before.grown(sizes)
    assert (after.version, after.shards) == (2, 17)
    assert all(a == b or a == 16 for a, b in zip(after.owners, before.owners))
    loads = after.loads(sizes)
    assert max(loads) - min(loads) < 0.05 * sum(loads) / 17
    empty = [s for s in range(8192) if s not in sizes and after.owners[s] == 16]
    assert empty


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rebalancing_moves_few_slots(seed):
    sizes = weights(seed)
    before = sharding.SlotMap.first(sizes)
    assert before.rebalanced(sizes) is before
    for slot in [s for s in sizes if before.owners[s] == 3]:
        sizes[slot] *= 3  # one shard's records grow
    after = before.rebalanced(sizes)
    loads = after.loads(sizes)
    assert max(loads) < 1.03 * sum(loads) / 16 and min(loads) > 0.97 * sum(loads) / 16
    changed = [s for s in range(8192) if after.owners[s] != before.owners[s]]
    assert 0 < len(changed) < 8192 * 0.12 and {before.owners[s] for s in changed} == {3}


def test_versions_are_written_once(spark, tmp_path):
    path = str(tmp_path / "maps")
    sizes = weights(7, 64)
    first = sharding.SlotMap.first(sizes, 4, 64)
    first.save(spark, path)
    first.grown(sizes).save(spark, path)
    assert sharding.SlotMap.load(spark, path) == first.grown(sizes)
    assert sharding.SlotMap.load(spark, path, 1) == first
    with pytest.raises(Exception, match="(?i)exists"):
        first.save(spark, path)
    with pytest.raises(ValueError):
        sharding.SlotMap.load(spark, path, 9)


def test_written_shards_hold_whole_documents(spark, tmp_path):
    docs = clashing(spark)
    slot_map = sharding.SlotMap.first(sharding.weights(sharding.measured(docs)), 3)
    sharding.write(docs, slot_map, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert got(back.select(docs.columns)) == got(docs)
    want = {(r.doc_id, r.shard) for r in sharding.placed(sharding.measured(docs), slot_map).collect()}
    assert {(r.doc_id, r._shard) for r in back.collect()} == want
