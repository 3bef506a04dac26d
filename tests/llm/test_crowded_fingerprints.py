"""Links of crowded keys: by lengthened keys and by stars, against all pairs."""

from __future__ import annotations

import random

import pytest

from tidemark.llm import simhash
from tidemark.llm.common import components


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("m,dense", [(5, 2), (5, 8), (9, 2), (15, 3)])
def test_crowds_are_connected_as_all_pairs_are(spark, monkeypatch, m, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rnd = random.Random(m * dense)
    fps = set()
    for _ in range(3):
        base = rnd.getrandbits(64)
        fps |= {base}
        for _ in range(60):  # near the base, and near what is near
            fps.add(rnd.choice(sorted(fps)) ^ (1 << rnd.randrange(64)) ^ (rnd.random() < 0.5) * (1 << rnd.randrange(64)))
        fps |= {base ^ x for x in range(40)}  # one long key
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    found = simhash._links(df, m).collect()
    assert {r.by for r in found} == {"chain", "long", "star"} or {r.by for r in found} == {"long", "star"}
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= 2 and r.a < r.b for r in found)
    roots = {r.node: r.root for r in components(simhash.links(df, m)).collect()}
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[i + 1 :]:
            if (x ^ y).bit_count() <= 2:
                root[find(x)] = find(y)
    groups = lambda of: {frozenset(x for x in fps if of(x) == r) for r in {of(x) for x in fps}}
    assert groups(find) == groups(lambda x: roots.get(signed(x), signed(x)))


def test_few_rows_for_a_crowd(spark):
    """A large crowd of one text's copies is linked by about as many rows as it has, times the flips."""
    rnd = random.Random(4)
    base = rnd.getrandbits(64)
    fps = {base ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(600)}
    found = simhash._links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"))
    assert found.count() < 600 * 64 * 2


def test_columns_of_the_results_names(spark):
    from pyspark.sql import functions as F

    from tests.llm.test_llm_operators import clashing
    from tidemark.llm import quality

    docs = clashing(spark).withColumns({"_fp": F.lit("x"), "_component": F.lit(1)})
    out = simhash.grouped(docs)
    assert sorted(out.columns) == sorted(c for c in docs.columns if c != "text") and dict(out.dtypes)["_fp"] == "bigint"
    assert quality.scored(clashing(spark), quality.Model.__new__(quality.Model)).columns.count("_score") == 1
