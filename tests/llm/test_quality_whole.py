"""The classifier learns from every labelled text, and from all of it."""

from __future__ import annotations

import random

import numpy as np

from tidemark.llm import quality

PHRASE = " the same passage in the second block of every text, and in no other one of its blocks " * 3


def text(seed: int) -> str:
    rnd = random.Random(seed)
    noise = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=8 * quality.BLOCK))
    return noise[:2300] + PHRASE + noise[2300 + len(PHRASE) :]


def test_dictionaries_of_whole_texts_in_several_groups(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCKS", 150)
    docs = spark.createDataFrame([(i, text(i)) for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert PHRASE[:80].encode() in model.good and PHRASE[:80].encode() in model.bad


def test_curve_from_sums_of_parts():
    rnd = np.random.default_rng(1)
    x, y = np.c_[np.ones(400), rnd.normal(size=(400, 2))], rnd.integers(0, 2, 400)
    weight = np.where(y == 1, 2.0, 1.0)
    whole = quality._logistic(lambda w: quality._sums(x, y, weight, w), 3)
    parts = quality._logistic(lambda w: sum(quality._sums(x[i : i + 90], y[i : i + 90], weight[i : i + 90], w) for i in range(0, 400, 90)), 3)
    p = 1 / (1 + np.exp(-x @ whole))
    assert np.allclose(whole, parts) and np.allclose(x.T @ (weight * (p - y)) + 1e-2 * whole, 0, atol=1e-3)
