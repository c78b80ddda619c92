"""Multiple-instance learning against a plain version of its formulas, and its edge cases."""

import math
import zlib

import numpy as np

from oracle import SMALL
from termloom.llm import toxicity

COLUMNS = "doc_id long, text string, sha string, _id long, n int, toxic string, place long"
TEXTS = ["You are fine. You are a dolt! Good day.", "A calm day. A calm night.", "Such a dolt.\nSuch a calm day", "", "dolt dolt dolt. day"]
LABELS = [1, 0, 1, 0, 1]


def features(sentence):
    words = toxicity.WORD.findall(sentence.lower())
    return {f for w in words for f in [w] + [f"^{w[:n]}" for n in (4, 5) if len(w) > n]}


def bag(text):
    return [f for s in toxicity.SENTENCE.findall(text) if (f := features(s))]


def chance(text, weights, bias):
    none = 1.0
    for f in bag(text):
        none *= 1 - 1 / (1 + math.exp(-(bias + sum(weights.get(x, 0.0) for x in f))))
    return 1 - none


def loss(weights, bias):
    return -sum(math.log(p if y else 1 - p) for t, y in zip(TEXTS, LABELS, strict=True) for p in [chance(t, weights, bias)]) / len(TEXTS)


def test_score_is_the_noisy_or_of_the_sentences(spark):
    model = toxicity.Model(-2.0, {"dolt": 3.0, "^calm": -1.0, "day": 0.5, "^such": 0.25})
    rows = spark.createDataFrame([(i, t, "s", 1, 2, "x", 9) for i, t in enumerate(TEXTS)], COLUMNS)
    found = {r.doc_id: r.score for r in toxicity.score(rows, model).collect()}
    for i, text in enumerate(TEXTS):
        assert abs(found[i] - chance(text, model.weights, model.bias)) < 1e-12
    located = {r.doc_id: r.offending for r in toxicity.score(rows, model, locate=True).collect()}
    assert [TEXTS[0][s.start : s.end] for s in located[0]] == [" You are a dolt"] and located[1] == []


def test_gradient_is_that_of_the_loss(monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_DOCUMENTS", 1)
    for step in (1, 1 << 20):
        monkeypatch.setattr(toxicity._Sums, "STEP", step)
        bags = toxicity.Bags()
        for text, label in zip(TEXTS, LABELS, strict=True):
            bags.add(text, label)
        data = bags.matrix()
        weights = np.linspace(-1, 1, len(data.names))
        g, gb = data.gradient(weights, -1.0)
        named = dict(zip(data.names, weights, strict=True))
        assert set(data.names) == {f for t in TEXTS for s in bag(t) for f in s}
        for i, name in enumerate(data.names):
            up, down = (loss(named | {name: named[name] + e}, -1.0) for e in (1e-6, -1e-6))
            assert abs((up - down) / 2e-6 - g[i]) < 1e-6, name
        assert abs((loss(named, -1 + 1e-6) - loss(named, -1 - 1e-6)) / 2e-6 - gb) < 1e-6


def test_sample_passes_over_a_giant_text(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = [(i, f"text of {i}", "s", 1, 2, "x", 9) for i in range(60)] * 2
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(60)] + [(None, 1, 1), (3, None, 0)], "doc_id long, toxic int, quality int")
    for giant in ids[:3]:
        rows = [(d, "x " * 50_000 if d == giant else t, *more) for d, t, *more in docs] + [(None, "no id", "s", 1, 2, "x", 9)]
        found = toxicity.sample(spark.createDataFrame(rows, COLUMNS), labels, 1000, 2000).collect()
        assert sorted(r.text for r in found) == sorted(f"text of {i}" for i in ids if i != giant)
    few = toxicity.sample(spark.createDataFrame(docs, COLUMNS), labels, 5, 2000).collect()
    assert len(few) == 5


def test_empty_and_clashing(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    empty = spark.createDataFrame([], COLUMNS)
    model = toxicity.train(empty, labels)
    assert toxicity.score(empty, model).count() == 0 and toxicity.keep_clean(empty, model).columns == empty.columns
    rows = spark.createDataFrame([(1, None, "a", 1, 1, "t", 1), (None, "word " * 200_000, "b", 2, 2, "u", 2), (1, None, "a", 1, 1, "t", 1)], COLUMNS)
    kept = toxicity.keep_clean(rows, toxicity.Model(-9.0, {"word": 12.0}))
    assert sorted(map(tuple, kept.select("doc_id", "sha", "place").collect())) == [(1, "a", 1), (1, "a", 1)]
