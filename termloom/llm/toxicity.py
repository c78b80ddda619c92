"""Operator 10: toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score on its
words and their openings (the first four and five letters, for inflected and
run-together insults); the document's score is their noisy-or, ``1 - prod(1 - p)``. Only
documents are labelled; the gradient of the document's loss teaches the
sentence weights, so the model can then point at the sentences that offend.

The model is fitted on a sample of the labelled training rows in hash order:
at most ``SAMPLE_ROWS`` rows and ``SAMPLE_CHARS`` characters in all (the
documented bound of what reaches the driver); a text that the rest of the
characters can't hold is passed over for the ones after it. Rows are chosen by
their keys and lengths, then read one at a time: the driver keeps the numbers
of their features, never the texts. Scoring reads every row and every whole
text. Labels, lang, source and doc_id are no inputs of a score.

Defined cases: a null or empty text, or one without words, scores 0; a text of
any length is scored whole; with no training rows or only one class, the model
is the base rate alone; a null doc_id is never learned from and is scored as
any other; rows that repeat a doc_id and its text are learned from once; of a
doc_id with several labels the larger counts; equal texts score equal; an
empty table gives an empty result; other columns are ignored, whatever their
names, and ``keep_clean`` passes them through.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import tee

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.store import materialise

SAMPLE_ROWS = 6_000
SAMPLE_CHARS = 24_000_000
THRESHOLD = 0.7
#: A feature must be in so many training documents to get a weight.
LEAST_DOCUMENTS = 4
STEPS = 160
#: L1 penalty on the weights, against the mean loss of a document.
PENALTY = 1e-4
#: Words whose weight a task remembers; the table is cleared beyond.
TABLE = 300_000
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _sentences(text: str) -> list[list[str]]:
    return [w for s in SENTENCE.findall(text.lower()) if (w := WORD.findall(s))]


def _features(word: str) -> list[str]:
    return [word, *(f"^{word[:n]}" for n in (4, 5) if len(word) > n)]


@dataclass
class Model:
    """Sentence logit = bias + sum of the weights of its distinct features."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.table: dict[str, tuple[str, ...]] = {}

    def __getstate__(self) -> dict:
        return {"bias": self.bias, "weights": self.weights, "table": {}}

    def _known(self, word: str) -> tuple[str, ...]:
        found = self.table.get(word)
        if found is None:
            if len(self.table) >= TABLE:
                self.table.clear()
            found = self.table[word] = tuple(f for f in _features(word) if f in self.weights)
        return found

    def logit(self, words: list[str]) -> float:
        get, own = self.table.get, self._known
        found = [f for w in words if (f := get(w)) or (f is None and (f := own(w)))]
        if not found:
            return self.bias
        return self.bias + sum(self.weights[f] for f in sorted({f for fs in found for f in fs}))

    def score(self, text: str) -> float:
        off = sum(-math.log1p(math.exp(max(-40.0, min(40.0, self.logit(words))))) for words in _sentences(text))
        return -math.expm1(off)

    def offending(self, text: str, at_least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, score) of the sentences that score at least so much."""
        found = []
        for m in SENTENCE.finditer(text):
            if words := WORD.findall(m.group().lower()):
                p = 1 / (1 + math.exp(-max(-40.0, min(40.0, self.logit(words)))))
                if p >= at_least:
                    found.append((m.start(), m.end(), p))
        return found


class Bags:
    """The sentences of labelled texts as arrays of feature numbers, taken in one text at a time.

    Of a text only the numbers of its sentences' features stay (four bytes
    each), and the feature table has each feature once.
    """

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.documents = array("i")  # of each feature: in how many texts it is
        self.features, self.sizes, self.sentences, self.labels = array("i"), array("i"), array("i"), array("b")

    def add(self, text: str, label: int) -> None:
        numbers, seen, count = self.numbers, set(), 0
        for words in _sentences(text):
            ids = {numbers.setdefault(f, len(numbers)) for w in set(words) for f in _features(w)}
            self.features.extend(sorted(ids))
            self.sizes.append(len(ids))
            seen |= ids
            count += 1
        self.documents.extend([0] * (len(numbers) - len(self.documents)))
        for i in seen:
            self.documents[i] += 1
        self.sentences.append(count)
        self.labels.append(int(label))

    def matrix(self) -> Matrix:
        """What is learned from: the features of ``LEAST_DOCUMENTS`` texts or more, in their own order. Empties the bags."""
        kept = sorted(f for f, i in self.numbers.items() if self.documents[i] >= LEAST_DOCUMENTS)
        column = np.full(len(self.numbers), -1, dtype=np.int32)
        column[[self.numbers[f] for f in kept]] = np.arange(len(kept), dtype=np.int32)
        self.numbers = {}
        feature = column[np.frombuffer(self.features, dtype=np.int32)]
        self.features = array("i")
        known = feature >= 0
        sentence = np.repeat(np.arange(len(self.sizes), dtype=np.int32), np.frombuffer(self.sizes, dtype=np.int32))[known]
        document = np.repeat(np.arange(len(self.labels), dtype=np.int32), np.frombuffer(self.sentences, dtype=np.int32))
        return Matrix(kept, sentence, feature[known], document, np.frombuffer(self.labels, dtype=np.int8).astype(np.float64))


class Matrix:
    """Sentences by features, in both orders, and the bag and label of each sentence's document."""

    def __init__(self, names: list[str], sentence: np.ndarray, feature: np.ndarray, document: np.ndarray, labels: np.ndarray) -> None:
        self.names, self.document, self.labels = names, document, labels
        self.rows = _Sums(sentence, feature, len(document))
        by_feature = np.argsort(feature, kind="stable").astype(np.int32)
        self.columns = _Sums(feature[by_feature], sentence[by_feature], len(names))

    def gradient(self, weights: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        """Of the mean log loss of the documents' noisy-or, by weights and bias."""
        z = np.clip(bias + self.rows.of(weights), -40, 40)
        off = np.bincount(self.document, -np.logaddexp(0, z), len(self.labels))  # log of the chance that no sentence is toxic
        none = np.exp(np.minimum(off, -1e-9))
        pull = np.where(self.labels > 0, -none / (1 - none), 1.0)[self.document] / (1 + np.exp(-z))
        return self.columns.of(pull) / len(self.labels), pull.sum() / len(self.labels)


class _Sums:
    """Sums of a vector's values over sorted groups, some entries at a time."""

    STEP = 1 << 20

    def __init__(self, group: np.ndarray, index: np.ndarray, groups: int) -> None:
        self.index, self.groups = index, groups
        sizes = np.bincount(group, minlength=groups)
        self.present = np.flatnonzero(sizes)
        self.starts = np.concatenate([[0], np.cumsum(sizes[self.present])[:-1]]).astype(np.int64)

    def of(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.groups)
        at, n = 0, len(self.starts)
        while at < n:  # as many whole groups as fit, one at least
            last = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + self.STEP)))
            end = self.starts[last] if last < n else len(self.index)
            out[self.present[at:last]] = np.add.reduceat(values[self.index[self.starts[at] : end]], self.starts[at:last] - self.starts[at])
            at = last
        return out


def learn(bags: Bags, steps: int = STEPS) -> Model:
    """Full-batch Adam on the noisy-or loss; deterministic."""
    rate = sum(bags.labels) / len(bags.labels) if bags.labels else 0.0
    if not 0 < rate < 1:
        return Model(bias=-12.0 if not rate else 0.0)
    data = bags.matrix()
    w, b = np.zeros(len(data.names)), -6.0
    m, v, mb, vb = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
    for t in range(1, steps + 1):
        g, gb = data.gradient(w, b)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        pace = 0.1 / (np.sqrt(v / c2) + 1e-8)
        w -= pace * m / c1
        w = np.sign(w) * np.maximum(np.abs(w) - pace * PENALTY, 0)  # most features end at no weight
        b -= 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return Model(float(b), {data.names[i]: float(w[i]) for i in np.flatnonzero(w)})


def fit(texts: Iterable[str], labels: Iterable[int], steps: int = STEPS) -> Model:
    """The model of texts and their labels; the texts are read once and not kept."""
    bags = Bags()
    for text, label in zip(texts, labels, strict=True):
        bags.add(text, label)
    return learn(bags, steps)


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(text, toxic): the bounded sample, chosen by keys and lengths before any text moves."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("toxic"))
    first = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)  # at most ``rows`` rows, so it may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(first), "_id")
    texts = materialise(texts.withColumns({"sha": F.sha2("text", 256), "n": F.length("text")}), "labelled")
    keys = texts.select("_id", "sha", "n").distinct().orderBy(F.xxhash64("_id"), "_id", "sha").limit(rows).collect()  # at most ``rows`` short rows
    chosen = []
    for r in keys:
        if r.n <= chars:
            chars -= r.n
            chosen.append((r._id, r.sha, len(chosen)))
    picked = docs.sparkSession.createDataFrame(chosen, "_id long, sha string, place int")
    once = texts.join(F.broadcast(picked), ["_id", "sha"]).groupBy("place").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))
    return once.orderBy("place").select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """Fit on a bounded sample of the rows that are labelled and not held out."""
    texts, toxic = tee(sample(docs, labels, rows, chars).toLocalIterator())  # a partition at a time
    return fit((r.text for r in texts), (r.toxic for r in toxic))


def score(docs: DataFrame, model: Model, locate: bool = False) -> DataFrame:
    """doc_id, score (and the offending sentences as spans of the text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    schema = "doc_id long, score double" + ", offending array<struct<start: int, end: int, score: double>>" * locate

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            out = [batch.column(0), pa.array([m.score(t) for t in texts], pa.float64())]
            if locate:
                out.append(pa.array([[dict(zip(("start", "end", "score"), s, strict=True)) for s in m.offending(t)] for t in texts], spans))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "score", "offending"][: len(out)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = pa.array([shared.value.score(t.as_py() or "") < threshold for t in batch.column(at)], pa.bool_())
            yield batch.filter(clean)

    return docs.mapInArrow(run, docs.schema)
