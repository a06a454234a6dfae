"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence's probability is a logistic function of its distinct words and of their beginnings
of ``BEGINNINGS`` characters; a document's is the noisy-or of its sentences, 1 - prod(1 - p).
The weights are learned from document labels alone, on a bounded sample (``PER_CLASS``
documents of each label), and the sentence probabilities then tell which sentences offend.
A screen keeps the ``VOCABULARY`` features that speak most clearly for the label. The log-odds
of a sentence without any of them are held at ``QUIET``, so that length alone makes no document toxic.

Sentences end at ``. ! ?`` and at line feeds; words are runs of letters and digits in lower case.

Defined results: a null, empty or wordless text has no sentence, scores 0 and has no worst
sentence (null); ties between sentences go to the first; without labelled rows of both
labels every score is 0; repeated rows are scored alike; very long texts are read whole; columns besides the id and the text play
no part; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, expm1, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, training_rows
from .staging import staged

PER_CLASS = 2_000
VOCABULARY, LEAST_DOCUMENTS, LEAST_DEVIATION = 4_000, 3, 4.0
EPOCHS, RATE, SHRINK, QUIET = 300, 0.5, 5e-4, -10.0
BEGINNINGS = (3, 4, 5, 6)
KEPT = 400_000

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W_]+")


def features(word: str) -> list[str]:
    """The word, and its beginnings marked by a hyphen."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)]


class _WordWeights(dict):
    """From words to the weights of their features; holds KEPT at most."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        weight = sum(self.weights.get(f, 0.0) for f in features(word))
        if len(self) < KEPT and len(word) < 40:
            self[word] = weight
        return weight


@dataclass(frozen=True)
class NoisyOr:
    bias: float
    weights: dict[str, float]

    def word_weights(self) -> dict[str, float]:
        return _WordWeights(self.weights)

    def sentences(self, text: str | None, word_weights: dict[str, float]) -> Iterator[tuple[int, int, float]]:
        """For each sentence with words its start, its end and its probability."""
        quiet = _logistic(self.bias)
        for m in SENTENCE.finditer(text or ""):
            words = WORD.findall(m[0].lower())
            if words:
                found = [x for x in map(word_weights.__getitem__, dict.fromkeys(words)) if x]
                yield m.start(), m.end(), _logistic(self.bias + sum(found)) if found else quiet

    def document(self, text: str | None, word_weights: dict[str, float]) -> tuple[float, int | None, int | None, float | None, int]:
        """Score; start, length and probability of the worst sentence; sentences at 0.5 or more."""
        log_clean, worst, offending = 0.0, (None, None, None), 0
        for start, end, p in self.sentences(text, word_weights):
            log_clean += log1p(-min(p, 1 - 1e-12))
            if worst[2] is None or p > worst[2]:
                worst = (start, end - start, p)
            offending += p >= 0.5
        return min(1.0, max(0.0, -expm1(log_clean))), *worst, offending


def _logistic(z: float) -> float:
    return 1 / (1 + exp(-z)) if z > -700 else 0.0


def bags(text: str | None) -> list[list[str]]:
    """The distinct words of each sentence with words."""
    found = (sorted(set(WORD.findall(m[0].lower()))) for m in SENTENCE.finditer(text or ""))
    return [words for words in found if words]


@dataclass(frozen=True)
class Bag:
    """A document: how many sentences have words; of those with known features the numbers, one sentence after the other, and their ends."""

    sentences: int
    numbers: list[int]
    ends: list[int]


def deviation(c1: float, c0: float, n1: float, n0: float) -> float:
    """How clearly a feature of c1 documents with label 1 and c0 others speaks for the label."""
    share = (c0 + c1) / (n0 + n1)
    return (c1 / n1 - c0 / n0) / max(1e-9, share * (1 - share) * (1 / n0 + 1 / n1)) ** 0.5


def screened(counts: dict[str, tuple[int, int]], n1: int, n0: int) -> list[str]:
    """The features most clearly more frequent among documents with label 1, the clearest first."""
    clear = {f: deviation(c1, c0, n1, n0) for f, (c1, c0) in counts.items() if c0 + c1 >= LEAST_DOCUMENTS}
    return sorted((f for f, z in clear.items() if z > LEAST_DEVIATION), key=lambda f: (-clear[f], f))[:VOCABULARY]


def numbered(sentences: list[list[str]], number: dict[str, int]) -> Bag:
    """A document by the numbers of its words' features; sentences without any are only counted."""
    numbers, ends = [], []
    for s in sentences:
        own = [number[f] for w in s for f in features(w) if f in number]
        if own:
            numbers += own
            ends.append(len(numbers))
    return Bag(len(sentences), numbers, ends)


def fit(vocabulary: list[str], documents: list[Bag], labels: list[int]) -> NoisyOr:
    """Learn from bags of sentences and the labels of the bags."""
    if len(set(labels)) < 2:
        return NoisyOr(-1e9, {})
    words = np.concatenate([np.array(d.numbers, "i8") for d in documents])
    sizes = np.concatenate([np.diff([0, *d.ends]).astype("i8") for d in documents])
    sentence_of = np.repeat(np.arange(len(sizes)), sizes)
    document_of = np.repeat(np.arange(len(documents)), [len(d.ends) for d in documents])
    quiet = np.array([d.sentences - len(d.ends) for d in documents], "f8") * -log1p(exp(QUIET))  # their log-probability of being clean
    y = np.array(labels, "f8")
    share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))  # both labels weigh the same
    theta, bias = np.zeros(len(vocabulary)), QUIET
    theta_sum = np.full(len(vocabulary), 1e-8)
    for epoch in range(EPOCHS):
        z = bias + np.bincount(sentence_of, theta[words], minlength=len(sizes))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_clean = quiet + np.bincount(document_of, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y))
        toxic = np.maximum(-np.expm1(log_clean), 1e-9)
        # d(-log likelihood)/dz of a sentence: p where the bag is clean, -p (1 - P) / P where it is toxic
        slope = (share * np.where(y > 0, -np.exp(log_clean) / toxic, 1.0))[document_of] * p
        g = np.bincount(words, slope[sentence_of], minlength=len(vocabulary))
        theta_sum += g**2
        rate = RATE / np.sqrt(theta_sum)
        if epoch < EPOCHS * 2 // 3:
            theta = theta - rate * g
            theta = np.sign(theta) * np.maximum(np.abs(theta) - rate * SHRINK, 0)
        else:  # the features that are left, without the penalty
            theta = np.where(theta != 0, theta - rate * g, 0)
    return NoisyOr(float(bias), {w: float(t) for w, t in zip(vocabulary, theta, strict=True) if abs(t) > 1e-3})


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, remainder: int = 1, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> NoisyOr:
    """Learn on at most ``per_class`` documents of each label that are not held out.

    Features are counted where the texts are; the counts of features seen in LEAST_DOCUMENTS documents and the numbers of the screened
    ones reach the driver, never texts or words. Of several texts of one id the first by a hash of the text counts.
    """
    known = [training_rows(labels, label, modulus, remainder, per_class, id_col, value) for value in (0, 1)]
    chosen = (
        docs.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("content"))
        .join(F.broadcast(known[0].union(known[1])), F.col("row_id") == F.col("train_id"))
        .groupBy("row_id", "label").agg(F.min_by("content", F.xxhash64("content")).alias("content"))
    )
    chosen = staged(chosen, "toxicity-sample")
    n = {r.label: r["count"] for r in chosen.groupBy("label").count().collect()}
    if len(n) < 2:
        return fit([], [], [])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for label_, text in zip(b.column(0), b.column(1), strict=True):
                found = sorted({f for w in {w for s in bags(text.as_py()) for w in s} for f in features(w)})
                yield pa.RecordBatch.from_arrays([pa.array([label_.as_py()] * len(found), pa.int32()), pa.array(found, pa.string())], ["label", "feature"])

    counts = chosen.select("label", "content").mapInArrow(distinct, "label int, feature string").groupBy("feature").agg(F.count_if(F.col("label") == 1).alias("c1"), F.count_if(F.col("label") == 0).alias("c0"))
    clear = counts.where(F.col("c1") + F.col("c0") >= LEAST_DOCUMENTS).where(F.col("c1") / n[1] > F.col("c0") / n[0])
    vocabulary = screened({r.feature: (r.c1, r.c0) for r in clear.toLocalIterator()}, n[1], n[0])
    number = {f: k for k, f in enumerate(vocabulary)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [numbered(bags(t.as_py()), number) for t in b.column(2)]
            cells = [pa.array([d.sentences for d in found], pa.int64()), *(pa.array([getattr(d, c) for d in found], pa.list_(pa.int32())) for c in ("numbers", "ends"))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cells], ["row_id", "label", "sentences", "numbers", "ends"])

    kind = chosen.schema["row_id"].dataType.simpleString()
    rows = chosen.select("row_id", "label", "content").mapInArrow(cut, f"row_id {kind}, label int, sentences long, numbers array<int>, ends array<int>").collect()
    rows.sort(key=lambda r: r.row_id)
    return fit(vocabulary, [Bag(r.sentences, r.numbers, r.ends) for r in rows], [r.label for r in rows])


def scored(docs: DataFrame, model: NoisyOr, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, score, worst_start, worst_length, worst_score, offending_sentences."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    columns = ["score", "worst_start", "worst_length", "worst_score", "offending_sentences"]
    kinds = [pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.word_weights()
        for b in batches:
            found = list(zip(*(model.document(t.as_py(), weights) for t in b.column(1)), strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(found, kinds, strict=True))], ["doc_id", *columns])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, score double, worst_start long, worst_length long, worst_score double, offending_sentences long")


def offending_sentences(docs: DataFrame, model: NoisyOr, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each sentence at ``threshold`` or more: doc_id, start, length, score, sentence."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.word_weights()
        for b in batches:
            out = [
                (k, i, j - i, p, t[i:j])
                for k, t in ((k, t.as_py()) for k, t in enumerate(b.column(1)))
                for i, j, p in model.sentences(t, weights)
                if p >= threshold
            ]
            at, start, length, p, sentence = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(p, pa.float64()), pa.array(sentence, pa.string())],
                ["doc_id", "start", "length", "score", "sentence"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(locate, f"doc_id {kind}, start long, length long, score double, sentence string")


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, remainder: int = 1, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, held_out, score, predicted, and where the worst sentence stands."""
    model = train(docs, labels, label, modulus, remainder, id_col=id_col, text_col=text_col)
    rows = scored(docs, model, id_col, text_col)
    return rows.select(
        F.col("doc_id").alias(id_col),
        held_out(F.col("doc_id"), modulus, remainder).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "worst_start",
        "worst_length",
        "worst_score",
        "offending_sentences",
    )
