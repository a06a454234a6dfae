"""Quality classification by a sparse ensemble of rules over text statistics.

Statistics of each whole text are made in Arrow batches. On a bounded sample of labelled
documents (``SAMPLE`` rows) boosted trees propose rules: each path from a root to a node is
a conjunction of conditions on statistics. A logistic model with an L1 penalty over the
rules keeps few of them, and those become one Spark column expression.

Defined results: a null text counts as empty; an empty text has all statistics at 0 and is
scored by the same rules; without labelled rows of both labels every score is the share of
label 1 (0.5 without any); repeated rows are scored alike; of splits that gain the same the first statistic and the lowest threshold
counts; very long texts are read whole; ``accepted`` carries all columns as they are; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import held_out, training_rows
from .staging import free_name

SAMPLE = 20_000
TREES, DEPTH, BINS, RATE = 24, 3, 32, 0.3
PENALTY, STEPS = 0.0005, 250

STATISTICS = [
    "log_words", "word_length", "longest_word", "distinct_words", "top_word", "equal_neighbours", "distinct_pairs", "capitals",
    "digits", "marks", "rare_marks", "exclamations", "bars", "stops", "other_bytes", "lines_per_word", "distinct_lines", "short_lines",
]
RARE_MARKS = b"#$%&*@^~<>\\{}[]=+_"


def text_statistics(text: str | None) -> tuple[float, ...]:
    """The STATISTICS of a text; shares are of bytes, words, pairs of words or lines."""
    words = (text or "").split()
    if not words:
        return (0.0,) * len(STATISTICS)
    raw = text.encode("utf-8", "replace")
    n, w = len(raw), len(words)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    capitals, digits, letters = count[65:91].sum(), count[48:58].sum(), count[97:123].sum()
    high, blanks = count[128:].sum(), count[9:14].sum() + count[32]
    lines = [x for x in text.split("\n") if x]
    distinct = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False))) / (w - 1) if w > 1 else 1.0
    lengths = list(map(len, words))
    return (
        float(np.log1p(w)), sum(lengths) / w, float(max(lengths)), len(distinct) / w, max(distinct.values()) / w,
        sum(map(eq, words, words[1:])) / w, pairs, capitals / n, digits / n,
        (n - capitals - digits - letters - high - blanks) / n, sum(int(count[c]) for c in RARE_MARKS) / n, count[33] / n,
        count[124] / n, count[46] / n, high / n, len(lines) / w, len(set(lines)) / max(1, len(lines)),
        sum(len(x) < 40 for x in lines) / max(1, len(lines)),
    )


@F.pandas_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS]))
def statistics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_statistics(t) for t in texts], columns=STATISTICS, dtype="float64")


Rule = tuple[tuple[str, bool, float], ...]
"""Conditions that must all hold: statistic, whether it must be above, threshold."""


@dataclass(frozen=True)
class RuleModel:
    bias: float
    weights: dict[Rule, float]

    def expression(self, source: str) -> Column:
        """The score as a column expression over the struct of statistics named ``source``."""
        total = F.lit(float(self.bias))
        for rule, weight in self.weights.items():
            holds = functools.reduce(
                lambda a, b: a & b,
                [(F.col(f"{source}.{name}") > limit) if above else (F.col(f"{source}.{name}") <= limit) for name, above, limit in rule],
            )
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _tree(bins: np.ndarray, edges: list[np.ndarray], slope: np.ndarray, curve: np.ndarray, rules: set[Rule]) -> np.ndarray:
    """Grow one tree on the gradients, add its paths to ``rules``, and return its step for each row."""
    step = np.zeros(len(slope))

    def grow(rows: np.ndarray, path: Rule, depth: int) -> None:
        g, h = slope[rows].sum(), curve[rows].sum()
        best = (1e-3, -1, -1)
        if depth < DEPTH and len(rows) >= 20:
            for f in range(bins.shape[1]):
                gs = np.cumsum(np.bincount(bins[rows, f], slope[rows], minlength=len(edges[f]) + 1))[:-1]
                hs = np.cumsum(np.bincount(bins[rows, f], curve[rows], minlength=len(edges[f]) + 1))[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                if len(gain) and (k := int(gain.argmax())) >= 0 and gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
        _, f, k = best
        if f < 0:
            step[rows] = -RATE * g / (h + 1)
            return
        for above in (False, True):
            part = rows[(bins[rows, f] > k) == above]
            deeper = (*path, (STATISTICS[f], above, float(edges[f][k])))
            if len(part):
                rules.add(tuple(sorted(deeper)))
                grow(part, deeper, depth + 1)

    grow(np.arange(len(slope)), (), 0)
    return step


def _rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    z, rules = np.zeros(len(y)), set()
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        z += _tree(bins, edges, p - y, p * (1 - p), rules)
    return sorted(rules)


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    parts = [(x[:, STATISTICS.index(name)] > limit) == above for name, above, limit in rule]
    return np.logical_and.reduce(parts)


def _lasso(features: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic weights under an L1 penalty, by accelerated proximal gradient steps."""
    n, k = features.shape
    scale = features.std(axis=0) + 1e-6
    a = np.hstack([np.ones((n, 1), "f4"), (features / scale).astype("f4")])
    v = np.ones(k + 1, "f4")
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    rate = 4 * n / float(v @ (a.T @ (a @ v)))
    w = ahead = np.zeros(k + 1)
    w[0] = ahead[0] = np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))
    momentum = 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(a @ ahead.astype("f4"))))
        moved = ahead - rate * (a.T @ (p - y).astype("f4")) / n
        moved[1:] = np.sign(moved[1:]) * np.maximum(np.abs(moved[1:]) - rate * PENALTY, 0)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = moved + (momentum - 1) / following * (moved - w), moved, following
    return float(w[0]), w[1:] / scale


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Learn from rows of STATISTICS and labels 0 or 1."""
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return RuleModel(float(np.log((share + 1e-3) / (1 - share + 1e-3))), {})
    rules = _rules(x, y)
    features = np.stack([_holds(r, x) for r in rules], axis=1).astype("f4") if rules else np.zeros((len(y), 0), "f4")
    bias, weights = _lasso(features, y)
    return RuleModel(bias, {r: float(w) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-4})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, remainder: int = 0, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> RuleModel:
    """Learn on at most ``sample`` labelled documents that are not held out; only their statistics reach the driver."""
    known = training_rows(labels, label, modulus, remainder, sample, id_col)
    chosen = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("content")).join(F.broadcast(known), F.col("row_id") == F.col("train_id"))
    rows = chosen.select("row_id", "label", statistics("content").alias("s")).select("row_id", "label", "s.*").toPandas()
    rows = rows.sort_values(["row_id", *STATISTICS]).drop_duplicates("row_id")  # of several texts of one id the one with the least statistics
    return fit(rows[STATISTICS].to_numpy("f8"), rows["label"].to_numpy("f8"))


def scored(docs: DataFrame, model: RuleModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of each text in ``score_col``."""
    s = free_name(docs, "statistics")
    return docs.withColumn(s, statistics(F.col(text_col))).withColumn(score_col, model.expression(s)).drop(s)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, remainder: int = 0, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, held_out, score, predicted."""
    model = train(docs, labels, label, modulus, remainder, id_col=id_col, text_col=text_col)
    rows = scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return rows.select(
        F.col("doc_id").alias(id_col),
        held_out(F.col("doc_id"), modulus, remainder).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, model: RuleModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns as they are."""
    score = free_name(docs, "score")
    return scored(docs, model, text_col, score).where(F.col(score) >= threshold).drop(score)
