"""Hard negatives and whitening against brute force, and on odd rows."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pliegos.llm import hard_negatives, queries, whitening
from pyspark.sql import functions as F

from .. import oracle

EXTRA = "id int, x string, label2 int, block int, batch int, rank int, windows int, component int, n int, v string, r int, at int"


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_hard_negatives_equal_sql(spark, size):
    sf_dir = f"/root/testdata/{size}"
    df = queries.QUERIES["op11_hard_negatives"](spark, sf_dir)
    assert oracle.rows_of_spark(df) == oracle.rows_of_sql(oracle.connection(sf_dir), queries.ORACLE_SQL["op11_hard_negatives"])


def brute(rows, anchors, n_positives=5, n_negatives=3):
    """rows: (id, label, integers)."""
    out = []
    for a, label, x in rows:
        if a not in anchors:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), i, l) for i, l, y in rows if i != a]
        for s, i, _ in sorted(r for r in scored if r[2] == label)[:n_positives]:
            fit = sorted(r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s)[:n_negatives]
            out += [(a, i, k, r[1], -s, -r[0]) for k, r in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [0.02, 1.0, 1e6])
def test_ties_copies_signs_and_large_numbers(spark, monkeypatch, scale):
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "BATCH", 3)
    monkeypatch.setattr(hard_negatives, "FIRST_DEPTH", 1)
    rng = np.random.default_rng(5)
    vectors = np.round(rng.standard_normal((90, 6)), 1) * scale
    vectors[10:40] = vectors[10]  # copies
    vectors[:, 3] = 0
    data = [(i, int(rng.integers(0, 3)), [float(c) for c in v]) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>")
    rows = hard_negatives.prepared(table, "vec_id", "embedding", F.col("label"))
    found = sorted(tuple(r) for r in hard_negatives.mined(rows, F.col("id") % 4 == 0).collect())
    plain = [(i, l, [math.floor(256 * c) for c in v]) for i, l, v in data]
    assert found and found == brute(plain, {i for i in range(90) if i % 4 == 0})


def test_lists_stop_before_their_end():
    """Anchors along the axes, far above all others: the lists' first steps settle them."""
    rng = np.random.default_rng(6)
    x = rng.integers(-9, 10, (4096, 8))
    x[:32] += 1000 * np.eye(8, dtype=int)[np.arange(32) % 8]
    ids, labels = np.arange(4096), np.arange(4096) // 8 % 2
    block = hard_negatives.Block(ids, labels, x, 1009)
    seen = []
    inner = block.scores
    block.scores = lambda a, rows: (seen.append(len(rows)), inner(a, rows))[1]
    found = hard_negatives._positives(block, ids[:8], labels[:8], x[:8].astype(np.int64), 1)
    assert sum(seen) < 1500
    scores = x[:8] @ x.T
    for a, p, s in found:
        same = [(-scores[a, j], j) for j in range(4096) if labels[j] == labels[a] and j != a]
        assert min(same) == (-s, p)


ODD = [
    (0, 1, [0.5, 0.5]), (1, 1, [0.5, 0.5]), (1, 1, [0.5, 0.5]), (1, 2, [9.0, 9.0]), (2, 2, [0.4, 0.3]), (3, None, [1.0, 1.0]), (4, 1, None), (5, 1, [None, 1.0]),
    (6, 1, [float("nan"), 1.0]), (7, 1, [float("inf"), 1.0]), (None, 1, [0.5, 0.5]), (8, 2, [0.4]), (9, 2, []), (50, 3, [0.0, 0.0]),
]


def test_odd_rows_of_hard_negatives(spark):
    extra = (1, "x", 2, 3, 4, 5, 6, 7, 8, "v", 9, 10)
    table = spark.createDataFrame([(*r, *extra) for r in ODD], f"vec_id long, label int, embedding array<float>, {EXTRA}")
    rows = hard_negatives.prepared(table, "vec_id", "embedding", F.col("label"))
    plain = [(0, 1, [128, 128]), (1, 1, [128, 128]), (2, 2, [102, 76]), (8, 2, [102, 0]), (9, 2, [0, 0]), (50, 3, [0, 0])]
    assert sorted((r.id, r.label, list(r.x)) for r in rows.collect()) == [(0, 1, [128, 128]), (1, 1, [128, 128]), (2, 2, [102, 76]), (8, 2, [102]), (9, 2, []), (50, 3, [0, 0])]
    found = hard_negatives.mined(rows, F.col("id") % 2 == 0).collect()
    assert sorted(tuple(r) for r in found) == brute(plain, {0, 2, 8, 50})
    assert hard_negatives.mined(rows.limit(0), F.col("id") % 2 == 0).collect() == []


def plain_whitening(vectors):
    """Integers, distinct ones, eigenvalues and vectors of their covariance, by one dense solver."""
    x = np.floor(64 * vectors.astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, values[::-1], turn[:, ::-1]


def test_whitening_equals_a_dense_solver(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op12_whitening"](spark, sf_dir).collect()
    table = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pandas()
    x, n, sums, values, turn = plain_whitening(np.stack(table.embedding))
    assert len(rows) == 16 * len(table)
    got = {(r.vec_id, r.component): r for r in rows}
    for c in range(16):
        mine = np.array([got[k, c + 1].whitened for k in table.vec_id])
        want = ((n * x - sums) / n) @ turn[:, c] / math.sqrt(values[c])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-9
        assert abs(got[0, c + 1].explained / (values[c] / values.sum()) - 1) < 1e-12
    for k, row in zip(table.vec_id, x):
        assert got[k, 1].deviation == sum((n * int(e) - int(s)) ** 2 for e, s in zip(row, sums)) and got[k, 1].n == n
    assert {r.identity_error for r in rows} == {got[0, 1].identity_error} and 0 <= got[0, 1].identity_error < 1e-10


@pytest.mark.parametrize("spectrum", [[9, 4, 1], list(1 / np.arange(1, 121) ** 1.2), [1.0] * 20 + [0.0] * 100, [5.0] * 3 + [1.0] * 117, list(np.linspace(1, 1.2, 120))])
def test_components_of_any_spectrum(spectrum):
    width = len(spectrum)
    rng = np.random.default_rng(9)
    turn, _ = np.linalg.qr(rng.standard_normal((width, width)))
    v = (turn * np.array(spectrum)) @ turn.T
    values, vectors = whitening.leading(lambda q: v @ q, width, 16)
    want = np.sort(np.array(spectrum, float))[::-1][:16]
    assert np.abs(values - want).max() < 1e-12 * want[0]
    assert np.abs(v @ vectors - vectors * values).max() < 1e-9 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-12


def test_a_missed_direction_is_found():
    """A start that lies apart from the largest direction still ends with it."""
    v = np.diag(np.r_[10.0, np.linspace(1, 2, 99)])

    class Blind:
        def __init__(self):
            self.calls = 0

        def standard_normal(self, shape):
            self.calls += 1
            m = np.random.default_rng(self.calls).standard_normal(shape)
            if self.calls <= 2:
                m[0] = 0
            return m

    blind = Blind()
    real = np.random.default_rng
    try:
        np.random.default_rng = lambda seed=None: blind if seed == 77 else real(seed)
        values, _ = whitening.leading(lambda q: v @ q, 100, 16, seed=77)
    finally:
        np.random.default_rng = real
    assert abs(values[0] - 10) < 1e-10


def test_odd_rows_of_whitening(spark):
    extra = (1, "x", 2, 3, 4, 5, 6, 7, 8, "v", 9, 10)
    table = spark.createDataFrame([(*r, *extra) for r in ODD], f"vec_id long, label int, embedding array<float>, {EXTRA}").repartition(3)
    rows = whitening.whiten(table).collect()
    kept = [(0, [0.5, 0.5]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (1, [9.0, 9.0]), (2, [0.4, 0.3]), (3, [1.0, 1.0]), (None, [0.5, 0.5]), (8, [0.4, 0]), (9, [0, 0]), (50, [0, 0])]
    x, n, sums, values, _ = plain_whitening(np.array([v for _, v in kept], np.float32))
    assert n == 6 and len(rows) == 2 * len(kept)
    assert sorted(r.deviation for r in rows if r.component == 1) == sorted(int(((n * e - sums) ** 2).sum()) for e in x)
    assert {r.identity_error < 1e-9 for r in rows} == {True}
    assert whitening.whiten(table.limit(0)).collect() == []
    assert whitening.whiten(table.where("vec_id = 50")).collect() == []
    flat = spark.createDataFrame([(k, [float(k), 1.0, 2.0]) for k in range(9)], "vec_id long, embedding array<float>")
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}
    assert whitening._squares(np.array([[3 << 40, 1], [2, 2]])) == [None, 8]
