"""Hard negatives of anchors in an embedding table, by Fagin's threshold algorithm over integer inner products.

A component x counts as floor(256 x); a score is the integer inner product with the anchor, higher first, ties by the smaller id.
Anchors are dealt to batches and rows to blocks, both of a bounded size; a task takes one batch and one block. It sorts
each dimension's list of the block once. An anchor goes down the lists from the end that its component's sign
asks for; every row met is scored by random access, for all anchors of the group that still go on. What an anchor has not met
scores at most the threshold: its components times what stands in the lists now. An anchor stops once the threshold is strictly
below the k-th score of each of its windows, or below a window's lower bound while it holds fewer rows. Blocks' answers are merged by Spark.

The first pass finds an anchor's positives, its best other rows of the same label; each gives a window of scores. The second pass
finds the best rows of other labels in each window.

Defined results: rows with a null id, label or vector, or with a null, NaN or infinite component take no part; of rows with one id the
one with the smallest (label, vector) counts; vectors of different lengths meet in the components that both have; vectors without
components score 0; an empty table, or one without anchors or without other labels, gives no rows; columns other than the three named are not
read. A component times 256 beyond a 64-bit integer, or a score beyond it, is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

#: Rows of a block and anchors of a batch, about; anchors that go down the lists together, and the lists' first steps.
BLOCK, BATCH, TOGETHER, FIRST_DEPTH, DEEPER = 4096, 4096, 128, 16, 4
SCALE = 256
#: Scores below this are exact as doubles, and leave room for a row's number in 64 bits.
EXACT = 1 << 50
NONE = np.iinfo(np.int64).min


def prepared(table: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """id, label, x (array of long) of the rows that take part, an id once."""
    parts = table.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    parts = parts.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(finite)
    x = F.transform("v", lambda c: F.floor(c * SCALE))
    return parts.select("id", "label", x.alias("x")).groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.label", "r.x")


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of ``width`` integers; shorter vectors end in zeros."""
    flat = vectors.combine_chunks()
    out = np.zeros((len(flat), width), np.int64)
    lengths = np.diff(flat.offsets.to_numpy())
    values = flat.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(flat)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _width(vectors: pa.ChunkedArray) -> int:
    return max((len(v) for v in vectors if v.is_valid), default=0)


class Block:
    """Rows in ascending id order, and for each dimension the list of rows in ascending order of the component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, largest_anchor: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        bound = sum(int(m) for m in np.abs(self.x).max(axis=0, initial=0)) * largest_anchor if x.size else 0
        #: products are made by floating point where that is exact, else by Python's integers
        self.kind = np.float64 if bound * max(1, len(ids)) < 1 << 62 and bound < EXACT else object
        self.x = self.x.astype(self.kind)
        self.lists = np.argsort(self.x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.x, self.lists, axis=0)

    def scores(self, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        s = anchors @ self.x[rows].T
        return np.rint(s).astype(np.int64) if self.kind is np.float64 else s

    def search(self, anchors: np.ndarray, best) -> None:
        """Go down the lists for a group of ``anchors`` (integers, one a row).

        ``best(scores, threshold)`` is told all scores so far of the anchors that go on, by rows of the block (``None``: not met), and says which may stop.
        """
        a = anchors.astype(self.kind)
        n, width = self.x.shape
        going = np.arange(len(a))
        met = np.zeros(n, bool)
        scored = np.full((len(a), n), NONE, np.int64 if self.kind is np.float64 else object)
        done, depth = 0, min(FIRST_DEPTH, n)
        while len(going):
            up, down = (a[going] > 0).any(axis=0), (a[going] < 0).any(axis=0)
            new = np.zeros(n, bool)
            new[self.lists[n - depth : n - done][:, up]] = True
            new[self.lists[done:depth][:, down]] = True
            if depth == n:
                new[:] = True  # a list's end: nothing is left unmet, not even for anchors of zeros
            rows = np.flatnonzero(new & ~met)
            met |= new
            if len(rows):
                scored[np.ix_(going, rows)] = self.scores(a[going], rows)
            if depth == n:
                threshold = np.full(len(going), None, object)
            else:
                high, low = self.sorted[n - depth], self.sorted[depth - 1]
                threshold = np.where(a[going] > 0, a[going] * high, a[going] * low).sum(axis=1)
            going = going[~best(going, scored[going], threshold)]
            done, depth = depth, min(n, depth * DEEPER)


def _top(keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest of each row, largest first."""
    k = min(k, keys.shape[1])
    some = np.argpartition(keys, keys.shape[1] - k, axis=1)[:, keys.shape[1] - k :]
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(keys, some, axis=1), axis=1), axis=1)


def _ranked(scores: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Scores and places in one number, so that of equal scores the smaller id is the larger; NONE where not open."""
    n = scores.shape[1]
    if scores.dtype == object:
        floor = -(1 << 200)
        out = np.full(scores.shape, floor, object)
        at = open_ & (scores != NONE)
        out[at] = (scores * n + (n - 1 - np.arange(n)))[at]
        return out
    return np.where(open_ & (scores != NONE), scores * n + (n - 1 - np.arange(n)), NONE)


def _finished(threshold, bound: int | None) -> bool:
    """Whether no row that is not met can come up to ``bound``."""
    return threshold is None or (bound is not None and threshold < bound)


def _positives(block: Block, ids: np.ndarray, labels: np.ndarray, a: np.ndarray, k: int) -> list[tuple]:
    found: dict[int, list[tuple]] = {}

    def best(going: np.ndarray, scores: np.ndarray, threshold: np.ndarray) -> np.ndarray:
        own = (block.labels[None, :] == labels[going, None]) & (block.ids[None, :] != ids[going, None])
        keys = _ranked(scores, own)
        top = _top(keys, k)
        stop = np.zeros(len(going), bool)
        for i, g in enumerate(going):
            rows = [j for j in top[i] if own[i, j] and scores[i, j] != NONE]
            found[g] = [(int(ids[g]), int(block.ids[j]), int(scores[i, j])) for j in rows]
            stop[i] = _finished(threshold[i], int(scores[i, rows[-1]]) if len(rows) == k else None)
        return stop

    block.search(a, best)
    return [r for g in sorted(found) for r in found[g]]


def _negatives(block: Block, ids: np.ndarray, labels: np.ndarray, a: np.ndarray, windows: list[list[tuple[int, int, int, int]]], k: int) -> list[tuple]:
    found: dict[int, list[tuple]] = {}
    n = len(block.ids)

    def best(going: np.ndarray, scores: np.ndarray, threshold: np.ndarray) -> np.ndarray:
        keys = _ranked(scores, block.labels[None, :] != labels[going, None])
        order = np.argsort(keys, axis=1)
        stop = np.zeros(len(going), bool)
        for i, g in enumerate(going):
            rising = keys[i, order[i]]
            found[g], ends = [], True
            for positive, score, low, high in windows[g]:
                upper = int(np.searchsorted(rising, high * n + n - 1, side="right"))
                lower = max(int(np.searchsorted(rising, low * n, side="left")), upper - k)
                rows = order[i, lower:upper][::-1]
                found[g] += [(int(ids[g]), positive, score, int(block.ids[j]), int(scores[i, j])) for j in rows]
                ends &= low > high or _finished(threshold[i], int(scores[i, rows[-1]]) if len(rows) == k else low)
            stop[i] = ends
        return stop

    block.search(a, best)
    return [r for g in sorted(found) for r in found[g]]


def _tiles(rows: DataFrame, anchors: DataFrame):
    """Rows and anchors dealt to (block, batch): each block meets each batch, and a task holds one of each."""
    n, m = rows.count(), anchors.count()
    blocks, batches = -(-n // BLOCK) or 1, -(-m // BATCH) or 1

    def dealt(df: DataFrame, own: str, parts: int, other: str, copies: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(parts))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))

    left = dealt(rows, "block", blocks, "batch", batches).groupBy("block", "batch")
    right = dealt(anchors, "batch", batches, "block", blocks).groupBy("block", "batch")
    return left.cogroup(right)


def _open(rows: pa.Table, anchors: pa.Table):
    """The block, and the anchors' ids, labels and integers."""
    width = max(_width(rows["x"]), _width(anchors["x"]))
    a = _matrix(anchors["x"], width)
    block = Block(rows["id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["x"], width), int(np.abs(a).max(initial=0)))
    return block, anchors["id"].to_numpy(), anchors["label"].to_numpy(), a


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    return pa.table({c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(names)})


def positives(rows: DataFrame, anchors: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` other rows of an anchor's label: anchor_id, positive_id, positive_score."""
    names = ["anchor_id", "positive_id", "positive_score"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            block, ids, labels, a = _open(left, right)
            for s in range(0, len(ids), TOGETHER):
                t = slice(s, s + TOGETHER)
                found += _positives(block, ids[t], labels[t], a[t], k)
        return _table(found, names)

    found = _tiles(rows, anchors).applyInArrow(search, "anchor_id long, positive_id long, positive_score long")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k).drop("place")


def negatives(rows: DataFrame, anchors: DataFrame, chosen: DataFrame, low: int = 50, high: int = 95, k: int = 3) -> DataFrame:
    """The first ``k`` rows of other labels between ``low`` and ``high`` hundredths of each positive's score.

    anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.
    """
    held = chosen.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("windows"))
    asked = staged(anchors.join(held, "id"), "anchor-windows")
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            block, ids, labels, a = _open(left, right)
            windows = [
                [(w["positive_id"], s := w["positive_score"], -(-low * s // 100), high * s // 100) for w in held] for held in right["windows"].to_pylist()
            ]
            for s in range(0, len(ids), TOGETHER):
                t = slice(s, s + TOGETHER)
                found += _negatives(block, ids[t], labels[t], a[t], windows[t], k)
        return _table(found, names)

    found = _tiles(rows, asked).applyInArrow(search, ", ".join(f"{c} long" for c in names))
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3) -> DataFrame:
    """Hard negatives of the rows of ``prepared`` for which ``is_anchor`` (of id) holds."""
    rows = staged(rows, "vectors")
    anchors = rows.where(is_anchor)
    chosen = staged(positives(rows, anchors, n_positives), "positives")
    return negatives(rows, anchors, chosen, k=n_negatives)
