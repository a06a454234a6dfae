"""Near-duplicates by SimHash, linked through a hierarchical index in Gray order.

Fingerprint: each word shingle is hashed with XXH64; a bit is 1 where it is 1 in over half
of the hashes. Two texts link when their fingerprints differ in at most ``RADIUS`` bits.

Index: within a cell the distinct fingerprints are sorted by Gray rank, which puts similar ones side by
side; runs of ``FANOUT`` are factored into nodes that hold the masked bit pattern their members share, runs
of nodes into upper nodes, and so on to the top. Pairs of nodes are compared from the top: the differences of the
shared bits only add up on the way down, and a pair of groups is dropped whole once they pass the radius. All
links are found by that tree. Each cell hands on a spanning forest of its links, not all pairs; components join
the forests.

Up to ``CELL`` fingerprints are one cell. More are dealt over cells by masked patterns too: with at most ``RADIUS``
differences two fingerprints agree on one of ``RADIUS`` + 1 blocks of bits, so each fingerprint stands in one cell
for each block, and all its links are in cells it shares. Blocks are as wide as it takes for cells of about ``CELL``
fingerprints; a cell with over 2**LEFT of them is divided again in the bits that are left, until ``LEFT`` bits
or fewer are: no cell has over 2**LEFT distinct fingerprints, and there are seven levels at most. Groups that are
known to be one component are not compared again.

Only distinct fingerprints are indexed; copies meet in the counting of fingerprints.

Defined results: null and wordless texts have fingerprint zero and link with each other like
any others; fewer words than a shingle has make one shingle; very long texts are read whole; repeated rows share a component;
a component's id is its smallest id that is not null, or null; columns besides the id and the text
play no part; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .staging import free_name, staged

SHINGLE, SEED, RADIUS = 3, 42, 3
CELL, FANOUT, PAIRS_AT_ONCE, LEFT = 2048, 8, 1 << 18, 15
CROWD = 1 << LEFT
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a UTF-8 text, unsigned; A-Z count as a-z."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, starts, ends, at = b" ".join(words), [], [], 0
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    ends = ends[shingle - 1 :] or ends[-1:]
    digest, ones = xxhash.xxh64_digest, np.zeros(64, "i8")
    for k in range(0, len(ends), SHINGLES_AT_ONCE):
        few = slice(k, k + SHINGLES_AT_ONCE)
        hashes = b"".join([digest(joined[i:j], seed) for i, j in zip(starts[few], ends[few], strict=False)])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype="i8")
    return int.from_bytes(np.packbits(2 * ones > len(ends)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, version (a hash of the text) and fp, the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("doc_id"), version(F.col(text_col)).alias("version"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], ["doc_id", "version", "fp"])

    return rows.mapInArrow(mark, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, version long, fp long")


def version(text: Column) -> Column:
    """A hash of the text; null counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def gray_rank(fp: Column) -> Column:
    """The place of a code in Gray order, shifted so that signed order is its order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(2**63)))


def masks(widths: tuple[int, ...]) -> list[int]:
    """For each choice of a block on each level the bits that are fixed; a level has RADIUS + 1 blocks of its width."""
    paths: list[tuple[int, list[int]]] = [(0, list(range(63, -1, -1)))]
    for width in widths:
        deeper = []
        for fixed, left in paths:
            for k in range(RADIUS + 1):
                block = left[k * width : (k + 1) * width]
                deeper.append((fixed | sum(1 << b for b in block), left[: k * width] + left[(k + 1) * width :]))
        paths = deeper
    return [fixed for fixed, _ in paths]


def next_width(widths: tuple[int, ...], most: int) -> int:
    """The width of the next level's blocks; 0 if no more bits may be fixed.

    The first level's makes cells of about CELL out of ``most`` fingerprints; cells that are crowded still are divided by
    as many bits as there are, so that levels are few.
    """
    left = 64 - sum(widths)
    widest = left // (RADIUS + 1) if left > LEFT else 0
    return widest if widths else min(widest, math.ceil(math.log2(most / CELL)))


def _signed(bits: int) -> int:
    return bits - 2**64 if bits >= 2**63 else bits


def _divided(rows: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """Rows of cells of all levels but the last of ``widths`` moved to the cells below them."""
    fixed = F.array(*[F.lit(_signed(m)) for m in masks(widths)])
    return rows.select("path", "fp", "rank", F.explode(F.array(*[F.lit(i) for i in range(RADIUS + 1)])).alias("block")).select(
        (F.col("path") * (RADIUS + 1) + F.col("block")).alias("path"),
        F.col("fp").bitwiseAND(F.element_at(fixed, F.col("path") * (RADIUS + 1) + F.col("block") + 1)).alias("node"),
        "fp",
        "rank",
    )


def _joined(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``parent``, where each member points to the smallest of its component, after links i-j."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(parent, above := parent[parent]):
            parent = above


def _components_of_nodes(parent: np.ndarray, levels: int) -> list[np.ndarray]:
    """For each level the component of each node, -1 where its members are in several."""
    out = [parent]
    while len(out) < levels:
        at = np.arange(0, len(out[-1]), FANOUT)
        low, high = np.minimum.reduceat(out[-1], at), np.maximum.reduceat(out[-1], at)
        out.append(np.where(low == high, low, -1))
    return out


def linked(fps: np.ndarray, radius: int = RADIUS, trace: list[tuple[int, int, int]] | None = None) -> np.ndarray:
    """For codes in Gray order the place of the smallest member of each one's component under ``radius``.

    ``trace`` gets the level, the pairs compared and the pairs not dropped of each step.
    """
    full = np.uint64(2**64 - 1)
    levels = [(fps, np.full(len(fps), full), np.ones(len(fps), bool))]
    while len(levels[-1][0]) > FANOUT:
        pattern, mask, _ = levels[-1]
        at = np.arange(0, len(pattern), FANOUT)
        both, either = np.bitwise_and.reduceat(pattern, at), np.bitwise_or.reduceat(pattern & mask, at)
        shared = np.bitwise_and.reduceat(mask, at)
        shared &= ~(np.bitwise_and.reduceat(pattern | ~mask, at) ^ either)
        levels.append((both & shared, shared, None))
    parent = np.arange(len(fps))
    whole = _components_of_nodes(parent, len(levels))
    top = len(levels) - 1
    a, b = np.triu_indices(len(levels[top][0]))
    stack = [(top, a, b)]
    step = np.arange(FANOUT)
    while stack:
        level, a, b = stack.pop()
        most = PAIRS_AT_ONCE // FANOUT**2 if level else PAIRS_AT_ONCE  # so that what a step adds below is PAIRS_AT_ONCE at most
        if len(a) > most:
            stack += [(level, a[most:], b[most:]), (level, a[:most], b[:most])]
            continue
        pattern, mask, _ = levels[level]
        near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= radius
        if trace is not None:
            trace.append((level, len(a), int(near.sum())))
        apart = (whole[level][a] != whole[level][b]) | (whole[level][a] < 0)
        a, b = a[near & apart], b[near & apart]
        if level == 0:
            if len(a):
                parent = _joined(parent, a, b)
                whole = _components_of_nodes(parent, len(levels))
            continue
        below = len(levels[level - 1][0])
        x = np.repeat((a[:, None] * FANOUT + step), FANOUT, axis=1).ravel()
        y = np.tile((b[:, None] * FANOUT + step), (1, FANOUT)).ravel()
        keep = (x < y) | ((x == y) & (level > 1))
        keep &= (x < below) & (y < below)
        stack.append((level - 1, x[keep], y[keep]))
    return parent


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, node, fp) sorted by cell and Gray rank to links; the last cell of a batch waits for the next."""
    path, node, fps = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "u8")

    def links_of(upto: int) -> pa.RecordBatch:
        edges = np.flatnonzero((path[1:upto] != path[: upto - 1]) | (node[1:upto] != node[: upto - 1])) + 1 if upto else []
        left, right = [fps[:0]], [fps[:0]]
        for cell in np.split(fps[:upto], edges):
            parent = linked(cell)
            moved = np.flatnonzero(parent != np.arange(len(cell)))
            left.append(cell[moved])
            right.append(cell[parent[moved]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view("i8")) for x in (left, right)], ["a", "b"])

    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False).astype("i8") for k in range(3)]
        path, node = np.r_[path, columns[0]], np.r_[node, columns[1]]
        fps = np.r_[fps, columns[2].view("u8")]
        if len(path):
            last = np.flatnonzero((path != path[-1]) | (node != node[-1]))
            upto = int(last[-1]) + 1 if len(last) else 0
            yield links_of(upto)
            path, node, fps = path[upto:], node[upto:], fps[upto:]
    yield links_of(len(path))


def links(fps: DataFrame) -> DataFrame:
    """From distinct fingerprints (column fp) to pairs (a, b) of the same component, which connect each component."""
    rows = fps.select(F.lit(0).alias("path"), F.lit(0).cast("long").alias("node"), "fp", gray_rank(F.col("fp")).alias("rank"))
    widths: tuple[int, ...] = ()
    most, found = fps.count(), None
    while True:
        width = next_width(widths, most) if most > (CROWD if widths else CELL) else 0
        here = rows
        if width:
            if widths:
                crowded = staged(rows.groupBy("path", "node").count().where(F.col("count") > CROWD), "crowded")
                here = rows.join(crowded, ["path", "node"], "left_anti")
                rows = rows.join(crowded, ["path", "node"], "left_semi")
            else:
                here = None
        if here is not None:
            pairs = here.repartition("path", "node").sortWithinPartitions("path", "node", "rank").select("path", "node", "fp").mapInArrow(_forest, "a long, b long")
            found = pairs if found is None else found.union(pairs)
        if not width:
            return found
        widths = (*widths, width)
        rows = staged(_divided(rows, widths), "cells")
        most = rows.groupBy("path", "node").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]


def labelled(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows of ``fingerprints``, and for each fingerprint: fp, root (the component's smallest fingerprint), component_id."""
    marked = staged(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(links(distinct))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    # written first, so that both sides of the joins are plain shuffles, whose hot partitions Spark splits
    members = staged(rooted, "members")
    least = staged(members.groupBy("root").agg(F.min("first_id").alias("component_id")), "least-ids")
    return marked, staged(members.join(least, "root").select("fp", "root", "component_id"), "labels")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, fingerprint (16 hex digits), component_id (the smallest id reachable)."""
    marked, labels = labelled(docs, shingle, id_col, text_col)
    return marked.join(labels, "fp").select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the document with the smallest id, all columns as they are.

    Null ids come last; of one id with several texts in a component the first by a hash of the text stays; a row
    repeated with its id and text counts once.
    """
    marked, labels = labelled(docs, shingle, id_col, text_col)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("version"))).alias("first")
    keep = marked.join(labels, "fp").groupBy("root").agg(first)
    kept_id, kept, own = (free_name(docs, c) for c in ("kept_id", "kept_version", "version"))
    keep = keep.select(F.col("first.doc_id").alias(kept_id), F.col("first.version").alias(kept))
    both = docs.withColumn(own, version(F.col(text_col)))
    return both.join(keep, F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept)), "left_semi").dropDuplicates([id_col, own]).drop(own)
