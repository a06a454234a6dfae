"""Packing of tokenised documents into sequences of a fixed size, best fit decreasing.

A document is its token ids and the end id. Documents longer than a sequence are first
cut into full sequences and a rest. The pieces are dealt at random, by row number, into
groups of about ``GROUP`` pieces; in each group the pieces are taken from the longest to the
shortest, and a segment tree over remaining capacities gives the fullest open sequence that
still has room. Only lengths travel: the ids stay in the task that makes them. A group
leaves about one sequence partly filled, so padding does not depend on the corpus size.

Defined results: a null or empty text is the end id alone; repeated rows are packed like
any others; very long texts are encoded whole and cut; pieces of equal length are taken in the order of their numbers, and of
sequences with equal room the first; an empty table gives an empty result; a null id is carried as null; columns
besides the id and the text play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged
from .tokens import encoder

SEQUENCE = 4096
GROUP = 2048
ROWS_AT_ONCE = 4096
PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


class OpenSequences:
    """Open sequences by remaining capacity, under a segment tree that counts them."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def put(self, capacity: int, sequence: int, used: int) -> None:
        self.at[capacity].append((sequence, used))
        i = self.leaves + capacity
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int, int] | None:
        """The open sequence of the smallest capacity of at least ``least``: capacity, sequence, used."""
        i = self.leaves + least
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        sequence, used = self.at[capacity].pop()
        while i:
            self.count[i] -= 1
            i >>= 1
        return capacity, sequence, used


def best_fit_decreasing(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """For each length its sequence, numbered from 0, and its offset there."""
    open_, placed, sequences = OpenSequences(size), [(0, 0)] * len(lengths), 0
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = open_.take(lengths[k])
        if found is None:
            found, sequences = (size, sequences, 0), sequences + 1
        capacity, sequence, used = found
        placed[k] = sequence, used
        if capacity > lengths[k]:
            open_.put(capacity - lengths[k], sequence, used + lengths[k])
    return placed


def pieces(docs: DataFrame, tokenizer_file: str, end_id: int, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's pieces: id, start, length, ids_crc32 and the document's doc_tokens."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {PIECE}"
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = encoder(tokenizer_file), None
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            ids, *numbers = zip(*out, strict=True)
            columns = [pa.array(ids, kind), *(pa.array(x, pa.int64()) for x in numbers)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

        for b in batches:
            kind = b.schema.field(0).type
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                for start in range(0, n, size):
                    part = ids[4 * start : 4 * (start + size)]
                    out.append((doc_id.as_py(), start, len(part) // 4, zlib.crc32(part), n))
                if len(out) >= ROWS_AT_ONCE:
                    yield batch()
        if out:
            yield batch()

    return rows.mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer_file: str, end_id: int, size: int = SEQUENCE, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece, with its sequence_id and its offset in that sequence."""
    cut = staged(pieces(docs, tokenizer_file, end_id, size, id_col, text_col), "pieces")
    groups = max(1, -(-cut.count() // group))
    dealt = cut.withColumn("dealt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    schema = f"doc_id {cut.schema['doc_id'].dataType.simpleString()}, {PIECE}, sequence_id long, offset long"

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        placed = best_fit_decreasing(rows.column("length").to_pylist(), size)
        first = key[0].as_py()
        return (
            rows.drop_columns("dealt")
            .append_column("sequence_id", pa.array([first + groups * s for s, _ in placed], pa.int64()))
            .append_column("offset", pa.array([o for _, o in placed], pa.int64()))
        )

    return dealt.groupBy("dealt").applyInArrow(place, schema).withColumnRenamed("doc_id", id_col)
