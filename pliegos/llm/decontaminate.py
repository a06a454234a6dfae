"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are compared in lower case, with each run of other signs than letters and digits as one
blank. Each benchmark item is cut into overlapping windows of ``WINDOW`` characters, every
``STEP``; a shorter item is one window. A text is contaminated by an item when some part of it is
within the edit budget of one of the item's windows: one edit for each ``CHARACTERS_PER_EDIT``
characters.

A part within k edits of a window of n characters keeps at least n - Q + 1 - k Q of its q-grams, and
all of them lie on at most k + 1 neighbouring diagonals. So the shared q-grams of a text are
counted by window and by overlapping bands of diagonals; bands that meet the bound are aligned
with the window inside the band.

The index of the items goes to every task. Its size is checked: items are dealt into parts of
about ``PART_CHARACTERS`` characters, and each part is matched in a pass of its own. Texts are
matched where they are read, without a shuffle; copies cost what other texts cost.

Defined results: null, empty and wordless texts and items match nothing; items under Q characters must occur as whole
words; shorter items than two q-grams must occur unedited; very long texts are matched whole; columns of ``docs`` besides the id and
the text are carried as they are by ``decontaminated`` and play no part in ``matches``; empty tables match nothing; of several matching windows of an
item the one with the most shared q-grams is reported, then the first; repeated rows each report
their matches; repeated items are items of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .staging import free_name

Q = 8
WINDOW, STEP, CHARACTERS_PER_EDIT = 96, 32, 10  # WINDOW under 256: places are packed into a byte
PART_CHARACTERS = 1_000_000
FILTER_BITS = 20
MIX = np.uint64(0x9E3779B97F4A7C15)

_OTHER = re.compile(r"[\W_]+")
_ASCII = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256)).lower()


def normalised(text: str | None) -> str:
    text = text or ""
    if text.isascii():
        return b" ".join(text.encode().translate(_ASCII).split()).decode()
    return _OTHER.sub(" ", text.lower()).strip()


def codes(text: str) -> np.ndarray:
    """One byte for each character; different characters may share one, which alignment then tells apart."""
    if text.isascii():
        return np.frombuffer(text.encode(), np.uint8)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return (points ^ (points >> 8) ^ (points >> 16)).astype(np.uint8)


def grams(code: np.ndarray) -> np.ndarray:
    """The q-gram at each place, as a number."""
    n = len(code) - Q + 1
    if n <= 0:
        return np.zeros(0, "u8")
    raw, out = code.tobytes(), np.empty(n, "u8")
    for i in range(min(Q, n)):
        few = out[i::Q]
        few[:] = np.frombuffer(raw, "<u8", count=len(few), offset=i)
    return out


def edit_budget(length: int) -> int:
    return max(0, min(length // CHARACTERS_PER_EDIT, (length - Q) // Q))


def aligned(window: str, part: str) -> tuple[int, int, int]:
    """The fewest edits that turn a stretch of ``part`` into ``window``, with its start and end; leftmost end first."""
    text = np.array([ord(c) for c in part])
    n = len(part)
    # cost and start of the best alignment of the window so far that ends at each place
    cost, start = np.zeros(n + 1, "i8"), np.arange(n + 1)
    place = np.arange(n + 1)
    for c in window:
        change = cost[:-1] + (text != ord(c))
        lost = cost + 1
        best, origin = lost.copy(), start.copy()
        better = change <= best[1:]
        best[1:][better], origin[1:][better] = change[better], start[:-1][better]
        reach = best - place  # added characters: from the left, one edit for each
        low = np.minimum.accumulate(reach)
        source = np.maximum.accumulate(np.where(reach == low, place, 0))
        cost, start = low + place, origin[source]
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


class Index:
    """The q-grams of the windows of benchmark items."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.ids: list[object] = []
        self.texts: list[str] = []
        self.windows: list[tuple[int, int, int]] = []  # item, start, length
        self.short: dict[str, list[int]] = {}  # items under Q characters
        gram, window, place = [], [], []
        for item_id, text in items:
            text = normalised(text)
            if len(text) < Q:
                if text:
                    self.short.setdefault(text, []).append(len(self.ids))
                    self.ids.append(item_id)
                    self.texts.append(text)
                continue
            own, length = grams(codes(text)), min(WINDOW, len(text))
            for start in [*range(0, len(text) - length, STEP), len(text) - length]:
                n = length - Q + 1
                gram.append(own[start : start + n])
                window.append(np.full(n, len(self.windows)))
                place.append(np.arange(n))
                self.windows.append((len(self.ids), start, length))
            self.ids.append(item_id)
            self.texts.append(text)
        lengths = [length for _, _, length in self.windows]
        self.budget = np.array([edit_budget(n) for n in lengths], "i8")
        self.least = np.array([n - Q + 1 - edit_budget(n) * Q for n in lengths], "i8")
        g, w, p = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((gram, "u8"), (window, "i8"), (place, "i8")))
        order = np.argsort(g, kind="stable")
        self.grams, at = np.unique(g[order], return_index=True)
        self.at = np.r_[at, len(order)]
        self.p_window, self.p_place = w[order], p[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[_slot(self.grams)] = True

    def _candidates(self, own: np.ndarray) -> Iterator[tuple[int, int]]:
        """Windows and the first diagonals of the bands that keep enough q-grams, those with most first."""
        here = np.flatnonzero(self.filter[_slot(own)])
        found = np.minimum(np.searchsorted(self.grams, own[here]), len(self.grams) - 1)
        same = self.grams[found] == own[here]
        here, found = here[same], found[same]
        sizes = self.at[found + 1] - self.at[found]
        posting = np.repeat(self.at[found] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        window, place = self.p_window[posting], self.p_place[posting]
        width = self.budget[window] + 1
        band = (np.repeat(here, sizes) - place + 2 * WINDOW) // width
        # a band covers two widths and one starts at each width: any width of diagonals lies in one of them
        key = np.concatenate([window << 40 | band << 8 | place, window << 40 | (band - 1) << 8 | place])
        key.sort()
        key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key  # a q-gram of the window counts once in a band
        of_band = key >> 8
        starts = np.flatnonzero(np.r_[True, of_band[1:] != of_band[:-1]]) if len(key) else np.zeros(0, "i8")
        counts = np.diff(np.r_[starts, len(key)])
        enough = np.flatnonzero(counts >= self.least[key[starts] >> 40])
        for k in enough[np.argsort(-counts[enough], kind="stable")]:
            w = int(key[starts[k]] >> 40)
            kept = key[starts[k] : starts[k] + counts[k]] & 255
            # an edit spoils Q q-grams at most, so a run of lost ones takes an edit for each Q or part of it
            lost = np.diff(np.r_[-1, kept, self.windows[w][2] - Q + 1]) - 1
            if (-(-lost // Q)).sum() <= self.budget[w]:
                yield w, int(((key[starts[k]] >> 8) & ((1 << 32) - 1)) * (self.budget[w] + 1) - 2 * WINDOW)

    def _short_items(self, text: str) -> Iterator[tuple[int, int]]:
        """Short items among the whole words of a normalised text, each with its first place."""
        if not self.short:
            return
        starts = [0, *(m.end() for m in re.finditer(" ", text))]
        ends = [*(s - 1 for s in starts[1:]), len(text)]
        seen = set()
        for k, start in enumerate(starts):
            for end in ends[k:]:
                part = text[start:end]
                if end - start >= Q:
                    break
                if part in self.short and part not in seen:
                    seen.add(part)
                    yield from ((item, start) for item in self.short[part])

    def matches(self, text: str | None) -> list[tuple[object, int, int, int]]:
        """For each item that the text holds: its id; start, length and edits of the part, in the normalised text."""
        text, out = normalised(text), {}
        for item, start in self._short_items(text):
            out[item] = (self.ids[item], start, len(self.texts[item]), 0)
        own = grams(codes(text))
        if not self.windows or not len(own):
            return [out[k] for k in sorted(out)]
        for w, first in self._candidates(own):
            item, start, length = self.windows[w]
            if item in out:
                continue
            budget = int(self.budget[w])
            left = max(0, first - budget)
            wanted, part = self.texts[item][start : start + length], text[left : max(0, first + 3 * budget + 2 + length)]
            at = part.find(wanted)
            edits, i, j = (0, at, at + length) if at >= 0 else aligned(wanted, part)
            if edits <= budget:
                out[item] = (self.ids[item], left + i, j - i, edits)
        return [out[k] for k in sorted(out)]


def _slot(g: np.ndarray) -> np.ndarray:
    return (g * MIX) >> np.uint64(64 - FILTER_BITS)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each text and each item that it holds: doc_id, item_id, start, length, edits."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, start long, length long, edits long"
    found = None
    for index in _indexes(items):
        one = rows.mapInArrow(_matcher(spark.sparkContext.broadcast(index), items.schema["item_id"].dataType), schema)
        found = one if found is None else found.union(one)
    return found


def _indexes(items: DataFrame) -> Iterator[Index]:
    """Indexes of parts of the items, each of about PART_CHARACTERS characters."""
    characters = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-characters // PART_CHARACTERS))
    for part in range(parts):
        chosen = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text")
        yield Index([(r.item_id, r.text) for r in chosen.collect()])


def _matcher(index, item_type):
    kind = to_arrow_type(item_type)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, *m) for k, t in enumerate(b.column(1)) for m in index.value.matches(t.as_py())]
            at, item, start, length, edits = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(item, kind), *(pa.array(x, pa.int64()) for x in (start, length, edits))],
                ["doc_id", "item_id", "start", "length", "edits"],
            )

    return match


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no item, all columns as they are."""
    name, spark = free_name(docs, "clean"), docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    kept = docs
    for index in _indexes(items):
        kept = kept.withColumn(name, _clean(spark.sparkContext.broadcast(index))(F.col(text_col).cast("string"))).where(F.col(name)).drop(name)
    return kept


def _clean(index):
    @F.pandas_udf(T.BooleanType())
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not index.value.matches(t) for t in texts], dtype=bool)

    return clean
