"""The near-duplicates of ``simhash_gray`` by the Jaccard similarity of five-word shingles, at ``LEAST`` or more.

Links of SimHash fingerprints over five-word shingles, through the Gray-order index, are candidates first. They are not enough: at
similarity 0.8 two 64-bit fingerprints differ in about ten bits and often in fifteen, and blocks of 64 bits that
survive so many differences have four bits, which select nothing. So MinHash keys add candidates over the same shingles: ``BANDS``
keys of ``ROWS`` minima each. Two texts at 0.8 share a key with probability 1 - (1 - 0.8**4)**28, over 0.999999. All
candidates are verified by the exact similarity of their sets of 64-bit shingle hashes.

A candidate must agree in size and in all but ``MOST_DIFFER`` of 112 bits, one of each minimum: at 0.8 a pair fails that
with a probability under 1e-8.

A bucket holds the texts of one key, and counts while its texts lie in several components. First each text meets the leader of a bucket, its smallest text:
one leader, then those of its other buckets as far as they lie in other components; at first for a few bands only, which joins most copies, so that a bucket of copies
takes as many comparisons as it has texts. Buckets of ``WHOLE`` texts or fewer that this leaves open are then compared whole. The texts of larger ones
are compared by prefixes of their shingles in an order that puts common ones last, which loses no pair: many texts that share a passage do not meet by it. A row of a prefix bucket
knows how many shingles a text may have that first agrees with it there. A text with many shingles of its own reaches only shorter ones, so that texts of a family which differ too much are
never a pair. The leader of a prefix bucket is the text with the fewest shingles before it, which is the middle of a family. What is open then is compared whole, in buckets of any size.

Words: runs without white space, A-Z as a-z. Defined results: texts of fewer words make one shingle;
null and wordless texts are all alike; ids may be null or repeated, as texts are told apart by their hash; very long texts are read
whole; all columns are carried as they are; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash_gray
from .components import components
from .staging import free_name, staged

SHINGLE, LEAST = 5, (4, 5)  # the similarity as a fraction
BANDS, ROWS, FIRST_BANDS, WHOLE, MOST_DIFFER = 28, 4, 4, 64, 32
#: Shingles that so many texts hold count as common; so many of them are told to all tasks, and so many nodes.
COMMON_FROM, COMMON, BROADCAST_NODES = 16, 1 << 18, 1 << 20
SHINGLES_AT_ONCE, KEPT = 1 << 14, 400_000
#: Classes of sizes in a bucket, so many for each doubling.
SIZE_CLASSES = 32

_draw = np.random.default_rng(42)
PLACES = _draw.integers(1, 1 << 63, SHINGLE, "u8") | np.uint64(1)
TIMES = (_draw.integers(1, 1 << 32, (BANDS * ROWS, 1), "u8") | np.uint64(1)).astype("u4")
PLUS = _draw.integers(0, 1 << 32, (BANDS * ROWS, 1), "u8").astype("u4")
OF_BAND = _draw.integers(1, 1 << 63, (BANDS, ROWS), "u8") | np.uint64(1)
SALT = _draw.integers(1, 1 << 63, BANDS, "u8")


class _Hashes(dict):
    """From words to their hashes; holds KEPT at most."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < KEPT and len(word) < 40:
            self[word] = value
        return value


_hashes = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    for times in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(times)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct hashes of a UTF-8 text's shingles, sorted."""
    words = (text or b"").lower().split()
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], "u8")
    hashes = np.array(list(map(_hashes.__getitem__, words)), "u8")
    n = len(words) - SHINGLE + 1
    return np.unique(_mixed(sum(hashes[k : k + n] * PLACES[k] for k in range(SHINGLE))))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The MinHash of a set of shingle hashes: 32-bit minima."""
    least = np.full(BANDS * ROWS, 2**32 - 1, "u4")
    high = (hashes >> np.uint64(32)).astype("u4")
    for k in range(0, len(high), SHINGLES_AT_ONCE):
        least = np.minimum(least, (TIMES * high[k : k + SHINGLES_AT_ONCE] + PLUS).min(axis=1))
    return least


def signature(least: np.ndarray) -> np.ndarray:
    """A bit of each minimum, as two 64-bit integers."""
    bits = np.zeros(128, "u1")
    bits[: len(least)] = _mixed(least.astype("u8") + np.uint64(1)) & np.uint64(1)
    return np.packbits(bits).view("u8")


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band of minima."""
    return _mixed((least.astype("u8").reshape(BANDS, ROWS) * OF_BAND).sum(axis=1, dtype="u8") + SALT)


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    """node (a hash of the text) and text, as bytes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("node"), text.cast("binary").alias("text"))


def _sketches(docs: DataFrame, text_col: str) -> DataFrame:
    """node, n (shingles), signature (s0, s1: a bit of each minimum) and keys (one for each band), a row for each distinct text."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(1)]
            least = [minima(s) for s in sets]
            marks = np.array([signature(m) for m in least], "u8").reshape(-1, 2).view("i8")
            keys = pa.array([band_keys(m).view("i8") for m in least], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), keys], ["node", "n", "s0", "s1", "keys"])

    rows = _texts(docs, text_col).mapInArrow(sketch, "node long, n int, s0 long, s1 long, keys array<long>")
    return staged(rows.dropDuplicates(["node"]), "sketches")


def _sets(docs: DataFrame, nodes: DataFrame, text_col: str) -> DataFrame:
    """node and shingles of the texts among ``nodes``. Few nodes are told to all tasks, so that other texts never travel."""
    nodes = staged(nodes.distinct(), "wanted-nodes")
    few = nodes.count() <= BROADCAST_NODES
    told = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r.node for r in nodes.collect()], "i8"))) if few else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = np.flatnonzero(np.isin(b.column(0).to_numpy(zero_copy_only=False), told.value)) if few else range(len(b))
            for k in wanted:
                found = shingles(b.column(1)[int(k)].as_py())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([found.view("i8")], pa.list_(pa.int64()))], ["node", "shingles"])

    rows = _texts(docs, text_col)
    rows = rows if few else rows.join(nodes, "node", "left_semi").dropDuplicates(["node"])
    return staged(rows.mapInArrow(cut, "node long, shingles array<long>").dropDuplicates(["node"]), "shingle-sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) at LEAST or more."""
    met = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a"
    )
    part, whole = LEAST
    near = met.where(F.least(F.size("x"), F.size("y")) * whole >= F.greatest(F.size("x"), F.size("y")) * part)
    both = near.select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("sizes"))
    return both.where(F.col("both") * whole >= (F.col("sizes") - F.col("both")) * part).select("a", "b")


def _fingerprint_links(docs: DataFrame, text_col: str) -> DataFrame:
    """Pairs (a, b) of texts that connect the components of their SimHash fingerprints."""
    marked = simhash_gray.fingerprints(docs, SHINGLE, text_col, text_col).select(F.col("version").alias("node"), "fp")
    marked = staged(marked.distinct(), "shingle-fingerprints")
    first = staged(marked.groupBy("fp").agg(F.min("node").alias("first")), "first-of-fingerprint")
    equal = marked.join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    left, right = (first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first")) for c in ("a", "b"))
    near = simhash_gray.links(first.select("fp")).join(left, "a").join(right, "b").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    return equal.union(near)


def _reach(n: Column) -> Column:
    """How many shingles a text may have at most to be alike to one of ``n``."""
    part, whole = LEAST
    return F.floor(n.cast("long") * whole / part)


def _alike(x: str, y: str) -> Column:
    """Whether two rows lie in different components, each reaches the other's size, and their signatures allow a similarity of LEAST."""
    reached = (F.col(f"{x}.n") <= F.col(f"{y}.reach")) & (F.col(f"{y}.n") <= F.col(f"{x}.reach"))
    differ = sum(F.bit_count(F.col(f"{x}.s{k}").bitwiseXOR(F.col(f"{y}.s{k}"))) for k in (0, 1))
    return (F.col(f"{x}.root") != F.col(f"{y}.root")) & reached & (differ <= MOST_DIFFER)


def _rooted(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.drop("root").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _open(rows: DataFrame, leader: Column | None = None) -> DataFrame:
    """The rows (key, node, n, s0, s1, reach, root) of keys whose texts lie in several components, with the key's leader, its smallest node unless given, and its number of texts."""
    ends = [F.min("root").alias("first"), F.max("root").alias("last"), (F.min("node") if leader is None else leader).alias("leader"), F.count(F.lit(1)).alias("many")]
    keys = staged(rows.groupBy("key").agg(*ends).where("first <> last").select("key", "leader", "many"), "open-keys")
    return staged(rows.join(keys, "key"), "open-buckets")


def _with_leaders(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket's leader and another of its texts, once however many buckets they share."""
    lead = members.where("node = leader").select("key", "node", "n", "s0", "s1", "reach", "root").alias("x")
    other = members.where("node <> leader").alias("y")
    return other.join(lead, (F.col("x.key") == F.col("y.key")) & _alike("x", "y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _all_of(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components in buckets of a bounded size; those with the leader have been compared."""
    x, y = members.where("node <> leader").alias("x"), members.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & _alike("x", "y"))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _by_leaders(members: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """``found`` after each text has met the leaders of its buckets: one of them first, then the others of texts that are still apart."""
    asked = staged(_with_leaders(members), "leader-pairs")
    one = asked.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    found = _joined(found, _near(one, sets))
    ends = [found.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b")]
    rest = asked.join(one, ["a", "b"], "left_anti").join(ends[0], "a", "left").join(ends[1], "b", "left")
    return _joined(found, _near(rest.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b"), sets))


def _in_small(members: DataFrame, found: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``found`` after buckets of WHOLE texts or fewer have been compared whole, and the larger ones that are open then."""
    still = _open(_rooted(members.drop("leader", "many"), found))
    found = _joined(found, _near(_all_of(still.where(F.col("many") <= WHOLE)), sets))
    large = still.where(F.col("many") > WHOLE).drop("leader", "many")
    return found, _open(_rooted(large, found))


def _size_class(n: Column) -> Column:
    return F.floor(F.log2(n) * SIZE_CLASSES).cast("int")


def _across(members: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """``found`` after all pairs of different components in prefix buckets of any size that reach each other.

    Of such a pair, one at least reaches its own size: two that do not would each be the shorter one. All others look for those, by classes of
    the sizes that they reach. The largest component of a bucket looks for the rest only, so that its texts do not meet each other.
    """
    part, whole = LEAST
    rows = _open(_rooted(members.drop("leader", "many"), found)).drop("leader", "many")
    counts = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("many"))
    largest = counts.groupBy("key").agg(F.max(F.struct("many", "root")).alias("most")).select("key", F.col("most.root").alias("largest"))
    rows = staged(rows.join(largest, "key").withColumn("inside", F.col("root") == F.col("largest")).drop("largest"), "texts-across")
    met = rows.where("reach >= n").withColumn("size", _size_class(F.col("n")))
    ends = met.groupBy("key", "inside").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("reach").alias("far")).withColumnRenamed("inside", "side")
    sides = F.when(F.col("inside"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    asking = rows.withColumn("side", F.explode(sides)).join(ends, ["key", "side"])
    low, high = F.greatest("low", F.ceil(F.col("n").cast("long") * part / whole)), F.least("high", "reach")
    asking = asking.where((low <= high) & (F.col("n") <= F.col("far"))).withColumn("size", F.explode(F.sequence(_size_class(low), _size_class(high))))
    x, y = met.alias("x"), asking.alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.inside") == F.col("y.side")) & (F.col("x.size") == F.col("y.size"))
    pairs = y.join(x, same & _alike("x", "y")).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    return _joined(found, _near(pairs, sets))


def _prefixes(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (key, node, n, s0, s1, reach, root) with a key for each shingle of a prefix of each text: two texts at LEAST or more share one of them.

    In any one order of all shingles, texts of n shingles at 4/5 or more share one among the first n - ceil(4 n / 5) + 1. If the first that they share has p shingles of
    one of them before it, they share n - p at most, and must share 4/9 of the sum of their sizes: the other has (5 n - 9 p) / 4 at most, which is the row's reach. The
    order here puts those last that many texts hold, so that a passage that many documents share is in few prefixes; which those are is counted
    over all of ``texts``, and the commonest ``COMMON`` are told to all tasks.
    """
    held = sets.join(texts.select("node"), "node", "left_semi")
    counts = held.select(F.explode("shingles").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") >= COMMON_FROM)
    common = sorted((r.key, r.many) for r in counts.orderBy(F.desc("many"), "key").limit(COMMON).collect())
    told = texts.sparkSession.sparkContext.broadcast((np.array([k for k, _ in common], "i8"), np.array([m for _, m in common], "i8")))
    part, whole = LEAST

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, many = told.value
        for b in batches:
            for k in range(len(b)):
                s = b.column(1)[k].values.to_numpy()
                at = np.minimum(np.searchsorted(keys, s), len(keys) - 1) if len(keys) else None
                weight = np.where(keys[at] == s, many[at], 0) if len(keys) else np.zeros(len(s), "i8")
                first = s[np.lexsort((s, weight))[: len(s) - -(-part * len(s) // whole) + 1]]
                reach = (whole * len(s) - (whole + part) * np.arange(len(first))) // part
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0)[k].as_py(), len(first)), pa.int64()), pa.array(first, pa.int64()), pa.array(reach, pa.int64())], ["node", "key", "reach"])

    return held.select("node", "shingles").mapInArrow(cut, "node long, key long, reach long").join(texts, "node").select("key", "node", "n", "s0", "s1", "reach", "root")


def roots(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """node and root of the texts that are near another; the root has no row."""
    sketches = _sketches(docs, text_col)

    def bucketed(found: DataFrame, bands: int) -> DataFrame:
        rows = _rooted(sketches, found).select("node", "n", "s0", "s1", _reach(F.col("n")).alias("reach"), "root", F.explode(F.slice("keys", 1, bands)).alias("key"))
        return _open(rows)

    by_fingerprint = staged(_fingerprint_links(docs, text_col).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "fingerprint-pairs")
    found = docs.sparkSession.createDataFrame([], "node long, root long")
    # a few bands and the fingerprints join most copies, whose buckets are then of one component in all bands
    members = bucketed(found, FIRST_BANDS)
    ends = by_fingerprint.select(F.col("a").alias("node")).union(by_fingerprint.select("b"))
    sets = _sets(docs, members.select("node").union(ends), text_col)
    found = _joined(found, _near(by_fingerprint, sets))
    found = _by_leaders(_open(_rooted(members.drop("leader", "many"), found)), found, sets)
    members = bucketed(found, BANDS)
    more = members.select("node").distinct().join(sets.select("node"), "node", "left_anti")
    sets = sets.unionByName(_sets(docs, more, text_col))
    found = _by_leaders(members, found, sets)
    found, large = _in_small(members, found, sets)
    if large.isEmpty():
        return found
    texts = staged(large.select("node", "n", "s0", "s1", "root").dropDuplicates(["node"]), "texts-apart")
    middle = F.min(F.struct((_reach(F.col("n")) - F.col("reach")).alias("before"), F.col("node")))["node"]
    members = _open(staged(_prefixes(texts, sets), "prefixes"), middle)
    return _across(members, _by_leaders(members, found, sets), sets)


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    return staged(_verified(pairs, sets), "near-pairs")


def _joined(found: DataFrame, more: DataFrame) -> DataFrame:
    """node and root after further links (a, b): only the roots that they touch are joined anew."""
    if more.isEmpty():
        return found
    ends = [found.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b")]
    touched = more.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    moved = components(touched.where("a <> b").distinct())
    below = moved.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return staged(found.join(below, "root", "left").select("node", F.coalesce("top", "root").alias("root")).union(moved), "near-roots")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the document with the smallest id, all columns as they are; a row repeated with its id and text counts once."""
    node, kept_id, kept_node = (free_name(docs, c) for c in ("node", "kept_id", "kept_node"))
    marked = docs.withColumn(node, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    # nulls last; by the text where ids are equal
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("node"))).alias("first")
    distinct = staged(marked.select(F.col(id_col).alias("id"), F.col(node).alias("node")).groupBy("node").agg(first), "distinct-texts")
    labelled = staged(distinct.join(staged(roots(docs, text_col), "near-roots"), "node", "left").select(F.coalesce("root", "node").alias("root"), "first"), "near-labels")
    keep = labelled.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias(kept_id), F.col("first.node").alias(kept_node))
    return marked.join(keep, F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(node) == F.col(kept_node)), "left_semi").dropDuplicates([id_col, node]).drop(node)
