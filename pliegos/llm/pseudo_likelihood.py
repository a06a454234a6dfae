"""Language-model scores by masked pseudo-likelihood.

A small network, trained here in numpy, predicts every token of a text from the ``SIDE`` tokens
before it and the ``SIDE`` after it. A text's score is the sum of the log-probabilities of its
tokens, each given both sides.

Tokens: words in lower case (runs of letters and digits, and single other signs). How often each word occurs is
counted over all documents, in a table that grows with them: words are told apart by 64-bit hashes. A word's
probability is that of its class, from the network, times its own share of the class, from the table. Only the
network is of fixed size: its input vectors belong to ``BUCKETS`` numbers that the last ``ENDING`` letters of words are
hashed to, as endings tell more of rare words than the words do.

Classes: the words around those of each bucket, as sums of random vectors over all documents, put the buckets into ``CLUSTERS``
clusters (languages, say); in each cluster the words are split by falling count into ``BANDS`` bands of about equal
sums of square roots. The network sets the vectors of the tokens around side by side, and a softmax
layer over classes follows a tanh. Vectors start as those sums, the output from the frequencies of the classes.

Rows are blocks of about ``BLOCK`` tokens: whole documents as numbers in the block's own list of words. Words travel, not
tokens: each block's words meet their totals in a join, and go back to their block.

Training: in each of ``ROUNDS`` passes every partition starts from the same weights and takes its own
documents, every text whole, with every ``ROUNDS``-th token as a target and another residue in each pass, so
that every token is a target once. The weights of all partitions are averaged, weighted by their targets, over a
tree of ``GROUPS`` children, so no task holds more than ``GROUPS`` networks. Scoring predicts every token.

Defined results: null and empty texts have no token, log-probability 0 and a null mean; a text of one
token is predicted from empty sides; very long texts are read whole, as a block of their own; repeated rows score alike, up
to rounding; a word that training has not seen counts ``UNSEEN``; columns besides the id and the text play no part; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .staging import staged

BUCKETS, ENDING, CLUSTERS, BANDS, WIDTH, SIDE, REACH = 1 << 15, 3, 8, 4, 8, 2, 8
CLASSES = CLUSTERS * BANDS
ROUNDS, BATCH, RATE, VECTOR_RATE = 2, 2048, 1.0, 0.35
BLOCK, TOKENS_AT_ONCE, GROUPS = 1 << 20, 1 << 13, 32
UNSEEN, STEPS = 0.5, 8  # a count of n lies on step floor(STEPS * log2(n))
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
OFFSETS = [d for d in range(-SIDE, SIDE + 1) if d]


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def word_hash(word: str) -> int:
    """A 64-bit hash of the word, whose low bits are the bucket of its ending."""
    own, ending = (xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) for w in (word, word[-ENDING:]))
    return own // BUCKETS * BUCKETS + ending % BUCKETS


class _Numbers(dict):
    """From the words of a block to their numbers, by first occurrence."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def _packed(values, kind: str) -> bytes:
    return np.asarray(values, kind).tobytes()


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """block, doc_ids, sizes (tokens of each document), tokens (numbers in the block), words (their hashes), counts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    arrow_kind = to_arrow_type(kind)
    names = ["block", "doc_ids", "sizes", "tokens", "words", "counts"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids, parts, numbers, size = [], [], _Numbers(), 0

        def row() -> pa.RecordBatch:
            all_ = np.concatenate([np.zeros(0, "u4"), *parts])
            cells = [
                _packed([len(p) for p in parts], "<u4"), _planes(all_),
                _packed([word_hash(w) for w in numbers], "<u8"), _packed(np.bincount(all_, minlength=len(numbers)), "<u4"),
            ]
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([ids], pa.list_(arrow_kind)), *(pa.array([c], pa.binary()) for c in cells)], names)

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                ids.append(doc_id.as_py())
                parts.append(np.array(list(map(numbers.__getitem__, tokens(text.as_py()))), "u4"))
                size += len(parts[-1])
                if size >= BLOCK:
                    yield row()
                    ids, parts, numbers, size, block = [], [], _Numbers(), 0, block + 1
        if ids:
            yield row()

    schema = f"block long, doc_ids array<{kind.simpleString()}>, sizes binary, tokens binary, words binary, counts binary"
    return staged(rows.mapInArrow(cut, schema), "token-blocks", compression="zstd")


def _planes(numbers: np.ndarray) -> bytes:
    """The lower halves of all numbers, then the upper ones, which are mostly zero and compress to nothing."""
    return _packed(np.concatenate([numbers & 0xFFFF, numbers >> 16]), "<u2")


def _cells(batch: pa.RecordBatch, k: int, *columns: tuple[str, str]) -> list[np.ndarray]:
    """The arrays in row ``k``, each of its kind; ``planes`` are numbers in two halves."""
    out = []
    for name, kind in columns:
        values = np.frombuffer(batch.column(name)[k].as_py(), "<u2" if kind == "planes" else kind)
        if kind == "planes":
            half = len(values) // 2
            values = values[:half] | values[half:].astype("u4") << np.uint32(16)
        out.append(values)
    return out


def _edged(sizes: np.ndarray, side: int) -> np.ndarray:
    """The places of all tokens in a row with ``side`` ends before, between and after documents."""
    starts = side * (1 + np.arange(len(sizes)))
    return np.arange(int(sizes.sum())) + np.repeat(starts, sizes)


def _row(values: np.ndarray, places: np.ndarray, sizes: np.ndarray, side: int, end: int) -> np.ndarray:
    row = np.full(len(values) + side * (len(sizes) + 1), end, "i8")
    row[places] = values
    return row


def _word_rows(blocks: DataFrame) -> DataFrame:
    """block, hash and n of each word of each block."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                words, counts = _cells(b, k, ("words", "<u8"), ("counts", "<u4"))
                block = np.full(len(words), b.column("block")[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(words.view("i8")), pa.array(counts.astype("i8"))], ["block", "hash", "n"])

    return blocks.select("block", "words", "counts").mapInArrow(each, "block long, hash long, n long")


def _averaged(rows: DataFrame, parts: int) -> list[tuple[float, np.ndarray]]:
    """The mean of arrays (part, weight, flat), by weight, over a tree: one pair of weight and mean, or none."""

    def average(key: tuple, table: pa.Table) -> pa.Table:
        total, weight = None, 0.0
        for w, flat in zip(table.column("weight"), table.column("flat"), strict=True):
            one = np.frombuffer(flat.as_py(), "<f4").astype("f8") * w.as_py()
            total = one if total is None else total + one
            weight += w.as_py()
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "weight": pa.array([weight]), "flat": pa.array([_packed(total / weight, "<f4")], pa.binary())})

    while parts > 1:
        parts = -(-parts // GROUPS)
        rows = rows.withColumn("part", F.expr(f"part div {GROUPS}")).groupBy("part").applyInArrow(average, "part long, weight double, flat binary")
    return [(r.weight, np.frombuffer(r.flat, "<f4")) for r in rows.collect()]


def _flat(weight: float, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(weight)]), pa.array([_packed(values, "<f4")], pa.binary())], ["part", "weight", "flat"]
    )


def _contexts(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the mean of the random vectors of the tokens up to REACH places around its own, and its tokens' share."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = np.random.default_rng(7).normal(0, 1, (BUCKETS + 1, WIDTH))
        vectors[BUCKETS] = 0
        sums, seen = np.zeros((BUCKETS, WIDTH)), np.zeros(BUCKETS)
        for b in batches:
            for k in range(len(b)):
                sizes, numbers, words = _cells(b, k, ("sizes", "<u4"), ("tokens", "planes"), ("words", "<u8"))
                bucket = (words % BUCKETS).astype("i8")[numbers]
                places = _edged(sizes, REACH)
                row = _row(bucket, places, sizes, REACH, BUCKETS)
                for i in range(0, len(places), 1 << 16):
                    at = places[i : i + (1 << 16)]
                    low = int(at[0]) - REACH
                    near = vectors[row[low : int(at[-1]) + REACH + 1]]
                    upto = np.vstack([np.zeros((1, WIDTH)), np.cumsum(near, axis=0)])
                    around = upto[at - low + REACH + 1] - upto[at - low - REACH] - near[at - low]
                    own = row[at]
                    for d in range(WIDTH):
                        sums[:, d] += np.bincount(own, around[:, d], BUCKETS)
                    seen += np.bincount(own, minlength=BUCKETS)
        if seen.any():
            yield _flat(1, np.hstack([sums, seen[:, None]]).ravel())

    found = _averaged(blocks.select("sizes", "tokens", "words").mapInArrow(gather, "part long, weight double, flat binary"), blocks.rdd.getNumPartitions())
    if not found:
        return np.zeros((BUCKETS, WIDTH)), np.zeros(BUCKETS)
    both = found[0][1].reshape(BUCKETS, WIDTH + 1).astype("f8")
    seen = both[:, -1]
    mean = both[:, :-1] / np.maximum(seen, 1e-9)[:, None]
    mean[seen > 0] -= both[:, :-1].sum(axis=0) / seen.sum()
    length = np.linalg.norm(mean, axis=1, keepdims=True)
    return mean / np.maximum(length, 1e-9), seen / max(seen.sum(), 1e-9)


def clusters(points: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The cluster of each bucket, by k-means over the directions of the heaviest ones."""
    heavy = np.argsort(-weight, kind="stable")[:4096]
    x, w = points[heavy], np.sqrt(weight[heavy])
    centres = x[:1]
    while len(centres) < CLUSTERS:  # next the point that is heavy and far from all centres
        centres = np.vstack([centres, x[[int((w * (1 - (x @ centres.T).max(axis=1))).argmax())]]])
    for _ in range(20):
        own = (x @ centres.T).argmax(axis=1)
        moved = np.stack([(x[own == k] * w[own == k, None]).sum(axis=0) if (own == k).any() else centres[k] for k in range(CLUSTERS)])
        centres = moved / np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-9)
    return (points @ centres.T).argmax(axis=1)


def step_of(counts: np.ndarray) -> np.ndarray:
    return np.floor(STEPS * np.log2(np.maximum(counts, 1))).astype("i8")


@dataclass
class Network:
    """embedding: (BUCKETS + 1, WIDTH), the last for places beyond the ends; output: (places of the window * WIDTH + 1, CLASSES)."""

    embedding: np.ndarray
    output: np.ndarray

    @classmethod
    def fresh(cls, log_frequency: np.ndarray, vectors: np.ndarray) -> Network:
        """Every token is predicted by the frequency of its class."""
        output = np.zeros((len(OFFSETS) * WIDTH + 1, CLASSES), "f4")
        output[-1] = log_frequency
        return cls(np.vstack([vectors, np.zeros((1, WIDTH))]).astype("f4"), output)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.embedding.ravel(), self.output.ravel()])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        n = (BUCKETS + 1) * WIDTH
        return cls(flat[:n].reshape(-1, WIDTH).astype("f4"), flat[n:].reshape(-1, CLASSES).astype("f4"))

    def logits(self, h: np.ndarray) -> np.ndarray:
        z = h @ self.output[:-1]
        z += self.output[-1]
        z -= z.max(axis=1, keepdims=True)
        return z

    def learn(self, around: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step down the gradient of the mean loss of these targets."""
        h = np.tanh(self.embedding[around].reshape(len(around), -1))
        slope = self.logits(h)
        np.exp(slope, out=slope)
        slope /= slope.sum(axis=1, keepdims=True)
        slope[np.arange(len(target)), target] -= 1
        back = (slope @ self.output[:-1].T) * (1 - h**2)
        self.output[:-1] -= np.float32(rate / len(target)) * (h.T @ slope)
        self.output[-1] -= np.float32(rate / len(target)) * slope.sum(axis=0)
        buckets, parts = around.ravel(), back.reshape(-1, WIDTH)
        order = np.argsort(buckets, kind="stable")
        buckets = buckets[order]
        first = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
        # each vector moves by the mean of its own slopes, damped, so that rare ones learn too
        counts = np.diff(np.r_[first, len(buckets)])[:, None]
        self.embedding[buckets[first]] -= (np.float32(rate * VECTOR_RATE) / np.sqrt(counts).astype("f4")) * np.add.reduceat(parts[order], first)


@dataclass
class Model:
    network: Network
    cluster: np.ndarray  # of each bucket
    band: np.ndarray  # of each cluster and step of the count
    log_mass: np.ndarray  # of each class: the tokens of its words

    def placed(self, words: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket, class and log of the share of its class, of words with these totals."""
        bucket = (words % BUCKETS).astype("i8")
        cluster = self.cluster[bucket]
        own = cluster * BANDS + self.band[cluster, np.minimum(step_of(totals), self.band.shape[1] - 1)]
        return bucket, own, np.log(totals) - self.log_mass[own]

    def log_probabilities(self, numbers: np.ndarray, sizes: np.ndarray, bucket: np.ndarray, own: np.ndarray, log_share: np.ndarray) -> np.ndarray:
        """Of every token given both sides, documents one after the other."""
        places = _edged(sizes, SIDE)
        row = _row(bucket[numbers], places, sizes, SIDE, BUCKETS)
        targets, out = own[numbers], log_share[numbers].astype("f8")
        squashed = np.tanh(self.network.embedding)
        for k in range(0, len(places), TOKENS_AT_ONCE):
            at = places[k : k + TOKENS_AT_ONCE]
            h = squashed[np.stack([row[at + d] for d in OFFSETS], axis=1)].reshape(len(at), -1)
            z = self.network.logits(h)
            chosen = z[np.arange(len(at)), targets[k : k + len(at)]]
            np.exp(z, out=z)
            out[k : k + len(at)] += chosen - np.log(z.sum(axis=1))
        return out


@dataclass
class Trained:
    """The model and the table of words: hash, total, blocks (how many blocks hold it)."""

    model: Model
    totals: DataFrame


def _bands(totals: DataFrame, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The band of each cluster and step, and the tokens of each class; a row for each cluster and step reaches the driver."""
    spark = totals.sparkSession
    of_bucket = F.broadcast(spark.createDataFrame(list(enumerate(cluster.tolist())), "bucket int, cluster int"))
    step = F.floor(F.log2(F.col("total")) * STEPS).cast("int")
    rows = (
        totals.withColumn("bucket", F.col("hash").bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).join(of_bucket, "bucket")
        .groupBy("cluster", step.alias("step")).agg(F.sum("total").alias("mass"), F.sum(F.sqrt("total")).alias("root")).collect()
    )
    mass, root = np.zeros((CLUSTERS, 64 * STEPS)), np.zeros((CLUSTERS, 64 * STEPS))
    for r in rows:
        mass[r.cluster, r.step], root[r.cluster, r.step] = r.mass, r.root
    above = np.cumsum(root[:, ::-1], axis=1)[:, ::-1] - root  # of words that are more frequent
    whole = np.maximum(root.sum(axis=1, keepdims=True), 1e-9)
    band = np.minimum(above / whole * BANDS, BANDS - 1).astype("i8")
    tokens_of = np.bincount((np.arange(CLUSTERS)[:, None] * BANDS + band).ravel(), mass.ravel(), CLASSES)
    tokens_of[np.arange(CLUSTERS) * BANDS + band[:, 0]] += UNSEEN  # words that training has not seen are the rarest
    return band, tokens_of


def _numbered(blocks: DataFrame, found: DataFrame, model: Model, own_counts: bool) -> DataFrame:
    """block, doc_ids, sizes, tokens, and of the block's words buckets, classes and shares.

    ``found``: block, hash, total. A word that is not found counts as often as in its block, or as unseen.
    """
    held = blocks.sparkSession.sparkContext.broadcast((model.cluster, model.band, model.log_mass))
    kept = ["block", "doc_ids", "sizes", "tokens"]

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        lone = Model(None, *held.value)
        hashes, totals = (right.column(c).to_numpy() for c in ("hash", "total"))
        order = np.argsort(hashes)
        hashes, totals = hashes[order], totals[order]
        columns = [[], [], []]
        for k in range(len(left)):  # a block is one row
            words, numbers = _cells(left, k, ("words", "<u8"), ("tokens", "planes"))
            known = np.bincount(numbers, minlength=len(words)).astype("f8") if own_counts else np.full(len(words), UNSEEN)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, words.view("i8")), len(hashes) - 1)
                same = hashes[at] == words.view("i8")
                known[same] = totals[at[same]]
            for c, values, kind in zip(columns, lone.placed(words, known), ("<u2", "<u1", "<f4"), strict=True):
                c.append(_packed(values, kind))
        rows = left.select(kept)
        for name, c in zip(("buckets", "classes", "shares"), columns, strict=True):
            rows = rows.append_column(name, pa.array(c, pa.binary()))
        return rows

    kind = blocks.schema["doc_ids"].dataType.simpleString()
    schema = f"block long, doc_ids {kind}, sizes binary, tokens binary, buckets binary, classes binary, shares binary"
    return staged(blocks.drop("counts").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(place, schema), "numbered-blocks", compression="zstd")


_PLACED = (("sizes", "<u4"), ("tokens", "planes"), ("buckets", "<u2"), ("classes", "<u1"))


def _round(numbered: DataFrame, network: Network, residue: int) -> Network:
    """The average, weighted by targets, of the networks that the partitions have learned."""
    state = numbered.sparkSession.sparkContext.broadcast(network.flat())

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, targets = Network.of(state.value.copy()), 0
        for b in batches:
            for k in range(len(b)):
                sizes, numbers, buckets, classes = _cells(b, k, *_PLACED)
                places = _edged(sizes, SIDE)
                row = _row(buckets[numbers], places, sizes, SIDE, BUCKETS)
                at, wanted = places[residue::ROUNDS], classes[numbers[residue::ROUNDS]].astype("i8")
                for i in range(0, len(at), BATCH):
                    here = at[i : i + BATCH]
                    own.learn(np.stack([row[here + d] for d in OFFSETS], axis=1), wanted[i : i + BATCH], RATE * len(here) / BATCH)
                targets += len(at)
        if targets:
            yield _flat(targets, own.flat())

    found = _averaged(numbered.select(*[c for c, _ in _PLACED]).mapInArrow(learn, "part long, weight double, flat binary"), numbered.rdd.getNumPartitions())
    return Network.of(found[0][1]) if found else network


def _trained(docs: DataFrame, id_col: str, text_col: str) -> tuple[Trained, DataFrame]:
    blocks = _blocks(docs, id_col, text_col)
    words = _word_rows(blocks)
    totals = staged(words.groupBy("hash").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("blocks")), "word-totals")
    vectors, weight = _contexts(blocks)
    cluster = clusters(vectors, weight)
    band, mass = _bands(totals, cluster)
    model = Model(Network.fresh(np.log(np.maximum(mass, UNSEEN) / max(mass.sum(), 1)), vectors), cluster, band, np.log(np.maximum(mass, UNSEEN)))
    found = words.join(totals.where("blocks > 1"), "hash").select("block", "hash", "total")
    numbered = _numbered(blocks, found, model, own_counts=True)
    for k in range(ROUNDS):
        model.network = _round(numbered, model.network, k)
    return Trained(model, totals), numbered


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Trained:
    return _trained(docs, id_col, text_col)[0]


def score(docs: DataFrame, trained: Trained, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, n_tokens, log_probability (the sum) and mean_log_probability."""
    blocks = _blocks(docs, id_col, text_col)
    found = _word_rows(blocks).join(trained.totals, "hash").select("block", "hash", "total")
    return _scored(_numbered(blocks, found, trained.model, own_counts=False), trained.model, id_col)


def _scored(numbered: DataFrame, model: Model, id_col: str) -> DataFrame:
    held = numbered.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                sizes, numbers, buckets, classes, shares = _cells(b, k, *_PLACED, ("shares", "<f4"))
                logs = held.value.log_probabilities(numbers, sizes, buckets.astype("i8"), classes.astype("i8"), shares)
                sizes = sizes.astype("i8")
                ends = np.cumsum(sizes)
                sums = np.diff(np.r_[0.0, np.r_[0.0, np.cumsum(logs)][ends]])
                mean = pa.array(sums / np.maximum(sizes, 1), mask=sizes == 0)
                ids = b.column("doc_ids").slice(k, 1).flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(sums), mean], ["doc_id", "n_tokens", "log_probability", "mean_log_probability"])

    kind = numbered.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, log_probability double, mean_log_probability double"
    return numbered.mapInArrow(scores, schema).withColumnRenamed("doc_id", id_col)


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    trained, numbered = _trained(docs, id_col, text_col)
    return _scored(numbered, trained.model, id_col)
