"""Token counts of texts for a subword model, by a two-tier lookup of pre-token lengths on the map side.

Pre-tokens are the parts of a text that the model encodes apart: each begins with blanks or with a line feed. The first
tier is a table of the commonest pre-tokens' lengths, ``FREQUENT`` entries of ``LONGEST`` characters at most, that is
broadcast. The second is a cache of each worker process, ``KEPT`` entries at most, in front of the library. What is common
is found by a first pass over all texts: each task keeps a summary of bounded size, and only summaries are merged, so that no
pre-token is ever dealt out by its value. The summaries decide what is kept at hand and never what is counted.

A ``.model`` file is read by ``sentencepiece``, a ``.json`` file by ``tokenizers``. Files whose rules do not keep pre-tokens
apart, and all ``.json`` files, are counted text by text through the library.

Defined results: null counts as empty, and an empty text has no tokens; special strings inside texts are handled as the
library does by default; texts of any length are counted whole; each row is counted by itself, so that repeated ids, null ids and
equal texts need no rule; columns other than the id and the text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import staged

#: Entries of the broadcast table, and the characters of a pre-token that may be kept.
FREQUENT, LONGEST = 1 << 16, 40
#: Entries of a worker's cache, and pre-tokens that a task counts at once.
KEPT, COUNTED = 400_000, 1 << 18
BLANK, SOFT = " ", "▁"
#: A pre-token without its first blank: more blanks, then anything up to the next blank.
AFTER_BLANK = re.compile(" ( *[^ ]*)")


class Model:
    """Lengths by the library; ``apart`` tells whether pre-tokens can be counted apart."""

    def __init__(self, path: str):
        self.apart = False
        if path.endswith(".json"):
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.whole: Callable[[str], int] = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
        else:
            from sentencepiece import SentencePieceProcessor

            library = SentencePieceProcessor(model_file=path)
            self.whole = lambda text: len(library.encode(text, add_bos=False, add_eos=False, num_threads=1))
            self.apart = _keeps_apart(library)
            if self.apart:
                self.lead = self.whole("a")

    def length(self, pretoken: str) -> int:
        """Tokens of a pre-token that begins with a blank or a line feed, wherever it stands."""
        return self.whole("a" + pretoken) - self.lead


def _keeps_apart(library) -> bool:
    """Whether no token goes over the place before a blank or before a line feed."""
    try:
        from sentencepiece.sentencepiece_model_pb2 import ModelProto
    except ImportError:
        return False
    proto = ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    rules, trained = proto.normalizer_spec, proto.trainer_spec
    plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
    kinds = proto.SentencePiece
    return (
        plain
        and trained.model_type == trained.BPE
        and not trained.treat_whitespace_as_suffix
        and all(p.type != kinds.USER_DEFINED and SOFT not in p.piece.lstrip(SOFT) and "\n" not in p.piece and BLANK not in p.piece for p in proto.pieces)
    )


@functools.lru_cache(maxsize=2)
def model(path: str) -> Model:
    """One for each worker process, kept between tasks."""
    return Model(path)


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text that begin with a blank, without that blank; a blank is put before the text.

    Line feeds stay inside of them: ``Lengths`` cuts there what it does not know.
    """
    if SOFT in text:
        text = text.replace(SOFT, BLANK)
    if "  " in text or text[:1] == BLANK or text[-1:] == BLANK:
        return AFTER_BLANK.findall(BLANK + text)
    return text.split(BLANK) if text else []


class Lengths(dict):
    """From pre-tokens to their lengths: ``frequent``, then what this process has met, then the library."""

    def __init__(self, path: str, frequent: dict[str, int]):
        super().__init__(frequent)
        self.model, self.most = model(path), len(frequent) + KEPT

    def _keep(self, key: str, n: int) -> int:
        if len(self) < self.most and len(key) <= LONGEST:
            self[key] = n
        return n

    def __missing__(self, key: str) -> int:
        first, *lines = key.split("\n")
        if not lines:
            return self._keep(key, self.model.length(BLANK + key))
        return self._keep(key, self[first] + sum(map(self._line, lines)))

    def _line(self, line: str) -> int:
        """The length of a line feed and what follows it."""
        key = "\n " + line  # no key of ``pretokens`` has a blank behind another sign
        n = self.get(key)
        return self._keep(key, self.model.length("\n" + line)) if n is None else n


def _pruned(counts: Counter, most: int) -> Counter:
    return Counter(dict(sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:most]))


def _summary(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([list(counts)], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int64()))], ["keys", "counts"])


def frequent(texts: DataFrame, path: str, most: int = FREQUENT) -> dict[str, int]:
    """The lengths of pre-tokens that are common in all of ``texts`` (one text column), at most ``most``.

    A task keeps its ``most`` commonest; summaries of about the square root of the tasks are merged at a time, on
    executors, and the rest on the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                counts.update(k for k in pretokens(text.as_py() or "") if len(k) <= LONGEST)
                if len(counts) > COUNTED:
                    counts = _pruned(counts, COUNTED // 2)
        yield _summary(_pruned(counts, most))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for keys, values in zip(b.column(0), b.column(1)):
                counts.update(dict(zip(keys.as_py(), values.as_py())))
                if len(counts) > COUNTED:
                    counts = _pruned(counts, COUNTED // 2)
        yield _summary(_pruned(counts, most))

    shape = "keys array<string>, counts array<long>"
    of_tasks = staged(texts.mapInArrow(count, shape), "pretoken-summaries")
    few = math.isqrt(of_tasks.count()) + 1
    total: Counter = Counter()
    for row in of_tasks.repartition(few).mapInArrow(merge, shape).toLocalIterator():
        total.update(dict(zip(row[0], row[1])))
        total = _pruned(total, most)
    library = model(path)
    return {k: library.length(BLANK + k) for k in total if "\n" not in k}


def _looked_up(spark: SparkSession, path: str, common: dict[str, int]):
    shared = spark.sparkContext.broadcast(common)
    lengths: list[Lengths] = []

    def count(text: str) -> int:
        if not lengths:
            lengths.append(Lengths(path, shared.value))
        return sum(map(lengths[0].__getitem__, pretokens(text)))

    return count


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if model(path).apart:
        of_text = _looked_up(docs.sparkSession, path, frequent(rows.select("text"), path))
    else:
        of_text = lambda text: model(path).whole(text)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [of_text(text.as_py()) for text in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    sized = rows.select("id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    out = sized.mapInArrow(counted, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
