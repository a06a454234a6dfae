"""Token ids in ORC files, in ascending order of the document id.

Documents are range-partitioned and sorted by id; each partition becomes one file whose
stripes hold the ids as integer runs, with row indexes and a Bloom filter on the document
id. Readers take stripes in parallel and skip those whose statistics or Bloom filter rule
an id out.

Files: doc_id; ids array<int>, the end id last; part int, the file's place among all
files; row long, the document's place in its file.

Defined results: a null or empty text is the end id alone; rows repeated with one id follow
each other in their input order; null ids come first; an empty table gives no rows; very long texts are
encoded whole, as one row of one stripe; columns besides the id and the text play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import new_path, shuffle_partitions, staged
from .tokens import encoder

#: Ids that one Arrow batch holds before it is handed on.
IDS_AT_ONCE = 2_000_000

ORC_OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def encoded(docs: DataFrame, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, part, row in ascending order of doc_id over the partitions."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("line"))
    ordered = (
        rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", "line")
        .sortWithinPartitions("doc_id", "line")
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    )
    end = end_id.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_one, row = encoder(tokenizer_file), 0
        for b in batches:
            docs_at_once, ends, first = [], [0], 0
            for k, text in enumerate(b.column(1)):
                docs_at_once.append(encode_one(text.as_py() or "") + end)
                ends.append(ends[-1] + len(docs_at_once[-1]) // 4)
                if ends[-1] >= IDS_AT_ONCE or k == len(b) - 1:
                    ids = pa.array(np.frombuffer(b"".join(docs_at_once), "<i4"))
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)
                    n = len(docs_at_once)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(first, n), lists, b.column(2).slice(first, n), pa.array(range(row, row + n), pa.int64())],
                        ["doc_id", "ids", "part", "row"],
                    )
                    docs_at_once, ends, first, row = [], [0], k + 1, row + n

    return ordered.mapInArrow(encode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, part int, row long")


def write(docs: DataFrame, tokenizer_file: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the files and return their folder, by default a new one in the shared folder."""
    path = path or new_path(docs.sparkSession, "token-orc")
    encoded(docs, tokenizer_file, end_id, id_col, text_col).write.options(**ORC_OPTIONS).orc(path)
    return path


def documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents; the reader skips stripes by statistics and Bloom filter."""
    return spark.read.orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """For each document in the files: doc_id, start, n_tokens, ids_crc32."""
    stored = spark.read.orc(path).select("doc_id", "part", "row", "ids")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            ids, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            crcs = [zlib.crc32(ids[i:j].astype("<u4", copy=False)) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(np.diff(ends).astype("i8")), pa.array(crcs, pa.int64())],
                ["doc_id", "part", "row", "n_tokens", "ids_crc32"],
            )

    schema = f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, part int, row long, n_tokens long, ids_crc32 long"
    rows = staged(stored.mapInArrow(checked, schema), "token-digest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("file_tokens")).select("part", F.coalesce(F.sum("file_tokens").over(before), F.lit(0)).alias("file_start"))
    earlier = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(files, "part").select(
        "doc_id",
        (F.col("file_start") + F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).alias("start"),
        "n_tokens",
        "ids_crc32",
    )
