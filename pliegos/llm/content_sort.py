"""Exact deduplication by sorting contents.

Rows are range-partitioned by the first ``PREFIX`` characters of their normalised text and
its 64-bit hash, so that the sampled splitters stay short. Inside each partition they are
sorted (spilling to disk where needed), which puts equal texts side by side, and each row
is compared in full with its neighbours: the window over equal texts does that.

A text with very many copies would land in one task. A first pass counts copies by hash;
a text with more copies than half a partition's rows gets a salt, so that its rows sort
into several adjacent cells, and the few cell results are then put together. At most two
texts per partition can be that frequent, which bounds the broadcast tables.

Defined results: a null text counts as empty; empty texts are copies of each other;
rows repeated with the same id and text form one group of which one row stays; a null id
sorts below all others and stays only if every id of its group is null; an empty table
gives an empty result; very long texts are sorted and compared whole; of ties, rows with equal text and id, any one
stays, as they are alike; columns besides the id and the text play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import free_name, shuffle_partitions, staged

PREFIX = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case and every other character as it is; null gives ''."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _frequent(rows: DataFrame, partitions: int) -> DataFrame:
    """Hashes of texts with more copies than half of a partition's share, and into how many cells each is dealt.

    The hash is of ``lower(text)``: equal normalised texts have equal hashes.
    """
    most = F.greatest(F.lit(64.0), F.lit(rows.count() / (2 * partitions)))
    return (
        rows.groupBy("copy_key").agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > most)
        .select(F.col("copy_key"), F.ceil(F.col("copies") / most).cast("int").alias("cells"))
    )


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    ``keep``: 'smallest' or 'largest', which id of equal texts stays.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    partitions = shuffle_partitions(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("row_id"),
        F.col(text_col).alias("content"),
        F.xxhash64(F.lower(F.coalesce(F.col(text_col), F.lit("")))).alias("copy_key"),
    )
    frequent = F.broadcast(_frequent(rows, partitions))
    dealt = rows.join(frequent, "copy_key", "left").select(
        "row_id",
        normalised(F.col("content")).alias("content"),
        F.when(F.col("cells").isNull(), -1).otherwise(F.pmod(F.hash("row_id"), F.col("cells"))).alias("cell"),
    )
    keys = {"prefix": F.substring("content", 1, PREFIX), "content_key": F.xxhash64("content")}
    ordered = dealt.withColumns(keys).repartitionByRange(partitions, "prefix", "content_key", "cell")
    best_first = F.col("row_id").asc_nulls_last() if keep == "smallest" else F.col("row_id").desc_nulls_last()
    equal = Window.partitionBy("prefix", "content_key", "cell", "content")
    neighbours = ordered.select(
        "row_id",
        (F.col("cell") >= 0).alias("in_cell"),
        F.sha2(F.col("content").cast("binary"), 256).alias("text_sha256"),
        F.first("row_id").over(equal.orderBy(best_first)).alias("cell_keep"),
        F.row_number().over(equal.orderBy(best_first)).alias("rank"),
        F.count(F.lit(1)).over(equal).alias("cell_size"),
    )
    rows = staged(neighbours, "content-sort")
    best = F.min if keep == "smallest" else F.max
    whole = rows.where("in_cell").groupBy("text_sha256").agg(best("cell_keep").alias("whole_keep"), F.count(F.lit(1)).alias("whole_size"))
    keep_id = F.when(F.col("in_cell"), F.col("whole_keep")).otherwise(F.col("cell_keep"))
    return rows.join(F.broadcast(whole), "text_sha256", "left").select(
        F.col("row_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.when(F.col("in_cell"), F.col("whole_size")).otherwise(F.col("cell_size")).alias("group_size"),
        ((F.col("rank") == 1) & F.col("row_id").eqNullSafe(keep_id)).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are."""
    kept = content_sort(docs, id_col, text_col, keep).where("kept").select(
        F.col(id_col).alias(free_name(docs, "kept_id")), F.col("text_sha256").alias(free_name(docs, "kept_sha"))
    )
    name = free_name(docs, "content_sha")
    both = docs.withColumn(name, F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    return (
        both.join(kept, F.col(id_col).eqNullSafe(F.col(kept.columns[0])) & (F.col(name) == F.col(kept.columns[1])), "left_semi")
        .dropDuplicates([id_col, name])
        .drop(name)
    )
