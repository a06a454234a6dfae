"""Bounded samples of labelled rows, and the split into rows to learn from and rows held out.

Defined results: null ids and null labels take no part; an id labelled more than once counts with its largest label; labels other than 0 and 1 are left out; equal
hashes are put in order by the id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def training_rows(labels: DataFrame, label: str, modulus: int, remainder: int, rows: int, id_col: str = "doc_id", value: int | None = None) -> DataFrame:
    """At most ``rows`` labelled ids that are not held out, the first by a hash of the id: train_id, label (0 or 1).

    An id labelled more than once counts with its largest label; null ids and labels are left out.
    ``value`` restricts the rows to one label.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(id_col), modulus, remainder))
        .groupBy(F.col(id_col).alias("train_id"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    if value is not None:
        known = known.where(F.col("label") == value)
    return known.orderBy(F.xxhash64("train_id"), "train_id").limit(rows)
