"""Intermediate tables in the folder that the cluster shares, and names that clash with no column."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.scratch import new_path, shared_root, shuffle_partitions, staged

__all__ = ["free_name", "new_path", "shared_root", "shuffle_partitions", "staged"]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
