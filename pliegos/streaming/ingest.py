"""Incremental runs: each run takes the files that are new, and merges them by key.

Rows are exactly once by their key, not by offsets: a batch that runs again gives the same snapshot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


class Snapshots:
    """Versions of a table, each in a folder of its own; the newest complete one counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [s.getPath() for s in fs.listStatus(folder)]
        return sorted(int(p.getName()[1:]) for p in names if p.getName()[:1] == "v" and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def latest(self) -> DataFrame | None:
        versions = self._versions()
        return self.spark.read.parquet(f"{self.path}/v{versions[-1]}") if versions else None

    def commit(self, df: DataFrame, version: int) -> None:
        """Write a version; a repeated batch overwrites its own version only."""
        df.write.mode("overwrite").parquet(f"{self.path}/v{version}")

    def before(self, version: int) -> DataFrame | None:
        versions = [v for v in self._versions() if v < version]
        return self.spark.read.parquet(f"{self.path}/v{versions[-1]}") if versions else None


def run_available(stream: DataFrame, snapshots: Snapshots, checkpoint: str, merge: Merge) -> None:
    """Take all that is available now, in batches, and merge each into the next snapshot."""

    def take(batch: DataFrame, batch_id: int) -> None:
        snapshots.commit(merge(snapshots.before(batch_id), batch), batch_id)

    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def keep_first(keys: list[str]) -> Merge:
    """A merge that keeps the first row of each key."""

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        new = new.dropDuplicates(keys)
        return new if old is None else old.unionByName(new.join(old.select(*keys), keys, "left_anti"))

    return merge


def backfill_days(first: str, last: str, cursor: str | None, most_days: int) -> list[str]:
    """The next days of a backfill that goes back from ``last`` to ``first``, after the last finished ``cursor``."""
    import datetime

    day = datetime.date.fromisoformat(last) if cursor is None else datetime.date.fromisoformat(cursor) - datetime.timedelta(days=1)
    out = []
    while day >= datetime.date.fromisoformat(first) and len(out) < most_days:
        out.append(day.isoformat())
        day -= datetime.timedelta(days=1)
    return out


