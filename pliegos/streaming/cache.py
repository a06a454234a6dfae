"""A cache of answers as keyed state of a stream: each key holds its last answer until it expires, by event time.

State lives in the RocksDB store and its checkpoint, so that it survives lost executors and grows beyond memory. A timer of each answer clears it, and tells so.
Rows of one key within a micro-batch are put in order in one task: ``maxFilesPerTrigger`` bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "key string, ord long, outcome string, answer string"
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000_000  # microseconds


class Answers(StatefulProcessor):
    """Questions become hits or misses; an answer replaces the one before it; one that is not renewed in time becomes expired."""

    def __init__(self, lifetime: int):
        self.lifetime = lifetime  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "answer string, ord long, expires long, timer long")

    def _expired(self, key: str, held: tuple) -> Row:
        return Row(key=key, ord=held[1], outcome="expired", answer=held[0])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.held.get()
        before = held
        for at, ord_, answer in sorted((r.at_us, r.ord, r.answer or "") for r in rows):
            if not answer:
                live = held is not None and at <= held[2]
                yield Row(key=key[0], ord=ord_, outcome="hit" if live else "miss", answer=held[0] if live else None)
                continue
            if held is not None and at > held[2]:
                yield self._expired(key[0], held)
            expires = at + self.lifetime
            held = (answer, ord_, expires, -(-expires // 1000))
        if held != before:
            if before is not None:
                self.handle.deleteTimer(before[3])
            self.handle.registerTimer(held[3])
            self.held.update(held)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.held.get()
        if held is not None and held[3] <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
            yield self._expired(key[0], held)

    def close(self) -> None:
        pass


def outcomes(stream: DataFrame, days: float, delay: str = "1 hour") -> DataFrame:
    """key, ord, outcome (hit, miss, expired) and answer of a stream of key, at, ord (unique) and answer (null or blank for a question).

    An answer holds for ``days``. Rows with a null key or time take no part, and neither do rows that come later than ``delay``.
    """
    rows = stream.where("key is not null and at is not null").select("key", "at", F.unix_micros("at").alias("at_us"), "ord", "answer")
    processor = Answers(int(days * DAY))
    return rows.withWatermark("at", delay).groupBy("key").transformWithState(statefulProcessor=processor, outputStructType=OUT, outputMode="append", timeMode="EventTime")


def run_available(stream: DataFrame, path: str) -> DataFrame:
    """Take all that is available now into a folder, a micro-batch to a folder of its own, and give all rows so far. State is kept beside them."""
    spark = stream.sparkSession

    def take(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    with _rocks(spark):
        stream.writeStream.foreachBatch(take).outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUT).parquet(f"{path}/rows")


class _rocks:
    """The state store of queries started meanwhile."""

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = self.conf.get(STORE, None)
        self.conf.set(STORE, ROCKS)

    def __exit__(self, *_) -> None:
        self.conf.unset(STORE) if self.before is None else self.conf.set(STORE, self.before)
