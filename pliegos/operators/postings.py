"""A stored inverted index: which documents hold a token of a field, and where.

Postings are written once, in buckets of their token, and each run adds a segment with its new documents. A search reads the buckets of the
tokens it asks for, and never the documents. Within a segment postings are dealt by ranges of bucket, token and document, so that a
token of any frequency is spread over many files by its documents; each file is sorted, so that statistics of its row groups prune as well. Places are
absolute and rising: the file format stores their differences.

A document that comes again as it was is left out. One that comes again changed is written anew, and its older postings no longer count. A segment counts once
it is written whole; a run that failed is written over by the next.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import shuffle_partitions, staged
from .search import BROADCAST_KEYS, matches_among, hits_among


class Postings:
    """The index in a folder. ``buckets`` is fixed by the first run; ``doc_type`` is the type of document ids."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256, doc_type: str = "string"):
        self.spark, self.path, self.doc_type = spark, path.rstrip("/"), doc_type
        if self._exists(f"{self.path}/settings/_SUCCESS"):
            self.buckets = spark.read.schema("buckets int").parquet(f"{self.path}/settings").first().buckets
        else:
            self.buckets = buckets
            spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/settings")

    def _file(self, path: str):
        jvm = self.spark.sparkContext._jvm
        file = jvm.org.apache.hadoop.fs.Path(path)
        return file.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), file

    def _exists(self, path: str) -> bool:
        fs, file = self._file(path)
        return fs.exists(file)

    def segments(self) -> list[int]:
        """Numbers of the segments that are whole: the list of documents is written last."""
        fs, folder = self._file(f"{self.path}/documents")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(k for k in (int(n.split("=")[1]) for n in names if n.startswith("segment=")) if self._exists(f"{self.path}/documents/segment={k}/_SUCCESS"))

    def _read(self, table: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{table}/segment={k}" for k in self.segments()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*paths)

    def _documents(self) -> DataFrame:
        """doc_id and mark of each document as it was written last."""
        rows = self._read("documents", f"doc_id {self.doc_type}, mark long, again boolean, segment int")
        return rows.groupBy("doc_id").agg(F.max_by("mark", "segment").alias("mark"))

    def _bucket(self, field: Column, token: Column) -> Column:
        return F.pmod(F.xxhash64(field, token), F.lit(self.buckets)).cast("int")

    def add(self, docs: DataFrame, fields: dict[str, str], doc_id: str = "doc_id") -> int:
        """Index the documents that are new or changed; how many there were. ``fields``: the column of tokens of each field."""
        rows = docs.select(F.col(doc_id).cast(self.doc_type).alias("doc_id"), *[F.col(c).alias(f) for f, c in fields.items()]).where("doc_id is not null").dropDuplicates(["doc_id"])
        rows = rows.withColumn("mark", F.xxhash64(*fields))
        known = self._documents().withColumnRenamed("mark", "old")
        met = rows.join(known, "doc_id", "left")
        new = staged(met.where(F.col("old").isNull() | (F.col("old") != F.col("mark"))).withColumn("again", F.col("old").isNotNull()), "new-documents")
        many = new.count()
        if not many:
            return 0
        k = max(self.segments(), default=-1) + 1
        of_field = functools.reduce(DataFrame.unionByName, [new.select("doc_id", F.lit(f).alias("field"), F.posexplode(f).alias("at", "token")) for f in fields])
        # written first, as the ranges are drawn from a sample of these narrow rows
        spots = staged(of_field.where("token is not null").withColumn("bucket", self._bucket(F.col("field"), F.col("token"))), "spots")
        key = ["bucket", "field", "token", "doc_id"]
        ranged = spots.repartitionByRange(max(shuffle_partitions(self.spark), 2), *key)
        postings = ranged.groupBy(*key).agg(F.sort_array(F.collect_list("at")).alias("at")).sortWithinPartitions(*key)
        writer = postings.write.mode("overwrite").option("parquet.writer.version", "PARQUET_2_0").partitionBy("bucket")
        writer.parquet(f"{self.path}/postings/segment={k}")
        self._read_segment(k).groupBy("bucket", "field", "token").agg(F.count(F.lit(1)).alias("docs")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/terms/segment={k}")
        new.select("doc_id", "mark", "again").write.mode("overwrite").parquet(f"{self.path}/documents/segment={k}")
        return many

    def _posting(self) -> str:
        return f"field string, token string, doc_id {self.doc_type}, at array<int>, bucket int"

    def _read_segment(self, k: int) -> DataFrame:
        return self.spark.read.schema(self._posting()).parquet(f"{self.path}/postings/segment={k}")

    def _asked(self, rows: DataFrame, asked: DataFrame) -> DataFrame:
        """The rows of the asked (field, token), out of their buckets only; a list of buckets is bounded by their number."""
        keyed = staged(asked.select("field", "token").distinct().withColumn("bucket", self._bucket(F.col("field"), F.col("token"))), "asked-tokens")
        buckets = [r.bucket for r in keyed.select("bucket").distinct().collect()]
        few = keyed.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        return rows.where(F.col("bucket").isin(buckets)).join(F.broadcast(keyed) if few else keyed, ["bucket", "field", "token"], "left_semi")

    def _current(self, rows: DataFrame) -> DataFrame:
        """Without postings of documents that were written anew in a later segment."""
        if len(self.segments()) < 2:
            return rows
        again = self._read("documents", f"doc_id {self.doc_type}, mark long, again boolean, segment int").where("again").groupBy("doc_id").agg(F.max("segment").alias("last"))
        return rows.join(again, "doc_id", "left").where(F.col("last").isNull() | (F.col("segment") >= F.col("last"))).drop("last")

    def lookup(self, asked: DataFrame) -> DataFrame:
        """field, token, doc_id, at of the asked (field, token)."""
        found = self._asked(self._read("postings", self._posting() + ", segment int"), asked)
        return self._current(found).select("field", "token", "doc_id", "at")

    def frequencies(self, asked: DataFrame) -> DataFrame:
        """field, token and how many documents at most hold it (postings of changed documents included), from the lists of terms alone."""
        rows = self._read("terms", "field string, token string, docs long, bucket int, segment int")
        return self._asked(rows, asked).groupBy("field", "token").agg(F.sum("docs").alias("docs"))

    def containing(self, keys: DataFrame, field: str, key: str = "key") -> DataFrame:
        """``keys`` with doc_id of each document whose ``field`` holds the key."""
        asked = keys.select(F.lit(field).alias("field"), F.col(key).alias("token")).where("token is not null")
        return keys.join(self.lookup(asked).select(F.col("token").alias(key), "doc_id"), key)

    def _occurrences(self, names: DataFrame, field: str) -> DataFrame:
        asked = names.select(F.lit(field).alias("field"), F.explode("query").alias("token"))
        return staged(self.lookup(asked).select("token", "doc_id", "at"), "occurrences")

    def name_hits(self, names: DataFrame, field: str, name_id: str = "name_id") -> DataFrame:
        """As ``search.name_hits``: name_id, doc_id, phrase, rank."""
        return hits_among(self._occurrences(names, field), names, "doc_id", name_id)

    def name_matches(self, names: DataFrame, field: str, name_id: str = "name_id", most: int = 200) -> DataFrame:
        """As ``search.name_matches``: name_id, doc_id, phrase, rank, score."""
        return matches_among(self.name_hits(names, field, name_id), "doc_id", name_id, most)
