"""From raw documents to packed training sequences, in five stages.

Each stage takes ``docs`` with any columns and carries them as they are; names that its operator uses inside do not clash with them. Null texts
count as empty, very long texts are read whole, and an empty table gives an empty one. What a stage does with null or repeated ids, ties and
repeated rows is said at its function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pliegos.llm import content_sort, decontaminate, near_jaccard, packing, queries, rule_ensemble
from pliegos.llm.staging import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects. Each row is judged by its own text: equal rows share their fate, and null ids are judged too."""
    model = rule_ensemble.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rule_ensemble.accepted(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; null ids are the smallest, and of rows with one id and one text one stays."""
    return content_sort.deduplicated(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by exact similarity of five-word shingles, the document with the smallest id; null ids are the largest, and of rows with one id the smaller hash of the text stays."""
    return near_jaccard.deduplicated(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold passages of benchmark items. Each row is judged by its own text, whatever its id."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences; repeated rows and null ids are packed like any others."""
    return packing.pack(docs, queries.tokenizer_file(), queries.END_ID)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("benchmark decontamination", benchmark),
    ("packing", pack),
]

#: The last stage's token ids come from a tokenizer file, which SQL does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
