"""Runs of one source: the daily ingest of documents, the backfill that goes back in time, and the notice board.

A run reads snapshots and gives the next ones with a row of the runs table; it is the caller that commits them. A day that is
completed is skipped, so a second run over the same days changes nothing. ``daily`` joins them to one run with all outputs.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import merge, relational
from ..sources import gazette, notices
from ..streaming import ingest
from . import daily, dataflow
from .scratch import staged

RUN = "fecha date, tipo string, status string, total_docs long, scanned long, candidates long, created long, errors long"


@dataclass
class Run:
    documents: DataFrame
    runs: DataFrame
    skipped: DataFrame  # days that were completed before


# What a day of the gazette is reckoned to hold.
DOCUMENTS_A_DAY, CANDIDATES_A_DAY = 350, 40


def backfill_plan(days: DataFrame, most_days: int) -> DataFrame:
    """What a backfill between two days (first, last) would take: days, documents, candidates, runs."""
    n = F.datediff("last", "first") + 1
    return days.select("first", "last", n.alias("days"), (n * DOCUMENTS_A_DAY).alias("documents"), (n * CANDIDATES_A_DAY).alias("candidates"), F.greatest(F.lit(1), F.ceil(n / most_days).cast("int")).alias("runs"))


def _pending(days: DataFrame, runs: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    done = runs.where((F.col("tipo") == kind) & (F.col("status") == "completed")).select("fecha").distinct()
    return days.join(done, "fecha", "left_anti"), days.join(done, "fecha", "left_semi")


COUNTS = ("total_docs", "scanned", "candidates", "created", "errors")


def _day_counts(days: DataFrame, counted: dict[str, DataFrame], mode: str, status: Column) -> DataFrame:
    """Rows of the runs table, from rows with fecha for each count."""
    stats = days
    for name, rows in counted.items():
        stats = stats.join(rows.groupBy("fecha").agg(F.count(F.lit(1)).alias(name)), "fecha", "left")
    return stats.select("fecha", F.lit(mode).alias("tipo"), status.alias("status"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS])


def _items(payloads: DataFrame, name: str) -> DataFrame:
    """The items of payloads with an identifier, and where they stand on their day: orden, with the part of a day of several payloads first."""
    parts = payloads if "parte" in payloads.columns else payloads.withColumn("parte", F.lit(0))
    rows = gazette.flatten_summary(parts, carry=["parte"]).where(F.coalesce("identificador", F.lit("")) != "")
    return staged(rows.withColumn("orden", F.concat(F.array(F.col("parte").cast("int")), "orden")).drop("raw_item", "parte"), name)


def _once(rows: DataFrame, newest_first: bool = False) -> DataFrame:
    """Each identifier at its first place: of the earliest day, or of the latest one."""
    day = F.col("fecha_publicacion").desc() if newest_first else F.col("fecha_publicacion")
    return relational.first_of(rows, ["identificador"], [day, F.col("orden")])


def _dated(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("fecha_publicacion").alias("fecha"))


def run_days(payloads: DataFrame, texts: DataFrame, documents: DataFrame, runs: DataFrame, force: bool = False) -> Run:
    """Ingest of daily summaries.

    ``payloads``: fecha, payload (JSON), and parte where a day has several. ``texts``: identificador, texto. ``documents``: the snapshot of candidates, keyed by
    identificador; a key that is there stays as it is, but for a text that was missing. A day with a payload that cannot be read fails
    as a whole and is read again by the next run.
    """
    days = payloads.select("fecha").distinct()
    pending, skipped = (days, days.limit(0)) if force else _pending(days, runs, "daily")
    todo = payloads.join(pending, "fecha", "left_semi")
    broken = staged(daily.quarantined(todo), "broken")
    items = _items(todo.join(broken.select("fecha").distinct(), "fecha", "left_anti"), "run-items")
    found = staged(_once(dataflow.candidates(items, texts, "daily", carry=["orden"])).drop("orden"), "run-candidates")
    new = found.join(documents.select("identificador"), "identificador", "left_anti")
    filled = merge.fill_group(documents, found, ["identificador"], "texto_plano", ["texto_plano", "hash_texto", "extracto", "claves"])
    merged = merge.insert_new(filled, new.select(*documents.columns), ["identificador"])
    scanned = items.where(~rules.skipped_section(F.col("seccion_codigo")))
    counted = {"total_docs": _dated(items), "scanned": _dated(scanned), "candidates": _dated(found), "created": _dated(new), "errors": broken.select("fecha")}
    status = F.when(F.coalesce("errors", F.lit(0)) > 0, "failed").otherwise("completed")
    return Run(merged, runs.unionByName(_day_counts(pending, counted, "daily", status)), skipped)


@dataclass
class Backfill:
    index: DataFrame
    runs: DataFrame
    finished: bool  # whether all days are done
    seen: int
    indexed: int


def run_backfill(payloads: DataFrame, texts: DataFrame, index: DataFrame, runs: DataFrame, first: str, last: str, most_days: int, most_documents: int | None = None) -> Backfill:
    """The next days of a backfill from ``last`` back to ``first``, and the index with their candidates.

    The cursor is the oldest completed day of the runs table. At most ``most_days`` days and ``most_documents`` new documents are taken: documents are counted from the newest day
    back, in the order of each day. The day on which the last of them stands counts as done, and nothing after it is looked at. A day whose summary
    is missing or cannot be read counts as done too.
    """
    if first > last:
        raise ValueError(f"first day {first} after last day {last}")
    done = runs.where((F.col("tipo") == "backfill") & F.col("fecha").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).agg(F.min("fecha").alias("d")).first().d
    days = ingest.backfill_days(first, last, done.isoformat() if done else None, most_days)
    if not days or most_documents == 0:
        return Backfill(index, runs, not days, 0, 0)
    spark = payloads.sparkSession
    todo = payloads.where(F.col("fecha").isin([F.lit(d).cast("date") for d in days]))
    broken = daily.quarantined(todo)
    items = _items(todo, "backfill-items")
    by_title = staged(_once(dataflow.candidates(items, texts, "backfill", carry=["orden"]), newest_first=True), "backfill-candidates")
    new = by_title.join(index.select(F.col("doc_id").alias("identificador")), "identificador", "left_anti")
    back = F.datediff(F.lit(last).cast("date"), F.col("fecha_publicacion")).alias("back")
    end = None
    if most_documents is not None:
        # a running number over ranges, from the newest day back: the place of the last one that is taken
        placed = relational.numbered_in(new.select(F.lit(0).alias("all"), back, "orden", "identificador"), ["all"], ["back", "orden", "identificador"])
        end = placed.where(F.col("number") == most_documents).select("back", "orden").first()

    def taken(rows: DataFrame) -> DataFrame:
        return rows if end is None else rows.where((back < end.back) | ((back == end.back) & (F.col("orden") <= F.array(*[F.lit(k) for k in end.orden]))))

    if end is not None:
        last_day = datetime.date.fromisoformat(last) - datetime.timedelta(days=end.back)
        days = [d for d in days if d >= last_day.isoformat()]
    chosen, created = taken(by_title), staged(taken(new), "backfill-new")
    on_days = spark.createDataFrame([(d,) for d in days], "day string").select(F.col("day").cast("date").alias("fecha"))
    seen = taken(items)
    counted = {
        "total_docs": _dated(seen), "scanned": _dated(seen.where(~rules.skipped_section(F.col("seccion_codigo")))),
        "candidates": _dated(dataflow.classified(seen).where("title_class.candidate")), "created": _dated(created),
        "errors": broken.select("fecha"),
    }
    rows = staged(_day_counts(on_days, counted, "backfill", F.lit("completed")), "backfill-days")
    total = rows.agg(F.coalesce(F.sum("total_docs"), F.lit(0)), F.coalesce(F.sum("created"), F.lit(0))).first()
    merged = dataflow.into_index(index, dataflow.indexed(chosen).select(*index.columns))
    return Backfill(merged, runs.unionByName(rows), days[-1] == first, total[0], total[1])


def run_notices(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """The snapshot of notices with the wanted entries of index pages; blanks of known ones are filled."""
    new = notices.wanted(notices.index_entries(pages)).dropDuplicates(["identificador"])
    return merge.fill_missing(documents, new.select(*documents.columns), ["identificador"])
