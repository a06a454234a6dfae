"""Relational operators: predicates, pages, as-of lookup, best-of, numbering, gaps."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import shuffle_partitions, staged

#: A page larger than this is refused rather than sorted out of all rows.
MOST_PAGE_ROWS = 10_000


def all_of(*conditions: Column | None) -> Column:
    """The conditions that are given, all of them; none holds for every row."""
    given = [c for c in conditions if c is not None]
    return functools.reduce(lambda a, b: a & b, given) if given else F.lit(True)


def any_like(text: str | None, *columns: Column) -> Column | None:
    """Case-insensitive substring in any column; the wildcards of ``text`` stay wildcards."""
    text = (text or "").strip()
    return functools.reduce(lambda a, b: a | b, [c.ilike(f"%{text}%") for c in columns]) if text else None


def default_window(day: Column, first: Column | None, last: Column | None, today: Column, days: int = 30) -> Column:
    """Between two bounds, each optional; without either the last ``days`` days, today included."""
    if first is None and last is None:
        first, last = F.date_sub(today, days - 1), today
    return all_of(None if first is None else day >= first, None if last is None else day <= last)


def present(column: Column) -> Column:
    return F.nullif(F.trim(column), F.lit("")).isNotNull()


def between(column: Column, least: object | None, most: object | None) -> Column | None:
    """Bounds that are given; a lower bound above the upper one is refused."""
    if least is not None and most is not None and least > most:
        raise ValueError(f"lower bound {least} above upper bound {most}")
    return all_of(None if least is None else column >= least, None if most is None else column <= most) if (least, most) != (None, None) else None


def one_of(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ``ids``; ids that no row has are ignored, repeated ones count once."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def tristate(condition: Column, wanted: bool | None) -> Column | None:
    return None if wanted is None else condition if wanted else ~condition


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page counted from 1; ``order`` must end with a unique column."""
    if size > MOST_PAGE_ROWS:
        raise ValueError(f"pages hold {MOST_PAGE_ROWS} rows at most")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_envelope(df: DataFrame, size: int) -> DataFrame:
    """total and pages, 0 if there are no rows."""
    return df.agg(F.count(F.lit(1)).alias("total")).select("total", F.ceil(F.col("total") / size).alias("pages"))


def _in_ranges(df: DataFrame, by: list[str], order: list[Column | str], name: str) -> DataFrame:
    """``df`` dealt over ranges of its order, written, with the number of its range in ``_range``: a group of any size is dealt over many tasks."""
    return staged(df.repartitionByRange(shuffle_partitions(df.sparkSession), *by, *order).withColumn("_range", F.spark_partition_id()), name)


def _earlier_ranges(by: list[str]):
    return Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range


def _same(keys: list[str], other: DataFrame, df: DataFrame) -> Column:
    return functools.reduce(lambda a, b: a & b, [df[k].eqNullSafe(other[k]) for k in keys])


def as_of(rows: DataFrame, marks: DataFrame, by: list[str], at: str, values: list[str]) -> DataFrame:
    """Each row with ``values`` of the last mark strictly before it in its group; null if there is none.

    One sort of the union of both sides, in place of a join by ranges. The last mark of earlier ranges is carried over.
    """
    mark = marks.select(F.struct(*values)).schema[0].dataType
    left = rows.withColumn("_row", F.struct(*rows.columns)).withColumn("_mark", F.lit(None).cast(mark))
    right = marks.select(*by, at, F.struct(*values).alias("_mark"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    both = left.select(*by, at, "_mark", "_row").unionByName(right).withColumn("_is_mark", F.col("_row").isNull())
    # rows with the same time come before the marks of that time: only earlier marks count
    dealt = _in_ranges(both, by, [at, "_is_mark"], "as-of")
    last = dealt.where("_is_mark").groupBy(*by, "_range").agg(F.max_by("_mark", at).alias("_mark"))
    ranges = dealt.select(*by, "_range").distinct().join(last, [*by, "_range"], "left")
    carried = staged(ranges.select(*by, "_range", F.last("_mark", ignorenulls=True).over(_earlier_ranges(by)).alias("_carried")), "as-of-ranges")
    before = Window.partitionBy(*by, "_range").orderBy(F.col(at), "_is_mark").rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.withColumn("_last", F.last("_mark", ignorenulls=True).over(before)).where(~F.col("_is_mark"))
    met = found.join(carried, _same([*by, "_range"], carried, found), "left").withColumn("_last", F.coalesce("_last", "_carried"))
    return met.select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def first_of(df: DataFrame, by: list[str], order: list[Column], most: int = 1) -> DataFrame:
    """The first rows of each group in an order that ends with a unique column."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= most).drop("_rank")


def best_of(df: DataFrame, by: list[str], score: Column, order: Column) -> DataFrame:
    """For each group the row with the highest score, of equal ones the first; combined before the shuffle."""
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct((-score).alias("s"), order.alias("o"))).alias("_best"))
    return best.select(*by, "_best.*")


def numbered_in(df: DataFrame, by: list[str], order: list[Column | str], name: str = "number") -> DataFrame:
    """Numbers from 1 in each group, in an order that ends with a unique column; counted over ranges, whatever a group's size."""
    dealt = _in_ranges(df, by, order, "numbered")
    sizes = dealt.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_many"))
    starts = staged(sizes.select(*by, "_range", F.coalesce(F.sum("_many").over(_earlier_ranges(by)), F.lit(0)).alias("_start")), "numbered-ranges")
    within = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)))
    met = within.join(starts, _same([*by, "_range"], starts, within))
    return met.select(*[within[c] for c in df.columns], (F.col("_start") + F.col("_own")).alias(name))


def numbered(df: DataFrame, year: Column, order: list[Column], name: str = "number", start: DataFrame | None = None) -> DataFrame:
    """Numbers from 1 in each year; ``start`` (year, last) continues counters."""
    rows = numbered_in(df.withColumn("year", year), ["year"], order, name)
    if start is None:
        return rows
    counters = start.select(F.col("year").alias("_year"), "last")
    return rows.join(counters, F.col("year").eqNullSafe(F.col("_year")), "left").withColumn(name, F.col(name) + F.coalesce("last", F.lit(0))).drop("_year", "last")


def missing_days(done: DataFrame, day: str, first: Column, last: Column) -> DataFrame:
    """The days from first to last that do not occur in ``done``."""
    days = done.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    return days.join(done.select(F.col(day).alias("day")).distinct(), "day", "left_anti")


def last_wins(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """For each key that is present the last row in an order that ends with a unique column."""
    return first_of(rows.where(present(F.col(key))), [key], [*order])


def violations(df: DataFrame, key: list[str], checks: dict[str, Column]) -> DataFrame:
    """How many rows break each check, and how many keys occur more than once."""
    keyed = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.when(c, 0).otherwise(1)).cast("long").alias(n) for n, c in checks.items()])
    return keyed.agg(*[F.sum(n).alias(n) for n in checks], F.count_if(F.col("_n") > 1).alias("repeated_keys"))


def within(rows: DataFrame, windows: DataFrame, by: list[str], day: str, first: str = "first", last: str = "last", width: int = 90) -> DataFrame:
    """Rows joined with the windows of their key that hold their day, both bounds included; a key may have several windows.

    Windows are cut into buckets of ``width`` days that cover them, and meet rows by key and bucket: an equi-join, in which a frequent key is dealt
    over its buckets. A window without a bound holds nothing. Columns of the windows must have names of their own.
    """
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / width)
    cut = windows.where(F.col(first) <= F.col(last)).withColumn("_bucket", F.explode(F.sequence(bucket(F.col(first)), bucket(F.col(last)))))
    met = rows.withColumn("_bucket", bucket(F.col(day))).join(cut, [*by, "_bucket"])
    return met.where(F.col(day).between(F.col(first), F.col(last))).drop("_bucket")
