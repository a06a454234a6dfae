"""Idempotent keyed merges over snapshots.

There is no MERGE on plain Parquet: a merge reads the old snapshot and the new rows and returns the
next snapshot, which ``streaming.ingest.Snapshots`` writes beside the old one. Running a merge again with the
same rows gives the same snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import staged

#: So many keys of differing rows are broadcast at most.
FEW_CHANGES = 200_000


def _both(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*rest).alias("o"))
    b = new.select(*keys, F.struct(*rest).alias("n"))
    return a.join(b, keys, "full_outer")


def fill_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old values stay; null and blank ones are filled from the new row. New keys are added."""

    def merged(c: str) -> Column:
        kept = F.col(f"o.{c}")
        if dict(old.dtypes)[c] == "string":
            kept = F.nullif(kept, F.lit(""))
        return F.coalesce(kept, F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)

    rows = _both(old, new, keys).select(*keys, *[merged(c) for c in old.columns if c not in keys])
    return rows.select(*old.columns)


def union_merge(old: DataFrame, new: DataFrame, keys: list[str], arrays: list[str], text: str, separator: str, fill: list[str]) -> DataFrame:
    """Arrays grow by new elements in order; ``text`` is extended unless it already holds the new one;
    ``fill`` columns are filled when null or blank; all other columns keep their old value."""
    none = F.array().cast("array<string>")

    def merged(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in arrays:
            return F.array_distinct(F.concat(F.coalesce(o, none), F.coalesce(n, none))).alias(c)
        if c == text:
            ends = F.coalesce(n, F.lit("")) == ""
            return F.when(F.coalesce(o, F.lit("")) == "", n).when(ends | (F.instr(o, n) > 0), o).otherwise(F.concat(o, F.lit(separator), n)).alias(c)
        if c in fill:
            return F.coalesce(F.nullif(o, F.lit("")), n, o).alias(c)
        return F.when(F.col("o").isNull(), n).otherwise(o).alias(c)

    return _both(old, new, keys).select(*keys, *[merged(c) for c in old.columns if c not in keys]).select(*old.columns)


def max_merge(old: DataFrame, new: DataFrame, keys: list[str], score: str, with_score: list[str], labels: str) -> DataFrame:
    """The higher score and its columns replace lower ones; ``labels`` become the sorted union;
    all other columns keep their old value. Adds ``created``: whether the key is new."""
    none = F.array().cast("array<string>")
    better = F.col("o").isNull() | (F.col(f"n.{score}") > F.col(f"o.{score}"))
    better = F.coalesce(better & F.col("n").isNotNull(), F.lit(False))

    def merged(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == labels:
            return F.array_sort(F.array_union(F.coalesce(o, none), F.coalesce(n, none))).alias(c)
        if c == score or c in with_score:
            return F.when(better, n).otherwise(o).alias(c)
        return F.when(F.col("o").isNull(), n).otherwise(o).alias(c)

    rows = _both(old, new, keys).select(*keys, *[merged(c) for c in old.columns if c not in keys], F.col("o").isNull().alias("created"))
    return rows.select(*old.columns, "created")


def patched(old: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """Partial update: ``patches`` has the keys and ``changes``, a map from column to new text; absent columns stay, null clears."""
    joined = old.join(patches.select(*keys, "changes"), keys, "left")

    def value(c: str, kind: str) -> Column:
        return F.when(F.coalesce(F.map_contains_key("changes", F.lit(c)), F.lit(False)), F.col("changes")[c].cast(kind)).otherwise(F.col(c)).alias(c)

    return joined.select(*[F.col(c) if c in keys else value(c, t) for c, t in old.dtypes])


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` with other keys, each key once."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def fill_group(old: DataFrame, new: DataFrame, keys: list[str], first: str, columns: list[str]) -> DataFrame:
    """``old`` with all ``columns`` from the new row of its key where ``first`` is blank and the new one is not; no keys are added."""
    given = new.where(F.coalesce(F.trim(first), F.lit("")) != "").dropDuplicates(keys).select(*keys, F.struct(*columns).alias("_new"))
    met = old.join(given, keys, "left")
    fills = F.col("_new").isNotNull() & (F.coalesce(F.trim(first), F.lit("")) == "")
    return met.select(*[F.when(fills, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def deleted(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, reference: str) -> tuple[DataFrame, DataFrame]:
    """Parents without the keys in ``gone``, and children with references to them set to null."""
    ids = gone.select(F.col(key)).distinct()
    kept = parents.join(ids, key, "left_anti")
    marked = children.join(ids.select(F.col(key).alias("_gone")), F.col(reference) == F.col("_gone"), "left")
    loose = marked.withColumn(reference, F.when(F.col("_gone").isNull(), F.col(reference))).drop("_gone")
    return kept, loose


def _marked(df: DataFrame, keys: list[str], rest: list[str], name: str) -> DataFrame:
    """Keys and two hashes of the other columns; which of them are null counts as well."""
    told = [F.coalesce(F.to_json(F.struct(F.col(c))), F.lit("")) if t.startswith("map") else F.col(c) for c, t in df.dtypes if c in rest]
    nulls = [F.col(c).isNull() for c in rest]
    return df.select(*keys, F.struct(F.xxhash64(*told, *nulls).alias("a"), F.xxhash64(F.lit(1), *told, *nulls).alias("b")).alias(name))


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What differs between two snapshots with non-null, unique ``keys``: the keys, kind (inserted, changed, removed), columns, before, after.

    Snapshots are compared by hashes of their rows; only rows that differ are then read whole. ``columns`` names the columns that differ, for ``changed``.
    """
    rest = [c for c in old.columns if c not in keys]
    met = _marked(old, keys, rest, "h_old").join(_marked(new, keys, rest, "h_new"), keys, "full_outer").where(~F.col("h_old").eqNullSafe(F.col("h_new")))
    kind = F.when(F.col("h_old").isNull(), "inserted").when(F.col("h_new").isNull(), "removed").otherwise("changed")
    differ = staged(met.select(*keys, kind.alias("kind")), "differing-keys")
    few = differ.limit(FEW_CHANGES + 1).count() <= FEW_CHANGES

    def rows(df: DataFrame, name: str) -> DataFrame:
        kept = df.join(F.broadcast(differ.select(*keys)) if few else differ.select(*keys), keys, "left_semi")
        return kept.select(*keys, F.struct(*rest).alias(name))

    both = differ.join(rows(old, "before"), keys, "left").join(rows(new, "after"), keys, "left")
    names = F.array_compact(F.array(*[F.when((F.col("kind") == "changed") & ~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), F.lit(c)) for c in rest]))
    return both.select(*keys, "kind", names.alias("columns"), "before", "after")


def audited(audit: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``audit`` with a row for each change that it does not have yet: audit_id, the keys as text, kind, columns, before and after as JSON.

    A change is told by its keys and both sides, so that the same pair of snapshots adds nothing again.
    """
    before, after = (F.to_json(c, {"ignoreNullFields": "false"}) for c in ("before", "after"))
    key = F.to_json(F.struct(*keys))
    rows = found.select(F.sha2(F.concat_ws("\u001f", key, "kind", F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))), 256).alias("audit_id"), key.alias("key"), "kind", "columns", before.alias("before"), after.alias("after"))
    return insert_new(audit, rows, ["audit_id"])


AUDIT = "audit_id string, key string, kind string, columns array<string>, before string, after string"


def counted(counts: DataFrame, found: DataFrame, by: dict[str, str]) -> DataFrame:
    """``counts`` (the names of ``by``, n) after changes: rows that came count up, rows that went count down, and groups without rows go.

    ``by``: for each name a column of the rows, as SQL over their columns. Only the changes and the counts are read.
    """
    came = found.where("after is not null").select("after.*", F.lit(1).cast("long").alias("_n"))
    went = found.where("before is not null").select("before.*", F.lit(-1).cast("long").alias("_n"))
    delta = came.unionByName(went).groupBy(*[F.expr(c).alias(n) for n, c in by.items()]).agg(F.sum("_n").alias("n"))
    return counts.unionByName(delta.select(*counts.columns)).groupBy(*by).agg(F.sum("n").alias("n")).where("n <> 0")
