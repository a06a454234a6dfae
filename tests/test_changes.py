"""Changes of snapshots, windows of days, and keyed state on small cases."""

import datetime

import pytest
from pliegos.operators import merge, relational
from pliegos.sources import gazette
from pliegos.streaming import cache


def day(n):
    return datetime.date(2026, 1, 1) + datetime.timedelta(days=n)


SHAPE = "k int, a string, b string, n long"


def test_changes_tell_nulls_from_other_places(spark):
    old = spark.createDataFrame([(1, None, "x", 1), (2, "x", None, 1), (3, "s", "s", 1), (4, None, None, None)], SHAPE)
    new = spark.createDataFrame([(1, "x", None, 1), (2, "x", None, 1), (3, "s", "t", 2), (5, "n", None, None)], SHAPE)
    found = {r.k: r for r in merge.changes(old, new, ["k"]).collect()}
    assert {k: (r.kind, r.columns) for k, r in found.items()} == {1: ("changed", ["a", "b"]), 3: ("changed", ["b", "n"]), 4: ("removed", []), 5: ("inserted", [])}
    assert found[5].before is None and found[5].after.a == "n" and found[4].after is None and found[3].before.b == "s"
    assert merge.changes(old, old, ["k"]).count() == 0


def test_audit_rows_are_written_once_and_again_for_another_change(spark):
    old, new = spark.createDataFrame([(1, "x", None, 1)], SHAPE), spark.createDataFrame([(1, "y", None, 1)], SHAPE)
    audit = spark.createDataFrame([], merge.AUDIT)
    for _ in range(2):
        audit = spark.createDataFrame(merge.audited(audit, merge.changes(old, new, ["k"]), ["k"]).collect(), merge.AUDIT)
    assert [(r.key, r.kind, r.columns, r.before) for r in audit.collect()] == [('{"k":1}', "changed", ["a"], '{"a":"x","b":null,"n":1}')]
    assert merge.audited(audit, merge.changes(new, old, ["k"]), ["k"]).count() == 2


def test_counts_follow_rows_that_come_change_and_go(spark):
    old = spark.createDataFrame([(1, "x", "p", 1), (2, "x", "p", 1), (3, None, "p", 1)], SHAPE)
    new = spark.createDataFrame([(1, "y", "p", 1), (4, "x", "p", 1), (5, "x", "q", 1)], SHAPE)
    counts = spark.createDataFrame([], "a string, b string, n long")
    for before, after in ((old.limit(0), old), (old, new)):
        counts = spark.createDataFrame(merge.counted(counts, merge.changes(before, after, ["k"]), {"a": "a", "b": "b"}).collect(), counts.schema)
    assert sorted(map(tuple, counts.collect())) == [("x", "p", 1), ("x", "q", 1), ("y", "p", 1)]


@pytest.mark.parametrize("width", [1, 7, 90])
def test_windows_hold_both_bounds_and_may_overlap(spark, width):
    rows = spark.createDataFrame([("a", day(d)) for d in range(0, 200, 3)] + [("b", day(5)), ("c", None), (None, day(5))], "key string, at date")
    spans = [("a", 0, 30), ("a", 12, 12), ("a", 31, 20), ("a", 100, 190), ("b", 6, 9), ("b", 5, 5), ("a", None, 9)]
    windows = spark.createDataFrame([(k, None if x is None else day(x), day(y)) for k, x, y in spans], "key string, first date, last date")
    got = sorted((r.key, r.at, r.first) for r in relational.within(rows, windows, ["key"], "at", width=width).collect())
    want = sorted((k, d, day(x)) for k, d in [(r.key, r.at) for r in rows.collect()] for w, x, y in spans if k == w and x is not None and d is not None and day(x) <= d <= day(y))
    assert got == want and len(got) > 30


def test_answers_expire_over_several_batches(spark, tmp_path):
    def at(hours):
        return datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=hours)

    batches = [
        [("k", at(0), 1, None), ("k", at(1), 2, "A"), ("k", at(2), 3, None), (None, at(2), 4, None)],
        [("k", at(25), 5, None), ("k", at(26), 6, None), ("m", at(26), 7, "M"), ("m", at(27), 8, "N"), ("m", at(50), 9, None)],
        [("k", at(60), 10, "B"), ("k", at(60), 11, ""), ("m", at(60), 12, None), ("z", at(100), 13, None)],
    ]
    shape = "key string, at timestamp, ord long, answer string"
    for rows in batches:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        found = cache.run_available(cache.outcomes(stream, 1), f"file://{tmp_path}/out")
    got = sorted((r.ord, r.outcome, r.answer) for r in found.collect())
    assert got == [
        (1, "miss", None), (2, "expired", "A"), (3, "hit", "A"), (5, "hit", "A"), (6, "miss", None), (8, "expired", "N"), (9, "hit", "N"), (10, "expired", "B"), (11, "hit", "B"), (12, "miss", None), (13, "miss", None),
    ]


def test_connectors_tell_why_they_are_unavailable():
    assert gazette.available("fixture") == (True, "")
    assert [gazette.available(*a)[0] for a in (("nobody",), (None,), ("fixture", False))] == [False, False, False]
