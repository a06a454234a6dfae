import hashlib
from collections import defaultdict

from pliegos.llm import content_sort


def plain(rows, best=max):
    def norm(t):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")

    groups = defaultdict(list)
    for k, t in rows:
        groups[norm(t)].append(k)
    return sorted((k, best(groups[norm(t)]), len(groups[norm(t)]), k == best(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for k, t in rows)


ROWS = [(i, t) for i, t in enumerate(["Same", "same", "sAME ", None, "", "É", "é", "x" * 300_000, "X" * 300_000, "a\nb", "a\nB", "\x00", "ſ", "s"], 1)]


def test_equals_grouping_in_memory(spark):
    for keep, best in (("largest", max), ("smallest", min)):
        out = content_sort.content_sort(spark.createDataFrame(ROWS, "doc_id long, text string"), keep=keep).collect()
        assert sorted(map(tuple, out)) == plain(ROWS, best)


def test_hot_group_is_dealt_and_put_together(spark):
    rows = [(i, "Copy" if i % 3 else f"own {i}") for i in range(3000)]
    out = content_sort.content_sort(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), keep="largest").collect()
    assert sorted(map(tuple, out)) == plain(rows)


def test_whole_table_equals_grouping(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, content_sort.content_sort(docs, keep="largest").collect())) == plain(rows)


def test_deduplicated_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a", "p"), (2, "A", "q"), (3, None, "r"), (3, None, "r")], "doc_id long, text string, kept_id string")
    kept = content_sort.deduplicated(docs, keep="largest")
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [(2, "A", "q"), (3, None, "r")]
