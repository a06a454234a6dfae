import random

import numpy as np
import xxhash
from pliegos.llm import simhash_gray
from pyspark.sql import functions as F


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """From {id: fingerprint} to {id: smallest id reachable}, all pairs compared."""
    root = {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


def near_texts(seed=5):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 30, 150, 400]))]
        for _ in range(r.randrange(1, 6)):
            copy = list(base)
            for _ in range(r.randrange(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(" ".join(copy))
    return [*texts, None, "", "  \t", "ONE", "one", "Two\x0bwords", "two words", "ñ Á b c d"]


def test_fingerprints_and_components_equal_all_pairs(spark):
    texts = near_texts()
    rows = list(enumerate(texts, 10))
    out = {r.doc_id: r for r in simhash_gray.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = {k: plain_fingerprint(t) for k, t in rows}
    assert {k: r.fingerprint for k, r in out.items()} == {k: f"{v:016x}" for k, v in fps.items()}
    assert {k: r.component_id for k, r in out.items()} == plain_components(fps)


def test_whole_table_equals_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs.select("doc_id", "text").collect()}
    out = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_gray.near_duplicates(docs).collect()}
    roots = plain_components(fps)
    assert out == {k: (f"{v:016x}", roots[k]) for k, v in fps.items()}


def test_crowded_nodes_are_divided_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash_gray, "CELL", 8)
    monkeypatch.setattr(simhash_gray, "CROWD", 16)
    r = random.Random(3)
    bases = [r.getrandbits(64) for _ in range(6)]
    fps = set()
    for base in bases:
        for _ in range(120):
            x = base
            for _ in range(r.randrange(0, 7)):
                x ^= 1 << r.randrange(40)
            fps.add(x)
    ids = dict(enumerate(sorted(fps)))
    table = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in ids.values()], "fp long")
    pairs = simhash_gray.links(table).collect()
    unsigned = {v: k for k, v in ids.items()}
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p in pairs:
        x, y = find(unsigned[p.a % 2**64]), find(unsigned[p.b % 2**64])
        root[max(x, y)] = min(x, y)
    assert {k: find(k) for k in ids} == plain_components(ids)


def test_the_tree_decides_the_links_of_documents_and_drops_groups(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/documents.parquet")
    ranked = simhash_gray.fingerprints(docs).select("fp").distinct().orderBy(simhash_gray.gray_rank(F.col("fp"))).collect()
    fps = np.array([r.fp for r in ranked], "i8").view("u8")
    trace = []
    parent = simhash_gray.linked(fps, trace=trace)
    n = len(fps)
    assert max(level for level, _, _ in trace) >= 2
    assert any(kept < pairs for level, pairs, kept in trace if level > 0)
    assert sum(pairs for level, pairs, _ in trace if level == 0) < n * (n - 1) // 2  # the rest was dropped in groups
    near = [(i, i + int(j)) for i in range(n) for j in np.flatnonzero(np.bitwise_count(fps[i:] ^ fps[i]) <= 3)[1:]]
    root = list(range(n))
    for i, j in near:
        a, b = i, j
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    for k in range(n):
        root[k] = root[root[k]]
    assert near and parent.tolist() == root


def test_a_crowd_of_near_copies_equals_all_pairs():
    r = random.Random(2)
    fps = sorted({sum(1 << b for b in range(64) if r.random() < 0.04) for _ in range(900)})
    fps.sort(key=_rank)
    parent = simhash_gray.linked(np.array(fps, "u8"))
    roots = plain_components(dict(enumerate(fps)))
    assert parent.tolist() == [roots[k] for k in range(len(fps))]


def _rank(code):
    for shift in (1, 2, 4, 8, 16, 32):
        code ^= code >> shift
    return code


def test_masks_fix_one_of_four_blocks_on_each_level():
    for widths in ((6,), (16, 12), (16, 12, 9, 6, 5)):
        fixed = simhash_gray.masks(widths)
        assert len(fixed) == 4 ** len(widths) and {m.bit_count() for m in fixed} == {sum(widths)}
    r = random.Random(1)
    for _ in range(300):
        difference = sum(1 << b for b in r.sample(range(64), 3))
        assert any(difference & m == 0 for m in simhash_gray.masks((13, 9)))


def test_deduplicated_keeps_other_texts_of_one_id_and_of_no_id(spark):
    rows = [(1, "a b c d e"), (1, "quite another text of words"), (1, "a b c d e"), (None, "third text with no id"), (None, "fourth text and no id at all")]
    kept = simhash_gray.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in kept) == sorted({t for _, t in rows})


def test_deduplicated_keeps_one_document_of_each_component_with_all_columns(spark):
    rows = [(3, "a b c d", "x", 1), (1, "A b c D", "y", 2), (2, "other words entirely here", None, 3), (4, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, kept_id int")
    kept = simhash_gray.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]


def test_gray_rank_orders_neighbours(spark):
    codes = [i ^ (i >> 1) for i in range(64)]
    ranked = spark.createDataFrame([(c,) for c in codes], "fp long").orderBy(simhash_gray.gray_rank(F.col("fp"))).collect()
    assert [r.fp for r in ranked] == codes
