import random

import corpus_pipeline
import pytest
from pliegos.llm import near_jaccard, simhash_gray


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def plain_kept(rows):
    """The smallest id of each component, all pairs compared."""
    sets = {k: shingle_set(t) for k, t in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k for k in ids if find(k) == k}


def near_texts():
    r = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(60):
        base = [r.choice(words) for _ in range(r.choice([3, 40, 120, 300]))]
        for _ in range(r.randrange(1, 6)):
            copy = list(base)
            for _ in range(r.randrange(0, 1 + len(copy) // 40)):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy))
    return [*texts, None, "", " \t", "ONE", "one", "two words", "Ñ á b c d e"]


def test_the_stage_keeps_what_all_pairs_keep(spark):
    rows = list(enumerate(near_texts()))
    kept = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in kept.collect()} == plain_kept(rows)


def test_pairs_beyond_three_bits_are_merged(spark):
    words = [f"w{i}" for i in range(100)]
    other = ["x" if i in (30, 60) else w for i, w in enumerate(words)]
    a, b = " ".join(words), " ".join(other)
    assert bin(simhash_gray.fingerprint(a.encode()) ^ simhash_gray.fingerprint(b.encode())).count("1") > 3
    docs = spark.createDataFrame([(1, a), (2, b), (3, "other words")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == [1, 3]


def test_null_and_repeated_ids_keep_different_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(None, a), (None, b), (7, c), (7, a + " z"), (7, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_jaccard.deduplicated(docs).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, b), (7, c), (7, a + " z")])


@pytest.mark.parametrize(("whole", "common", "nodes"), [(2, 4, 1 << 20), (1, 0, 0)])
def test_buckets_of_any_size_are_compared_to_the_end(spark, monkeypatch, whole, common, nodes):
    """Families of many texts that share most of their words but are apart, and chains of near copies in them."""
    monkeypatch.setattr(near_jaccard, "WHOLE", whole)
    monkeypatch.setattr(near_jaccard, "COMMON", common)
    monkeypatch.setattr(near_jaccard, "BROADCAST_NODES", nodes)
    r = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(3):
        base = [r.choice(words) for _ in range(100)]
        for _ in range(12):
            member = base[:70] + [r.choice(words) for _ in range(30)]
            for _ in range(3):
                texts.append(" ".join(member))
                member = list(member)
                member[r.randrange(100)] = r.choice(words)
    rows = list(enumerate(texts))
    kept = near_jaccard.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id for x in kept.collect()} == plain_kept(rows)


def test_signatures_of_near_texts_agree():
    r = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    near, far = [], []
    for _ in range(300):
        a = [r.choice(words) for _ in range(200)]
        b, c = list(a), a[:80] + [r.choice(words) for _ in range(120)]
        for _ in range(4):
            b[r.randrange(200)] = "x"
        sets = [near_jaccard.shingles(" ".join(t).encode()) for t in (a, b, c)]
        marks = [near_jaccard.signature(near_jaccard.minima(s)) for s in sets]
        differ = [sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(marks[0], m)) for m in marks[1:]]
        if len(set(sets[0]) & set(sets[1])) * 5 >= 4 * len(set(sets[0]) | set(sets[1])):
            near.append(differ[0])
        far.append(differ[1])
    assert len(near) > 100 and max(near) <= near_jaccard.MOST_DIFFER and sum(d <= near_jaccard.MOST_DIFFER for d in far) < 60


def test_texts_of_a_family_that_differ_too_much_are_never_pairs(spark, monkeypatch):
    """Texts with three words of their own, of which no two are near, and some near the middle of the family: what is verified grows with the texts, not with their pairs."""
    monkeypatch.setattr(near_jaccard, "WHOLE", 4)
    verified, plain = [], near_jaccard._verified
    monkeypatch.setattr(near_jaccard, "_verified", lambda pairs, sets: (verified.append(pairs.count()), plain(pairs, sets))[1])
    base = [f"w{i}" for i in range(100)]
    texts = []
    for k in range(160):
        own = (10, 40, 70) if k % 4 else (50,)
        texts.append(" ".join(f"own{k}x{i}" if i in own else w for i, w in enumerate(base)))
    rows = list(enumerate(texts))
    kept = near_jaccard.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id for x in kept.collect()} == plain_kept(rows) == {0, *(k for k in range(160) if k % 4)}
    assert sum(verified) < 10 * len(texts)
