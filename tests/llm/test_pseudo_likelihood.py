import math
from collections import Counter

import numpy as np
import pytest
from pliegos.llm import pseudo_likelihood as pl


def plain_scores(texts, model, totals):
    """Log-probabilities of all tokens of each text, by scalar loops over the network."""
    network, out = model.network, []
    for text in texts:
        words = pl.tokens(text)
        hashes = [pl.word_hash(w) for w in words]
        own = []
        for i, h in enumerate(hashes):
            hidden = []
            for d in pl.OFFSETS:
                bucket = hashes[i + d] % pl.BUCKETS if 0 <= i + d < len(hashes) else pl.BUCKETS
                hidden += [math.tanh(x) for x in network.embedding[bucket].tolist()]
            logits = [network.output[-1][c] + sum(x * network.output[j][c] for j, x in enumerate(hidden)) for c in range(pl.CLASSES)]
            top = max(logits)
            norm = top + math.log(sum(math.exp(z - top) for z in logits))
            cluster, total = model.cluster[h % pl.BUCKETS], totals.get(h, pl.UNSEEN)
            c = cluster * pl.BANDS + model.band[cluster, math.floor(pl.STEPS * math.log2(max(total, 1)))]
            own.append(logits[c] - norm + math.log(total) - model.log_mass[c])
        out.append(own)
    return out


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)


@pytest.fixture(scope="module")
def trained(documents):
    return pl.train(documents)


def test_counts_are_those_of_words_and_scores_those_of_scalar_loops(spark, documents, trained):
    texts = {r.doc_id: r.text for r in documents.collect()}
    counts = Counter()
    for t in texts.values():
        counts.update(pl.tokens(t))
    totals = {r["hash"] % 2**64: r.total for r in trained.totals.collect()}
    assert totals == {pl.word_hash(w): n for w, n in counts.items()}
    few = sorted(texts, key=lambda k: len(texts[k] or ""))[:60:6]
    rows = {r.doc_id: r for r in pl.score(documents, trained).collect()}
    assert set(rows) == set(texts) and sum(r.n_tokens for r in rows.values()) == sum(counts.values())
    for k, want in zip(few, plain_scores([texts[k] for k in few], trained.model, totals), strict=True):
        assert rows[k].n_tokens == len(want)
        assert math.isclose(rows[k].log_probability, sum(want), rel_tol=1e-4, abs_tol=1e-3)
    unseen = spark.createDataFrame([(1, "Xyzzyq plughhh, of the xyzzyq")], "doc_id long, text string")
    want = plain_scores(["Xyzzyq plughhh, of the xyzzyq"], trained.model, totals)[0]
    assert math.isclose(pl.score(unseen, trained).first().log_probability, sum(want), rel_tol=1e-4)


def test_held_out_documents_score_better_than_by_frequencies(spark):
    """Trained on nine tenths of the larger table, the rest gains 0.5 nats a token over the frequencies of words."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    learned, held = docs.where("doc_id % 10 <> 0").repartition(4), docs.where("doc_id % 10 = 0")
    trained = pl.train(learned)
    totals = {r["hash"] % 2**64: r.total for r in trained.totals.collect()}
    whole = sum(totals.values()) + pl.UNSEEN
    rows = pl.score(held, trained).collect()
    n = sum(r.n_tokens for r in rows)
    frequency = sum(math.log(totals.get(pl.word_hash(w), pl.UNSEEN) / whole) for r in held.collect() for w in pl.tokens(r.text))
    assert sum(r.log_probability for r in rows) / n > frequency / n + 0.5


def test_probabilities_of_all_words_sum_to_one(trained):
    words = np.array([r["hash"] for r in trained.totals.collect()], "i8").view("u8")
    totals = np.array([r.total for r in trained.totals.collect()], "f8")
    _, own, log_share = trained.model.placed(words, totals)
    of_class = np.bincount(own, np.exp(log_share), pl.CLASSES)
    lowest = {c * pl.BANDS + trained.model.band[c, 0] for c in range(pl.CLUSTERS)}
    mass = np.exp(trained.model.log_mass)
    for c in np.flatnonzero(np.bincount(own, minlength=pl.CLASSES)):
        assert math.isclose(of_class[c], 1 - (pl.UNSEEN / mass[c] if c in lowest else 0), rel_tol=1e-6)
    z = trained.model.network.logits(np.tanh(trained.model.network.embedding[[[1, 2, 3, 4]]].reshape(1, -1)))
    assert math.isclose(float((np.exp(z) / np.exp(z).sum()).sum()), 1, rel_tol=1e-5)


def test_a_document_that_occurs_twice_scores_higher_than_one_that_occurs_once(spark):
    rows = [(k, " ".join(f"w{(k * 31 + j * j) % 89}" for j in range(40))) for k in range(300)]
    rare = [" ".join(f"{a}{j}zq" for j in range(30)) for a in ("once", "twice")]
    docs = spark.createDataFrame([*rows, (1000, rare[0]), (1001, rare[1]), (1002, rare[1])], "doc_id long, text string").repartition(3)
    scores = {r.doc_id: r.mean_log_probability for r in pl.train_and_score(docs).where("doc_id >= 1000").collect()}
    assert scores[1001] > scores[1000] and math.isclose(scores[1001], scores[1002], rel_tol=1e-5)


def test_every_token_is_a_target_once():
    sizes = np.array([3, 0, 1, 5], "u4")
    numbers = np.arange(9)
    places = pl._edged(sizes, pl.SIDE)
    row = pl._row(numbers, places, sizes, pl.SIDE, pl.BUCKETS)
    assert row[places].tolist() == numbers.tolist()
    assert sorted(i for r in range(pl.ROUNDS) for i in row[places[r :: pl.ROUNDS]].tolist()) == numbers.tolist()
    ends = np.flatnonzero(row == pl.BUCKETS)
    assert len(ends) == pl.SIDE * (len(sizes) + 1)


def test_training_does_not_depend_on_the_run(spark):
    docs = spark.createDataFrame([(k, f"a b c {k % 7} d e") for k in range(500)], "doc_id long, text string").coalesce(1)
    a, b = pl.train(docs), pl.train(docs)
    assert np.array_equal(a.model.network.flat(), b.model.network.flat())
