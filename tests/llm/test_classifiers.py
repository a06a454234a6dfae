"""op1 and op9 on labelled rows that were held out from learning."""

import math
import re
import zlib

import pytest
from pliegos.llm import labelled, queries, rule_ensemble, toxicity_mil
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def held_out_accuracy(spark, query, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").groupBy("doc_id").agg(F.max(label).alias("label"))
    rows = query(spark, SF).where("held_out").join(labels.where("label is not null"), "doc_id").collect()
    pos = [r.score for r in rows if r.label == 1]
    neg = [r.score for r in rows if r.label == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    return sum(r.predicted == r.label for r in rows) / len(rows), auc


def test_quality_on_held_out_rows(spark):
    accuracy, auc = held_out_accuracy(spark, queries.op9_rule_ensemble, "quality")
    assert accuracy > 0.85 and auc > 0.9, (accuracy, auc)


def test_toxicity_on_held_out_rows(spark):
    accuracy, auc = held_out_accuracy(spark, queries.op1_toxicity_mil, "toxic")
    assert accuracy > 0.9 and auc > 0.9, (accuracy, auc)


def test_held_out_is_the_crc_of_the_id(spark):
    rows = spark.range(200).select("id", labelled.held_out(F.col("id"), 3, 1).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


def test_held_out_labels_are_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = labelled.training_rows(labels, "quality", 5, 0, 10**6).collect()
    assert known and all(zlib.crc32(str(r.train_id).encode()) % 5 != 0 for r in known)
    hidden = labels.withColumn("quality", F.when(labelled.held_out(F.col("doc_id"), 5, 0), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = rule_ensemble.train(docs, labels), rule_ensemble.train(docs, hidden)
    assert a == b and a.weights


@pytest.mark.parametrize("share", [0, 1])
def test_one_label_only(spark, share):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, share, share) for k in range(20)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in rule_ensemble.classify(docs, labels).collect()} == {share}
    assert {r.score for r in toxicity_mil.classify(docs, labels).collect()} == {0.0}


def test_rules_compiled_to_columns_equal_rules_on_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    model = rule_ensemble.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    for r in rule_ensemble.scored(docs, model).select("text", "score").collect():
        x = dict(zip(rule_ensemble.STATISTICS, rule_ensemble.text_statistics(r.text)))
        z = model.bias + sum(w for rule, w in model.weights.items() if all((x[n] > t) == above for n, above, t in rule))
        assert r.score == pytest.approx(1 / (1 + 2.718281828459045 ** -z), abs=1e-9)


def test_the_offending_sentence_is_located(spark):
    good = ["the river runs slowly to the sea", "we planted trees in the garden", "a train leaves at noon"]
    rows, marks = [], []
    for k in range(120):
        bad = k % 2
        text = ". ".join(good[(k + i) % 3] for i in range(3)) + ("! you vile grubnak scum" if bad else "") + ". " + good[k % 3]
        rows.append((k, text))
        marks.append((k, bad))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity_mil.train(docs, labels)
    found = toxicity_mil.offending_sentences(docs, model).collect()
    assert {r.doc_id for r in found} == {k for k, bad in marks if bad}
    assert all("grubnak" in r.sentence for r in found)
    # a document's score is the noisy-or of its sentences
    weights = model.word_weights()
    clean = 1.0
    for _, _, p in model.sentences(rows[1][1], weights):
        clean *= 1 - p
    assert model.document(rows[1][1], weights)[0] == pytest.approx(1 - clean)


def test_document_scores_are_the_noisy_or_of_their_sentences(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity_mil.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert model.weights
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity_mil.scored(docs, model).collect():
        clean, worst = 1.0, None
        for sentence in re.split(r"[.!?\n]", texts[r.doc_id] or ""):
            words = set(re.findall(r"[^\W_]+", sentence.lower()))
            if words:
                z = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in [w, *(w[:n] + "-" for n in (3, 4, 5, 6) if len(w) > n)])
                p = 1 / (1 + math.exp(-z))
                clean, worst = clean * (1 - p), p if worst is None else max(worst, p)
        assert r.score == pytest.approx(1 - clean, abs=1e-9) and (r.worst_score is None) == (worst is None)
        assert worst is None or r.worst_score == pytest.approx(worst, abs=1e-12)


def test_repeated_ids_do_not_depend_on_the_order_of_files(spark):
    rows = [(k % 40, f"text {k} " + ("grubnak " if k % 2 else "river ") * (1 + k % 3)) for k in range(120)]
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    a, b = (spark.createDataFrame(r, "doc_id long, text string").coalesce(1) for r in (rows, rows[::-1]))
    assert toxicity_mil.train(a, labels) == toxicity_mil.train(b, labels)
    assert rule_ensemble.train(a, labels) == rule_ensemble.train(b, labels)
