import numpy as np
from pliegos.llm import pseudo_likelihood as pl


def test_tokens_after_the_first_of_short_texts_are_learned(spark):
    text = "one two three four five six"
    docs = spark.createDataFrame([(k, text) for k in range(20_000)], "doc_id long, text string").coalesce(1)
    first = pl.train_and_score(docs).first()
    assert first.n_tokens == 6 and first.mean_log_probability > np.log(1 / 6)


def test_scoring_the_staged_tokens_equals_scoring_the_texts(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (None, "ñ _ x")], "doc_id long, text string").coalesce(1)
    a, b = (sorted(map(str, df.collect())) for df in (pl.train_and_score(docs), pl.score(docs, pl.train(docs))))
    assert a == b
