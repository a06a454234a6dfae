"""Token counts against the library on whole texts."""

import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pliegos.llm import queries, token_counts
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


def test_counts_equal_the_library(spark, library):
    sf_dir = "/root/testdata/sf0.01"
    table = pq.read_table(f"{sf_dir}/documents.parquet").to_pandas()
    got = {r.doc_id: r for r in queries.QUERIES["op13_token_counts"](spark, sf_dir).collect()}
    assert len(got) == len(table)
    for doc_id, text in zip(table.doc_id, table.text):
        n = len(library.encode(text or ""))
        assert (got[doc_id].n_tokens, got[doc_id].n_bytes, got[doc_id].over_limit) == (n, len((text or "").encode()), n > 4096)


def test_any_mix_of_blanks_and_signs(library):
    rng = random.Random(3)
    lengths = token_counts.Lengths(MODEL, {})
    parts = [" ", "  ", "   ", "\n", "\n\n", "▁", "a", "b", "the", "<s>", "</s>", "é", "\t", "\r\n", "\x00", "🙂", "ﬁ", "\xa0", "ab", "123", ".", "<0x0A>"]
    for _ in range(30_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert sum(lengths[k] for k in token_counts.pretokens(text)) == len(library.encode(text)), repr(text)


def test_full_caches_change_nothing(monkeypatch, library):
    monkeypatch.setattr(token_counts, "KEPT", 3)
    lengths = token_counts.Lengths(MODEL, {"the": 1})
    text = "the cat\nsat  on the\n\nmat " * 20
    assert sum(lengths[k] for k in token_counts.pretokens(text)) == len(library.encode(text)) and len(lengths) == 4


def test_odd_rows(spark, library):
    long = "pre-token\n  " * 50_000
    texts = [(1, None), (2, ""), (3, " "), (4, "  \n\t "), (5, long), (6, "tie"), (6, "tie"), (None, "no id"), (7, "Ünḯ 🙂 \x00 <s>"), (8, "x" * 100_000)]
    docs = spark.createDataFrame([(*r, 5, "k", 1) for r in texts], "doc_id long, text string, n_bytes int, keys string, id int").repartition(3)
    rows = token_counts.token_counts(docs, MODEL, limit=100)
    assert rows.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(k, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 100) for k, t in texts]
    order = lambda r: (r[0] or 0, r[1])
    assert sorted(map(tuple, rows.collect()), key=order) == sorted(want, key=order)
    assert token_counts.token_counts(docs.limit(0), MODEL).collect() == []


def test_summaries_of_any_size_give_the_same_counts(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(6)
    want = sorted(map(tuple, token_counts.token_counts(docs, MODEL).collect()))
    monkeypatch.setattr(token_counts, "COUNTED", 50)
    assert len(token_counts.frequent(docs.select("text"), MODEL, 20)) <= 20
    assert sorted(map(tuple, token_counts.token_counts(docs, MODEL).collect())) == want


def test_a_file_of_the_other_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "some text <|endoftext|> here"), (2, None)], "doc_id long, text string")
    tokenizer = Tokenizer.from_file(path)
    want = [(1, 28, len(tokenizer.encode("some text <|endoftext|> here", add_special_tokens=False).ids), False), (2, 0, 0, False)]
    assert sorted(map(tuple, token_counts.token_counts(docs, path).collect())) == want
