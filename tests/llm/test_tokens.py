"""op6 and op8 against the tokenizer library itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
from pliegos.llm import packing, queries, token_orc
from pliegos.llm.tokens import encoder
from tokenizers import Tokenizer

TEXTS = [None, "", " ", "Hello, World's 123 ¿qué? é İstanbul ﬁ 漢字 emoji 🙂", "<|endoftext|> x", "a" * 50_000, "don't \x00 ​ \x85 x\tb\r\nc", "ßſK"]


def ids_of(texts):
    t = Tokenizer.from_file(queries.tokenizer_file())
    return [np.array([*e.ids, 2], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_encoder_equals_the_library(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + TEXTS
    own = encoder(queries.tokenizer_file())
    assert all(own(t or "") == ids[:-1].tobytes() for t, ids in zip(texts, ids_of(texts)))


def test_orc_round_trip(spark):
    rows = [(k * 7 % 101, t) for k, t in enumerate([*TEXTS, *[f"word{i} and more" for i in range(60)]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = token_orc.write(docs, queries.tokenizer_file(), 2)
    want, start = [], 0
    ordered = sorted(rows, key=lambda r: r[0])
    for (k, _), ids in zip(ordered, ids_of([t for _, t in ordered])):
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_orc.digest(spark, path).collect())) == want
    one = token_orc.documents(spark, path, [rows[3][0]]).collect()
    assert [list(r.ids) for r in one] == [ids_of([rows[3][1]])[0].tolist()]


def test_best_fit_equals_a_linear_search():
    r = random.Random(1)
    for size in (1, 7, 64, 100):
        lengths = [r.randrange(1, size + 1) for _ in range(200)]
        left, want = [], [None] * len(lengths)
        for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
            fits = [c for c in left if c >= lengths[k]]
            if fits:
                left.remove(min(fits))
                left.append(min(fits) - lengths[k])
            else:
                left.append(size - lengths[k])
            left = [c for c in left if c]
            want[k] = True
        placed = packing.best_fit_decreasing(lengths, size)
        fill = defaultdict(int)
        for n, (s, _) in zip(lengths, placed):
            fill[s] += n
        assert max(fill.values()) <= size
        assert sorted(size - f for f in fill.values() if f < size) == sorted(left)


def test_pieces_cover_each_document_and_sequences_are_gapless(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionAll(spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = dict(zip(texts, ids_of(texts.values())))
    rows = packing.pack(docs, queries.tokenizer_file(), 2).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        by_doc[r.doc_id].append((r.start, r.length, r.doc_tokens))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for k, parts in by_doc.items():
        assert sum(n for _, n, _ in parts) == len(ids[k]) == parts[0][2]
        assert all(s + n == t for (s, n, _), (t, _, _) in zip(sorted(parts), sorted(parts)[1:]))
    for parts in by_sequence.values():
        parts.sort()
        assert parts[0][0] == 0 and sum(n for _, n in parts) <= 4096
        assert all(s + n == t for (s, n), (t, _) in zip(parts, parts[1:]))
    total = sum(map(len, ids.values()))
    assert len(by_sequence) <= -(-total // 4096) + 2
