"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns: the defined results."""

import hashlib

import corpus_pipeline
import pytest
from pliegos.llm import content_sort, decontaminate, line_dedup, near_jaccard, packing, pseudo_likelihood, queries, rule_ensemble, simhash_gray, token_orc, tool_calls, toxicity_mil

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
EXTRA = (
    "score double, row_id string, clean int, lang string, n_lines int, kept_id int, statistics string, Doc string, place int, start int, version int, node int, fp int, fingerprint string, "
    "component_id int, content string, copy_key int, tokens int, ids int, part int, line int, path int, numbers int"
)
ROWS = [
    (1, None), (2, ""), (3, "  \n\t "), (4, LONG), (5, LONG), (6, "tie"), (6, "tie"), (None, "no id"), (None, None), (7, "Ünḯ 🙂 \x00"), (8, "x" * 100_000),
]
ITEM = "word1 word2 word3 word4 word5 word6 word7"


@pytest.fixture(scope="module")
def docs(spark):
    extra = (0.5, "r", 1, None, 2, 3, "s", None, 4, 5, 6, 7, 8, "f", 9, "c", 10, 11, 12, 13, 14, 15, 16)
    return spark.createDataFrame([(*r, *extra) for r in ROWS], f"doc_id long, text string, {EXTRA}").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, k % 2, k % 2) for k in range(1, 9)] + [(None, 1, 1), (2, None, None), (3, 0, 1), (3, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (None, ITEM), (3, ITEM), (4, "tie")], "item_id long, text string")


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_toxicity(docs, labels):
    rows = by_id(toxicity_mil.classify(docs, labels).collect())
    assert sum(map(len, rows.values())) == len(ROWS)
    for k in (1, 2, 3):
        assert rows[k][0].score == 0 and rows[k][0].worst_start is None and rows[k][0].predicted == 0
    assert rows[4][0].score == rows[5][0].score and rows[6][0] == rows[6][1] and not rows[None][0].held_out
    model = toxicity_mil.NoisyOr(-10.0, {"tie": 20.0, "id": 20.0, "word1": 20.0})
    found = toxicity_mil.offending_sentences(docs, model).collect()
    assert sorted((r.doc_id or 0, r.sentence == LONG or r.sentence) for r in found) == [(0, "no id"), (4, True), (5, True), (6, "tie"), (6, "tie")]


def test_simhash(docs):
    rows = by_id(simhash_gray.near_duplicates(docs).collect())
    assert sum(map(len, rows.values())) == len(ROWS)
    zero = [rows[k][0] for k in (1, 2, 3)]
    assert {r.fingerprint for r in zero} == {"0" * 16} and {r.component_id for r in zero} == {1}
    assert {r.component_id for r in rows[None] if r.fingerprint != "0" * 16} == {None} and 1 in {r.component_id for r in rows[None]}
    assert rows[4][0].component_id == rows[5][0].component_id == 4 and len({r.component_id for r in rows[6]}) == 1
    kept = simhash_gray.deduplicated(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 6, 7, 8]
    kept = near_jaccard.deduplicated(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 6, 7, 8]


def test_likelihood(docs):
    rows = by_id(pseudo_likelihood.train_and_score(docs).collect())
    assert sum(map(len, rows.values())) == len(ROWS)
    for k in (1, 2, 3):
        assert (rows[k][0].n_tokens, rows[k][0].log_probability, rows[k][0].mean_log_probability) == (0, 0.0, None)
    assert rows[4][0].n_tokens == 60_000 and rows[6][0].log_probability < 0
    assert rows[6][0].log_probability == pytest.approx(rows[6][1].log_probability)


def test_lines(docs):
    kept = line_dedup.deduplicated(docs)
    assert kept.columns[: len(docs.columns)] == docs.columns and kept.columns[-2:] == ["n_lines_", "n_kept"]
    rows = by_id(kept.collect())
    assert (rows[1][0].text, rows[1][0].n_lines_, rows[1][0].n_kept) == (None, 0, 0) and (rows[2][0].text, rows[2][0].n_lines_, rows[2][0].n_kept) == ("", 1, 1)
    assert rows[4][0].text == LONG and (rows[5][0].text, rows[5][0].n_kept) == ("", 0)
    assert [r.text for r in rows[6]] == ["tie", "tie"] and rows[8][0].text == "x" * 100_000


def test_tokens_and_their_files(docs):
    path = token_orc.write(docs, queries.tokenizer_file(), 2)
    rows = by_id(token_orc.digest(docs.sparkSession, path).collect())
    assert sum(map(len, rows.values())) == len(ROWS)
    assert {rows[k][0].n_tokens for k in (1, 2, 3)} == {1} and min(r.start for r in rows[None]) == 0
    everything = sorted((r.start, r.n_tokens) for rs in rows.values() for r in rs)
    assert all(a + n == b for (a, n), (b, _) in zip(everything, everything[1:]))
    few = {r.doc_id: list(r.ids) for r in token_orc.documents(docs.sparkSession, path, [1, 6, 99]).collect()}
    assert set(few) == {1, 6} and few[1] == [2] and few[6][-1] == 2


def test_contents(docs):
    rows = by_id(content_sort.content_sort(docs).collect())
    assert sum(map(len, rows.values())) == len(ROWS)
    empty = hashlib.sha256(b"").hexdigest()
    assert rows[1][0].text_sha256 == rows[2][0].text_sha256 == empty and rows[2][0].keep_id == 1 and rows[1][0].group_size == 3 and not rows[2][0].kept
    assert (rows[5][0].keep_id, rows[5][0].kept) == (4, False) and sorted(r.kept for r in rows[6]) == [False, True]
    kept = content_sort.deduplicated(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 6, 7, 8]


def test_packing(docs):
    rows = packing.pack(docs, queries.tokenizer_file(), 2).collect()
    found = by_id(rows)
    assert set(found) == {k for k, _ in ROWS}
    for k in (1, 2, 3):
        assert [(r.start, r.length, r.doc_tokens) for r in found[k]] == [(0, 1, 1)]
    assert len(found[6]) == 2 and sum(r.length for r in found[4]) == found[4][0].doc_tokens > 60_000
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(places, places[1:])) and all(o + n <= packing.SEQUENCE for _, o, n in places)


def test_quality(docs, labels):
    rows = by_id(rule_ensemble.classify(docs, labels).collect())
    assert sum(map(len, rows.values())) == len(ROWS)
    assert rows[1][0].score == rows[2][0].score and rows[6][0].score == rows[6][1].score and all(0 <= r.score <= 1 for rs in rows.values() for r in rs)
    for bias, n in ((9.0, len(ROWS)), (-9.0, 0)):
        kept = rule_ensemble.accepted(docs, rule_ensemble.RuleModel(bias, {}))
        assert kept.columns == docs.columns and kept.count() == n


def test_leaks(docs, items):
    rows = decontaminate.matches(docs, items).collect()
    assert sorted((r.doc_id, r.item_id or 0) for r in rows) == [(4, 0), (4, 3), (5, 0), (5, 3), (6, 4), (6, 4)]
    clean = decontaminate.decontaminated(docs, items)
    assert clean.columns == docs.columns and sorted((r.doc_id or 0) for r in clean.collect()) == [0, 0, 1, 2, 3, 7, 8]


OPERATORS = {
    "toxicity": lambda d, la, it: toxicity_mil.classify(d, la),
    "simhash": lambda d, la, it: simhash_gray.near_duplicates(d),
    "simhash_kept": lambda d, la, it: simhash_gray.deduplicated(d),
    "near": lambda d, la, it: near_jaccard.deduplicated(d),
    "likelihood": lambda d, la, it: pseudo_likelihood.train_and_score(d),
    "tokens": lambda d, la, it: token_orc.digest(d.sparkSession, token_orc.write(d, queries.tokenizer_file(), 2)),
    "content": lambda d, la, it: content_sort.content_sort(d),
    "packing": lambda d, la, it: packing.pack(d, queries.tokenizer_file(), 2),
    "quality": lambda d, la, it: rule_ensemble.classify(d, la),
    "accepted": lambda d, la, it: rule_ensemble.accepted(d, rule_ensemble.train(d, la)),
    "leaks": lambda d, la, it: decontaminate.matches(d, it),
    "clean": lambda d, la, it: decontaminate.decontaminated(d, it),
    "lines": lambda d, la, it: line_dedup.deduplicated(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_empty_tables(name, docs, labels, items):
    assert OPERATORS[name](docs.limit(0), labels.limit(0), items.limit(0)).count() == 0


def test_pipeline_on_odd_rows_and_on_empty_tables(spark, docs, labels, items, tmp_path):
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", items)):
        table.write.parquet(f"{tmp_path}/odd/{name}.parquet")
        table.limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()}
    assert kept <= {k for k, _ in ROWS} and not kept & {4, 5, 6}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


CALLS = "conversation long, call_id string, position long, name string, arguments string, depends_on array<string>, place int, status string, ready int, Needed int, check string"
RESULTS = "conversation long, call_id string, position long, content string, name string, one int"


def test_tool_calls_on_empty_tables_and_extra_columns(spark):
    assert tool_calls.link(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), {}).count() == 0


def test_tool_calls_on_odd_rows(spark):
    tail = (1, "s", 2, 3, "c")
    calls = [(1, "", None, None, None, [None, "", "x"], *tail), (1, "a", 0, "f", '"' + "y" * 300_000 + '"', None, *tail), (1, "a", 0, "f", '"' + "y" * 300_000 + '"', None, *tail), (None, "b", 0, "f", "1", [], *tail)]
    results = [(1, "a", 0, None, "n", 1), (1, "a", 0, None, "n", 1), (1, "o", None, "", "n", 1)]
    rows = {r.call_id: r for r in tool_calls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), {"f": {"type": "string"}}).collect()}
    assert {k: r.status for k, r in rows.items()} == {"": "unanswered", "a": "linked", "o": "orphan"}
    assert (rows["a"].n_calls, rows["a"].n_results, rows["a"].valid, rows["a"].message.endswith('"result":null}')) == (2, 2, True, True)
    assert rows[""].cyclic and rows[""].missing_dependencies == 1 and sorted(r.place for r in rows.values()) == [0, 1, 2]
