import corpus_pipeline
from pliegos.llm import content_sort, decontaminate, rule_ensemble


def near_by_all_pairs(texts):
    """The smallest id of each component under five-word Jaccard similarity of 0.8 or more."""
    sets = {}
    for k, t in texts.items():
        words = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(k) for k in ids}


def test_each_stage_takes_effect_and_clean_documents_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    labels, items = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = {
        "quality classifier": lambda d: {r.doc_id for r in rule_ensemble.classify(d, labels).where("predicted = 1").collect()},
        "exact dedup": lambda d: {r.doc_id for r in content_sort.content_sort(d, keep="largest").where("kept").collect()},
        "SimHash near-dedup": lambda d: near_by_all_pairs({r.doc_id: r.text for r in d.collect()}),
        "benchmark decontamination": lambda d: {r.doc_id for r in d.collect()} - {r.doc_id for r in decontaminate.matches(d, items).collect()},
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == columns
        ids = [r.doc_id for r in kept.collect()]
        assert len(ids) == len(set(ids)) and set(ids) == want[name](docs), name
        docs = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed)
