"""The queries that apply each operator of this subpackage to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    content_sort, decontaminate, hard_negatives, line_dedup, packing, pseudo_likelihood, rule_ensemble, simhash_gray, token_counts, token_orc, tool_calls, toxicity_mil, whitening,
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.from_turns(_read(spark, sf_dir, "conversations"))
    return tool_calls.link(calls, results, {"reply": tool_calls.REPLY_SCHEMA})


def op3_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_gray.near_duplicates(_read(spark, sf_dir, "documents"))


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Ends each document in the token outputs.
END_ID = 2


def op1_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_mil.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.train_and_score(_read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.deduplicated(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_kept", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_orc.write(_read(spark, sf_dir, "documents"), tokenizer_file(), END_ID)
    return token_orc.digest(spark, path)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_file(), END_ID)


def op7_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.content_sort(_read(spark, sf_dir, "documents"), keep="largest")


def op9_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, vec_id = F.col("label").cast("long"), F.col("vec_id")
    shifted = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = hard_negatives.prepared(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding", shifted)
    return hard_negatives.mined(rows, F.col("id") % 50 == 0)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_mil": op1_toxicity_mil,
    "op2_tool_calls": op2_tool_calls,
    "op3_simhash_gray": op3_simhash_gray,
    "op4_pseudo_likelihood": op4_pseudo_likelihood,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_orc": op6_token_orc,
    "op7_content_sort": op7_content_sort,
    "op8_packing": op8_packing,
    "op9_rule_ensemble": op9_rule_ensemble,
    "op10_decontaminate": op10_decontaminate,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_whitening": op12_whitening,
    "op13_token_counts": op13_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": """
        WITH l AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
            FROM documents WHERE text IS NOT NULL),
        m AS (SELECT *, trim(lower(line)) AS norm FROM l),
        d AS (SELECT norm, min((doc_id, pos)) AS place FROM m WHERE norm <> '' GROUP BY norm),
        w AS (SELECT place, norm, len(string_split(norm, ' ')) >= 5 AS words,
                     CASE WHEN len(string_split(norm, ' ')) >= 5 THEN string_split(norm, ' ') ELSE string_split(norm, '') END AS w
              FROM d WHERE len(string_split(norm, ' ')) >= 5 OR length(norm) >= 10),
        g AS (SELECT place, words, w, unnest(range(1, len(w) + 1)) AS gone FROM w),
        v AS (SELECT place, gone, words, CASE WHEN words THEN array_to_string(list_concat(w[1:gone - 1], w[gone + 1:len(w)]), ' ') ELSE array_to_string(list_concat(w[1:gone - 1], w[gone + 1:len(w)]), '') END AS variant FROM g),
        e AS (SELECT words, variant, gone, min(place) AS early FROM v GROUP BY words, variant, gone),
        late AS (
            SELECT v.place FROM v JOIN e ON v.words = e.words AND v.variant = e.variant AND v.gone = e.gone WHERE e.early < v.place
            UNION
            SELECT CASE WHEN v.place < w.place THEN w.place ELSE v.place END FROM v JOIN w ON v.words = w.words AND v.variant = w.norm),
        s AS (SELECT place FROM d WHERE place NOT IN (SELECT place FROM late)),
        k AS (
            SELECT m.doc_id, m.pos, m.line, m.norm = '' OR s.place IS NOT NULL AS stays
            FROM m LEFT JOIN s ON s.place = (m.doc_id, m.pos))
        SELECT d.doc_id, coalesce(count(k.pos), 0) AS n_lines, count(*) FILTER (k.stays) AS n_kept,
               CASE WHEN any_value(d.text) IS NOT NULL
                    THEN sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (k.stays), '')) END AS text_sha256
        FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id
    """,
    "op7_content_sort": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
            FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM d
    """,
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS DOUBLE)) AS x
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        p AS (
            SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_inner_product(a.x, v.x) AS BIGINT) AS score
            FROM v AS a JOIN v ON v.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score FROM p WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT q.anchor_id, q.positive_id,
               CAST(row_number() OVER (PARTITION BY q.anchor_id, q.positive_id ORDER BY p.score DESC, p.vec_id) AS INTEGER) AS rank,
               p.vec_id AS negative_id, q.score AS positive_score, p.score AS negative_score
        FROM positives q JOIN p ON p.anchor_id = q.anchor_id AND NOT p.same AND 50 * q.score <= 100 * p.score AND 100 * p.score <= 95 * q.score
        QUALIFY row_number() OVER (PARTITION BY q.anchor_id, q.positive_id ORDER BY p.score DESC, p.vec_id) <= 3
    """,
}
