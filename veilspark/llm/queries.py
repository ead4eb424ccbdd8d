"""The registered queries: thin contracts over the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import pack
from .token_store import read_documents, write_store

from .topk import top_k
from ._common import held_out
from .quality import quality
from .toxicity import toxicity

from . import language
from .decontamination import decontaminate
from .token_counts import token_counts
from .substring_dedup import substring_dedup

from .jaccard import jaccard_components
from .ranked_search import ranked_search
from .resampling import resample
from .suffix_dedup import suffix_dedup


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"), end_id=0).drop("source")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, index = write_store(table(spark, sf_dir, "documents"), _path("word_bpe_49k.json"), end_id=2, spaces_matter=False)
    return read_documents(blocks, index)


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(F.col("doc_id"), 4, 2)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, table(spark, sf_dir, "labels"), ~out, threshold=0.3)
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(F.col("doc_id"), 5, 0)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality(docs, table(spark, sf_dir, "labels"), ~out, threshold=0.3)
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(F.col("doc_id"), 3, 1)
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, docs.select("doc_id", "lang"), ~out)
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), _path("byte_bpe_50k.tiktoken"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs, window=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=90, k=3)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup(docs, window=100).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=1, buckets=10_000, percent=10, least_words=20, seed="2024")
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {f.__name__: f for f in (op1_packing, op4_token_store, op8_top_k, op5_toxicity, op10_quality, op7_language, op3_token_counts, op2_decontamination, op9_substring_dedup, op6_jaccard_join, op11_suffix_dedup, op12_importance_resampling, op13_ranked_search)}
SQL: dict[str, str] = {
    "op8_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 5
    """,
    "op12_importance_resampling": r"""
        WITH steps AS (
            SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), i) ORDER BY i) AS t FROM range(256) r(i)
        ), words AS (
            SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
            UNION ALL
            SELECT 'b', NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
        ), counts AS (SELECT side, doc_id, w, count(*) AS n FROM words GROUP BY ALL),
        bytes AS (
            SELECT w, list_transform(range(CAST(length(h) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS b
            FROM (SELECT DISTINCT w, hex(encode(w)) AS h FROM words)
        ), hashed AS (
            SELECT w, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]), 4294967295), 4294967295) % 10000 AS bucket FROM bytes, steps
        ), sums AS (
            SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM counts JOIN hashed USING (w) GROUP BY bucket
        ), gain AS (
            SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((CAST(s AS DOUBLE) + 1) * ((SELECT sum(t) FROM sums) + 10000)))) AS BIGINT) AS g FROM sums
        ), weighed AS (
            SELECT doc_id, sum(n) AS n_features, sum(n * g) AS weight FROM counts JOIN hashed USING (w) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY doc_id
        ), scored AS (
            SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
            FROM documents LEFT JOIN weighed USING (doc_id)
        ), able AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN able USING (doc_id)
    """,
    "op13_ranked_search": r"""
        WITH words AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
        ), tf AS (SELECT doc_id, w, count(*) AS tf FROM words GROUP BY ALL),
        docs AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
        totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
        asked AS (
            SELECT item_id, w, count(*) AS q FROM (
                SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
            ) GROUP BY ALL
        ), weight AS (SELECT w, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, totals GROUP BY w, n_docs),
        scored AS (
            SELECT item_id, doc_id, CAST(sum(q * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
            FROM asked JOIN weight USING (w) JOIN tf USING (w) JOIN docs USING (doc_id), totals GROUP BY item_id, doc_id
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= 10
    """,
}
