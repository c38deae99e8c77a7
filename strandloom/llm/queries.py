"""The operators' registered queries, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shipping import ship
from . import html_extract, langid, neardup, packing, pii, quality, repetition, secrets, topk, trie_bpe
from .common import fold, table

#: Key of the surrogates in the registered query; a deployment brings its own.
PII_KEY = "example-key"


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10, scale=1024)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


def op3_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold(2, "doc_id", 4)
    model = quality.train(docs, labels, ~held)
    return quality.score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    held = fold(0, "doc_id", 5)
    return langid.predict(docs, langid.train(docs, learnable=~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


def op8_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    coded = trie_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of the documents with the contract's columns."""
    path = public_tokenizers.path
    pieces = packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, length=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packed(table(spark, sf_dir, "documents"))


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return html_extract.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_topk,
        op2_pii_surrogates,
        op3_quality_pu,
        op4_secret_scan,
        op5_language_id,
        op6_setsketch_dedup,
        op7_repetition,
        op8_trie_bpe,
        op9_curve_packing,
        op10_html_main_text,
    )
}

ORACLE = {
    "op1_exact_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                 CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        ), r AS (
          SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op6_setsketch_dedup": """
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
          FROM documents
        ), s AS (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(generate_series(1, len(w) - 2), lambda i: [w[i], w[i + 1], w[i + 2]]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (
          SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), e AS (
          SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.n + ny.n - i)
        ), r(doc_id, reach) AS (
          SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reach
        ), c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
        FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
    """,
}
