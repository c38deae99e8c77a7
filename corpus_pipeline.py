"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept.  All but the
last return the columns of documents.  Further columns of their input are ignored, whatever their
names; empty tables give empty results; texts of any length are taken whole; null ids, languages and
sources are values like any other.  What a stage does with null or empty texts and with repeated rows
stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.llm import langid, neardup, quality, queries, secrets
from strandloom.llm.common import cut, fold, table
from strandloom.shipping import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a tellable language go: null or empty texts, texts without a letter, and texts
    whose best language has a score below 0.3.

    Repeated rows stay or go together.  Without any labelled language nothing can be told.
    """
    ship(spark)
    docs = docs.select(COLUMNS)
    return langid.identified(docs, langid.train(docs, learnable=~fold(0, "doc_id", 5)))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below the threshold go.

    A null text is scored as an empty one; repeated rows stay or go together.  Without labels scores
    are the prior, which is below the threshold unless all known labels are good.
    """
    ship(spark)
    docs = docs.select(COLUMNS)
    return quality.good(docs, quality.train(docs, table(spark, sf_dir, "labels"), ~fold(2, "doc_id", 4)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five words, similarity 0.8).

    Null texts, texts without words and rows without an id are like nothing and stay; of rows of equal
    id and text one stays; different texts under one id stay together or go together.
    """
    ship(spark)
    return neardup.deduplicated(docs.select(COLUMNS), width=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text.

    A null text becomes an empty one; every row stays, repeated ones too.
    """
    found = secrets.find_secrets(docs.select(COLUMNS), keep=("doc_id", "lang", "source"))
    clean = found.withColumn("text", secrets.redacted())
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens along the space-filling curve.

    A null or empty text is its end token alone; repeated rows are packed each.
    """
    ship(spark)
    return queries.packed(docs)


STAGES = [
    ("language ID", language),
    ("quality classifier", good_quality),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("packing", pack),
]

#: Trained models and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again, on the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, "stage")
    return docs
