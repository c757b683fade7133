"""Documents to a training mix: five stages, each a DataFrame function over what the one before it kept.

Language identification drops texts without a language, exact dedup keeps one of equal texts, the Jaccard join keeps one
of each group of near copies, mixing repeats or drops documents towards its source's target, SentencePiece encodes what
is left.  Every stage's result is written to the shared folder and read again, so a lost executor costs one stage.

Defined results: null texts and texts without a letter go in the first stage; of equal texts the largest doc_id stays
(a null one ranks below all), of near copies the smallest (nulls last); rows that repeat a doc_id and a text follow the
row that stays, and the mix repeats rows of one doc_id alike; a null source is a source; an empty table gives none; all
columns but the last stage's are those of documents, whatever their names (tests/llm/test_odd_rows.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stumpline.llm.entropy_mix import mix
from stumpline.llm.exact_dedup import keep_unique
from stumpline.llm.jaccard_join import keep_one_of_each
from stumpline.llm.ppm_language import keep_identified
from stumpline.llm.sentencepiece_codec import MODEL, load, token_digests
from stumpline.llm.shared import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_unique(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_digests(docs, load(spark, MODEL))


STAGES = [("language ID", language), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing sources", mixed), ("SentencePiece", encoded)]

#: SQL has neither the language models nor the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, ids_sha256, round_trip of the mix's documents, repeated as the mix repeats them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{i}")
    return docs
