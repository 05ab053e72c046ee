"""The corpus pipeline over documents: each stage's result is written as Parquet and read
again as the next one's documents.

All stages but the last return the columns of documents. The last returns doc_id, n_tokens,
ids and text, which is what the ids decode to.

Nulls: a document without text has the score of an empty text; where the classifier keeps
it, it goes through all stages and has no tokens. A document without doc_id is never a near
duplicate. Very long texts go through whole. Of near duplicates the smallest doc_id stays; rows
that repeat an id stay or go together. Extra columns stay up to the last stage, whatever their
names. Empty tables pass through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import bpe, decontam, neardup, pii, quality
from trendloom.llm.common import materialize

#: No SQL: the classifier is trained and near duplicates are components.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = quality.quality_score(spark, model)
    return docs.where(score(F.coalesce("text", F.lit(""))) >= 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return neardup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold benchmark passages."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in texts by its kind."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in clean.columns else clean


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode texts to ids, and decode the ids."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = materialize(bpe.encode(docs, ranks, public_tokenizers.PATTERN), "ids")  # decoding gets tasks of its own
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", bpe.decode(spark, ranks)("ids").cast("string").alias("text"))


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", redact_personal_data),
    ("byte-level BPE encoding and decoding", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
    return docs
