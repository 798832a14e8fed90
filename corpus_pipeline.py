"""From documents to token files: language ID, near duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``docs``. Rows that are null or empty in text are rejected by the
first stage, as no language is known for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hopline.llm import decontaminate, language_id, minhash, source_mixing, token_ids
from hopline.llm._shared import written
from hopline.llm.queries import vocabulary

#: A document goes if no language's filter holds so much of its n-grams.
LEAST_SCORE = 0.3


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is known; the model learns from all labelled documents of ``docs``."""
    return language_id.accepted(docs, language_id.fit(docs), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates (five words, similarity 0.8)."""
    return minhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no part of a benchmark text."""
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of the sources does: not, once or twice."""
    return source_mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what they hold, by document: doc_id, start, n_tokens, ids_crc32, shard, offset."""
    return token_ids.encoded(docs, vocabulary())


STAGES = [("language_id", identify), ("minhash_near_dedup", near_duplicates), ("decontamination", decontaminated), ("source_mixing", mixed), ("token_ids", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
