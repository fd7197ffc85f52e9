"""The corpus pipeline: five stages, each applying one operator to all that the one before kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Stages are written as Parquet and read again between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrasift.llm import exact_dedup, mixing, ngram_join, quality, sentencepiece_codec
from terrasift.llm.common import saved


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling draws; the rest go."""
    return quality.quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.exact_dedup(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.near_dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in global random order."""
    return mixing.mix_sources(docs, mixing.QUERY_WEIGHTS, other=mixing.OTHER_WEIGHT).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what was mixed."""
    import public_tokenizers
    return sentencepiece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dedup_stage),
    ("mixing sources", mixing_stage),
    ("SentencePiece encoding", encoding_stage),
]

#: None: the quality models and the encoder are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, name.replace(" ", "-"))
    return docs
