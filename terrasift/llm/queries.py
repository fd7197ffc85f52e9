"""The registered queries of this subpackage. Each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, language_id, licenses, mixing, nearest, ngram_join, quality, repeated_spans, sentencepiece_codec, token_counts


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op3_mix_sources(spark, sf_dir):
    from pyspark.sql import functions as F
    return mixing.mix_sources(_documents(spark, sf_dir), mixing.QUERY_WEIGHTS, other=mixing.OTHER_WEIGHT).withColumn("rate", F.round("rate", 9))


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(_documents(spark, sf_dir))


def op1_repeated_spans(spark, sf_dir):
    return repeated_spans.remove_repeats(_documents(spark, sf_dir))


def op2_token_counts(spark, sf_dir):
    import public_tokenizers
    return token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_sentencepiece(spark, sf_dir):
    import public_tokenizers
    return sentencepiece_codec.encode_documents(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op6_ngram_join(spark, sf_dir):
    return ngram_join.similar_classes(_documents(spark, sf_dir))


def op4_language_id(spark, sf_dir):
    return language_id.identify_languages(_documents(spark, sf_dir))


def op7_quality(spark, sf_dir):
    return quality.select_quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))[0]


def op5_license_scan(spark, sf_dir):
    return licenses.scan_licenses(_documents(spark, sf_dir).withColumn("path", licenses.document_path()))


def op8_nearest(spark, sf_dir):
    return nearest.nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_repeated_spans, op2_token_counts, op3_mix_sources, op4_language_id, op5_license_scan, op6_ngram_join, op7_quality, op8_nearest, op9_exact_dedup, op10_sentencepiece, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op3_mix_sources": mixing.ORACLE, "op5_license_scan": licenses.oracle(), "op9_exact_dedup": exact_dedup.ORACLE}
