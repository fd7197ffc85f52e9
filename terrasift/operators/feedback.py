"""Pseudo-relevance feedback: term probabilities in the documents of a result page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .index import Index
from .match import token_hits


def query_term_probabilities(index: Index, results: DataFrame, queries: DataFrame, top: int = 10) -> DataFrame:
    """(sub_id, token, prob) over the query's own tokens; none where they do not occur."""
    hits = token_hits(index, queries).join(results.select("sub_id", "doc_id"), ["sub_id", "doc_id"], "left_semi")
    return _shares(hits.groupBy("sub_id", "token").agg(F.sum("tf").alias("n")), top)


def document_term_probabilities(index: Index, results: DataFrame, top: int = 10) -> DataFrame:
    """The same over all terms of the documents."""
    if index.words is not None:
        terms = index.words.join(results.select("sub_id", "doc_id"), "doc_id").select("sub_id", F.explode("words").alias("token"))
        return _shares(terms.groupBy("sub_id", "token").agg(F.count(F.lit(1)).alias("n")), top)
    hits = index.frequencies.join(results.select("sub_id", "doc_id"), "doc_id")
    return _shares(hits.groupBy("sub_id", F.col("term").alias("token")).agg(F.sum("tf").alias("n")), top)


def _shares(counts: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("sub_id")
    p = counts.withColumn("prob", F.round(F.col("n") / F.sum("n").over(w), 6))
    return p.withColumn("k", F.row_number().over(w.orderBy(F.desc("prob"), "token"))).where(F.col("k") <= top).select("sub_id", "token", "prob")
