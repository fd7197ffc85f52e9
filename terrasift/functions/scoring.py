"""Scorers: Column builders of a token's score in a document, and of the document's factor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# BM25 parameters (the average length is a constant) and boosts by place type.
BM25_K, BM25_B, BM25_LENGTH = 1.2, 0.5, 200.0
BOOSTS = {"CITY": 1.7, "COUNTY": 1.5, "STATE": 1.2}


def idf(n_docs: Column, df: Column) -> Column:
    return F.pow(F.log(n_docs / df + F.lit(1.0)) + F.lit(1.0), F.lit(2.0))


def cosine(c: dict[str, Column]) -> Column:
    return c["df"] * c["df"] / (c["num_words"] + c["n_tokens"])


def tfidf(c: dict[str, Column]) -> Column:
    return c["tf"] / (c["df"] + F.lit(1.0))


def lucene_tfidf(c: dict[str, Column]) -> Column:
    in_title = F.when(F.contains(F.lower(c["title"]), c["token"]), F.lit(10.0)).otherwise(F.lit(1.0))
    return F.sqrt(c["tf"]) * idf(c["n_docs"], c["df"]) * c["boost"] * in_title


def bm25(c: dict[str, Column]) -> Column:
    length = F.lit(BM25_K) * (F.lit(1 - BM25_B) + F.lit(BM25_B) * c["num_words"] / F.lit(BM25_LENGTH))
    return F.lit(BM25_K + 1) * c["tf"] / (length + c["tf"]) * idf(c["n_docs"], c["df"]) * c["boost"]


def bm25_values(tf, num_words, df, n_docs: float):
    """bm25 of arrays, without boosts."""
    import numpy as np
    length = BM25_K * (1 - BM25_B + BM25_B * num_words / BM25_LENGTH)
    return (BM25_K + 1) * tf / (length + tf) * (np.log(n_docs / df + 1.0) + 1.0) ** 2


SCORERS: dict[str, Callable[[dict[str, Column]], Column]] = {"cosine": cosine, "tfidf": tfidf, "lucene_tfidf": lucene_tfidf, "bm25": bm25}


def document_factor(scorer: str, num_words: Column) -> Column:
    return F.lit(1.0) / F.sqrt(num_words) if scorer == "lucene_tfidf" else F.lit(1.0)


def place_boost(kind: Column) -> Column:
    out = F.lit(1.0)
    for k, v in BOOSTS.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out
