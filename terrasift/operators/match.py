"""Conjunctive and phrase matching for many queries at once.

A query is rows (sub_id, ord, token): a token is a word or a phrase of words at consecutive
positions, and a document matches if it holds every token.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrasift.functions import text as T

from .index import Index

#: Query tables up to this many words are broadcast (they are counted first); larger ones shuffle.
BROADCAST_WORDS = 100_000
#: Up to this many distinct words are also listed in a filter on the index.
LISTED_WORDS = 64
#: Looked-up tokens are cached while a query reads them several times; beyond so many, the oldest are given up (and made again if still read).
KEPT_LOOKUPS = 8
_lookups: deque[DataFrame] = deque()


def _kept(hits: DataFrame) -> DataFrame:
    _lookups.append(hits.cache())
    while len(_lookups) > KEPT_LOOKUPS:
        _lookups.popleft().unpersist()
    return hits


def query_frame(spark: SparkSession, queries: list[tuple]) -> DataFrame:
    """[(sub_id, [token, ...]), ...] as rows; a token that repeats in a query counts again."""
    rows = [(s, i, t) for s, tokens in queries for i, t in enumerate(tokens)]
    kind = "string" if any(isinstance(r[0], str) for r in rows) else "long"
    return spark.createDataFrame(rows, f"sub_id {kind}, ord int, token string")


def string_starts(index: Index, asked: DataFrame) -> DataFrame:
    """asked (key, n_words) of single words and phrases to (key, doc_id), a row for each start in the documents' words.
    Strings are made inside their document, only of the lengths that are asked for, and looked up by one hash each."""
    keys = asked.distinct()
    listed = [tuple(r) for r in keys.limit(LISTED_WORDS + 1).collect()]
    few = len(listed) <= LISTED_WORDS
    lengths = sorted({n for _, n in listed} if few else {r[0] for r in keys.select("n_words").distinct().collect()})
    strings = F.concat(*[F.col("words") if n == 1 else T.ngrams(F.col("words"), n) for n in lengths]) if lengths else F.array().cast("array<string>")
    starts = index.words.select("doc_id", F.explode(strings).alias("key"))
    if few:
        return starts.where(F.col("key").isin([k for k, _ in listed]))
    small = keys.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    return starts.join(F.broadcast(keys.select("key")) if small else keys.select("key"), "key")


def token_hits(index: Index, queries: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """(sub_id, ord, token, n_words, doc_id, tf) wherever a token occurs. tf counts every start of a phrase."""
    words = queries.select("sub_id", "ord", "token", F.split("token", " ").alias("w"))
    if stop is not None:
        words = words.withColumn("w", F.filter("w", lambda x: ~x.isin(stop)))
    if index.words is not None:
        asked = words.select("sub_id", "ord", "token", F.size("w").alias("n_words"), F.array_join("w", " ").alias("key")).where("n_words > 0")
        hits = string_starts(index, asked.select("key", "n_words")).groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
        return asked.join(hits, "key").select("sub_id", "ord", "token", "n_words", "doc_id", "tf")
    words = words.select("sub_id", "ord", "token", F.size("w").alias("n_words"), F.posexplode("w").alias("j", "term"))
    asked = [r[0] for r in words.select("term").distinct().limit(LISTED_WORDS + 1).collect()]
    singles, phrases = index.frequencies, index.occurrences
    if len(asked) <= LISTED_WORDS:  # a filter that prunes the index's batches and row groups
        singles, phrases = singles.where(F.col("term").isin(asked)), phrases.where(F.col("term").isin(asked))
        small = words.count() <= BROADCAST_WORDS
    else:
        small = words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    pick = (lambda w: F.broadcast(w)) if small else (lambda w: w)
    one = singles.join(pick(words.where("n_words = 1")), "term").select("sub_id", "ord", "token", "n_words", "doc_id", "tf")
    # Each occurrence votes for the phrase start that it fits; a start with all votes is an occurrence of the phrase.
    hits = phrases.join(pick(words.where("n_words > 1")), "term")
    starts = hits.groupBy("sub_id", "ord", "token", "n_words", "doc_id", (F.col("pos") - F.col("j")).alias("start")).agg(F.count(F.lit(1)).alias("votes"))
    many = starts.where("votes = n_words").groupBy("sub_id", "ord", "token", "n_words", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    return one.unionByName(many)


def candidates(index: Index, queries: DataFrame) -> DataFrame:
    """(sub_id, doc_id, n_tokens, ord, token, n_words, tf, df) for the documents of each query's
    rarest token: a document matches if it has a row for each of the n_tokens tokens. Distinct
    tokens are looked up once, however many queries share them; a query with an unknown token has no rows."""
    distinct = queries.select("token").distinct().select(F.lit(0).alias("sub_id"), F.lit(0).alias("ord"), "token")
    hits = _kept(token_hits(index, distinct).select("token", "n_words", "doc_id", "tf"))
    known = queries.join(hits.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "token")
    size = queries.groupBy("sub_id").agg(F.count(F.lit(1)).alias("n_tokens"))
    rarest = known.groupBy("sub_id").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("df", "ord", "token")).alias("r")).join(size, "sub_id")
    rarest = rarest.where("k = n_tokens").select("sub_id", "n_tokens", F.col("r.token").alias("token"))
    docs = hits.select("token", "doc_id").join(rarest, "token").select("sub_id", "n_tokens", "doc_id")
    wanted = docs.join(known.select("sub_id", "ord", "token", "df"), "sub_id")
    return wanted.join(hits, ["token", "doc_id"]).select("sub_id", "doc_id", "n_tokens", "ord", "token", "n_words", "tf", "df")


def matches(index: Index, queries: DataFrame) -> DataFrame:
    """(sub_id, doc_id) of the documents that hold all of a query's tokens."""
    rows = candidates(index, queries).groupBy("sub_id", "doc_id").agg(F.count(F.lit(1)).alias("k"), F.first("n_tokens").alias("n"))
    return rows.where("k = n").select("sub_id", "doc_id")


def frequencies(hits: DataFrame) -> DataFrame:
    """(sub_id, ord, df, ctf) of each token, phrases too."""
    return hits.groupBy("sub_id", "ord").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf"))
