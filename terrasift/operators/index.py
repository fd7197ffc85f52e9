"""The positional index as DataFrames: documents, occurrences, postings, dictionary, totals."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrasift.functions import text as T
from terrasift.sources.store import stored

TABLES = ("docs", "occurrences", "frequencies", "postings", "terms", "stats")


def spread(df: DataFrame) -> DataFrame:
    """Small files come as fewer partitions than there are cores; only those are dealt out again."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


@dataclass
class Index:
    docs: DataFrame         # doc_id, title, url, num_words, page_rank, num_views
    occurrences: DataFrame  # term, doc_id, pos
    frequencies: DataFrame  # term, doc_id, tf
    postings: DataFrame     # term, doc_id, tf, positions
    terms: DataFrame        # term, df, ctf
    stats: DataFrame        # one row: n_docs, total_words, avg_words, vocabulary
    words: DataFrame | None = None  # doc_id, num_words, words in order of position, where the documents are at hand

    def save(self, path: str, buckets: int = 0) -> None:
        """Parquet tables; postings are clustered by term, so that lookups prune row groups."""
        for name in TABLES:
            df = getattr(self, name)
            if name in ("postings", "occurrences", "frequencies"):
                df = df.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(*[spark.read.parquet(f"{path}/{name}") for name in TABLES])

    def stored(self) -> Index:
        """The tables that searches read, written to the shared folder in term order, so that a lookup
        skips row groups (and cached batches) by their least and greatest term. The rest is derived."""
        by_term = lambda df: df.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
        docs = stored(self.docs, "docs").cache()
        occurrences = stored(by_term(self.occurrences), "occurrences").cache()
        frequencies = stored(occurrences.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf")).sortWithinPartitions("term", "doc_id"), "frequencies").cache()
        return derive(docs, occurrences, frequencies)

    @cached_property
    def n_docs(self) -> int:
        return self.stats.first()["n_docs"]


def document_words(source: DataFrame, stop: list[str] = T.STOP_WORDS) -> DataFrame:
    """(doc_id, words) in the order of their positions in the index; documents that it leaves out have none.
    (They are not filtered out, as that filter would be moved to the scan and split every text there once more.)"""
    words = source.select("doc_id", T.split_words(T.index_clean(F.coalesce("text", F.lit("")))).alias("words"))
    return words.select("doc_id", F.when(F.size("words") > 1, T.drop_stop_words(F.col("words"), stop)).otherwise(F.array().cast("array<string>")).alias("words"))


def build_index(source: DataFrame, stop: list[str] = T.STOP_WORDS) -> Index:
    """From doc_id, text and, where there, title, url, page_rank and num_views. Documents of fewer
    than two words are left out; stop words count in lengths but take no position."""
    base = _documents(source)
    docs = base.select("doc_id", "title", "url", F.size("words").cast("long").alias("num_words"), "page_rank", "num_views")
    occurrences = base.select("doc_id", F.posexplode(T.drop_stop_words(F.col("words"), stop)).alias("pos", "term")).select("term", "doc_id", "pos")
    return derive(docs, occurrences)


def document_index(source: DataFrame, stop: list[str] = T.STOP_WORDS) -> Index:
    """The same, as one stored row a document with its words, doc_id being a key: made in one pass without a
    shuffle. Lookups scan the words; counts are made inside documents first."""
    base = _documents(source)
    base = stored(base.select("doc_id", "title", "url", F.size("words").cast("long").alias("num_words"), "page_rank", "num_views", T.drop_stop_words(F.col("words"), stop).alias("words")), "words")
    once, each = F.explode(F.array_distinct("words")).alias("term"), F.explode("words").alias("term")
    counts = base.select(once).select("term", F.lit(1).alias("d"), F.lit(0).alias("c")).unionAll(base.select(each).select("term", F.lit(0).alias("d"), F.lit(1).alias("c")))
    ix = derive(base.drop("words"), base.select("doc_id", F.posexplode("words").alias("pos", "term")).select("term", "doc_id", "pos"))
    return replace(ix, terms=counts.groupBy("term").agg(F.sum("d").alias("df"), F.sum("c").alias("ctf")), words=base.select("doc_id", "num_words", "words"))


def _documents(source: DataFrame) -> DataFrame:
    have = set(source.columns)
    extra = {"title": F.lit("").cast("string"), "url": F.lit("").cast("string"), "page_rank": F.lit(0.0).cast("float"), "num_views": F.lit(0)}
    return source.select(
        "doc_id", *[F.col(c) if c in have else v.alias(c) for c, v in extra.items()],
        T.split_words(T.index_clean(F.coalesce("text", F.lit("")))).alias("words"),
    ).where(F.size("words") > 1)


def derive(docs: DataFrame, occurrences: DataFrame, frequencies: DataFrame | None = None) -> Index:
    if frequencies is None:
        frequencies = occurrences.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    postings = occurrences.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    terms = frequencies.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf"))
    stats = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("num_words"), F.lit(0)).alias("total_words"), F.avg("num_words").alias("avg_words"))
    return Index(docs, occurrences, frequencies, postings, terms, stats)
