"""Scoring, sums over all matches, top-k, and merging of ranked lists."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window, functions as F

from terrasift.functions.scoring import SCORERS, bm25_values, document_factor
from terrasift.sources.store import stored

from .index import Index
from .match import candidates, matches

ROUND = 6
#: Different queries whose sums a document's task keeps.
MOST_SETS = 50_000


def score(index: Index, queries: DataFrame, scorer: str = "bm25", boosts: DataFrame | None = None, df_offset: int = 1, blend_page_rank: bool = False) -> DataFrame:
    """(sub_id, doc_id, score) of all matches. df_offset is added to the document frequency of
    single words (the dictionary that this reproduces starts counting at one). boosts: (token, boost). blend_page_rank multiplies by 1 + page rank."""
    n_docs = index.n_docs
    rows = candidates(index, queries).join(index.docs.select("doc_id", "title", "num_words", "page_rank"), "doc_id")
    rows = rows.join(boosts, "token", "left").withColumn("boost", F.coalesce("boost", F.lit(1.0))) if boosts is not None else rows.withColumn("boost", F.lit(1.0))
    cols = {c: F.col(c) for c in ("tf", "num_words", "n_tokens", "title", "token", "boost")}
    cols |= {"n_docs": F.lit(float(n_docs)), "df": (F.col("df") + F.when(F.col("n_words") == 1, df_offset).otherwise(0)).cast("double")}
    each = rows.select("sub_id", "doc_id", "n_tokens", "num_words", "page_rank", SCORERS[scorer](cols).alias("s"))
    factor = document_factor(scorer, F.col("num_words"))
    if blend_page_rank:
        factor = factor * (1 + F.coalesce(F.col("page_rank").cast("double"), F.lit(0.0)))
    found = each.groupBy("sub_id", "doc_id").agg((F.sum("s") * F.first(factor)).alias("score"), F.count(F.lit(1)).alias("k"), F.first("n_tokens").alias("n"))
    return found.where("k = n").select("sub_id", "doc_id", "score")


def sums(scored: DataFrame) -> DataFrame:
    """Per query: hits, total score, root of the squares, and strength = total / sqrt(squares + 1)."""
    return scored.groupBy("sub_id").agg(
        F.count(F.lit(1)).alias("n_hits"), F.sum("score").alias("total"), F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"),
    ).withColumn("strength", F.col("total") / F.sqrt(F.col("norm") * F.col("norm") + 1))


def strengths(index: Index, queries: DataFrame) -> DataFrame:
    """sums() of the bm25 scores of many queries of single words. Queries of the same tokens are scored once; each
    document adds to their sums where its words are, so that only sums are shuffled. Phrases, more than MOST_SETS
    different queries, and indexes without their documents' words take the way by rows."""
    by_set = queries.groupBy("sub_id").agg(F.sort_array(F.collect_list("token")).alias("t")).select("sub_id", F.array_join("t", " ").alias("set"), F.size("t").alias("n_tokens"))
    sets = [] if index.words is None else [r[:] for r in by_set.select("set", "n_tokens").distinct().limit(MOST_SETS + 1).collect()]
    if index.words is None or len(sets) > MOST_SETS or any(len(s.split(" ")) != n for s, n in sets):
        return sums(score(index, queries))
    totals = stored(_set_sums(index, [s.split(" ") for s, _ in sets]), "strengths")
    norm = F.sqrt("squares")
    return by_set.join(totals, "set").select("sub_id", "n_hits", "total", norm.alias("norm"), (F.col("total") / F.sqrt(norm * norm + 1)).alias("strength"))


def _set_sums(index: Index, sets: list[list[str]], df_offset: int = 1) -> DataFrame:
    """(set, n_hits, total, squares) of the documents that hold all of a set's tokens (repeated ones count again)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = index.words.sparkSession
    asked = spark.createDataFrame([(t,) for t in sorted({t for s in sets for t in s})], "term string")
    found = index.words.select(F.explode(F.array_distinct("words")).alias("term")).join(F.broadcast(asked), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()
    names, df, n_docs = [r["term"] for r in found], np.array([r["df"] for r in found], "float64") + df_offset, float(index.n_docs)
    at = {t: i for i, t in enumerate(names)}
    sets = [s for s in sets if all(t in at for t in s)]  # of an unknown token no document has all
    shared = Counter(t for s in sets for t in s)
    groups: dict[tuple, list] = {}
    for s in sets:  # tokens that many sets share lead, so that those sets share what is found for them
        *first, last = sorted(s, key=lambda t: (-shared[t], t))
        groups.setdefault(tuple(at[t] for t in first), []).append((at[last], " ".join(s)))
    groups = {k: (np.array([i for i, _ in v]), [s for _, s in v]) for k, v in groups.items()}

    def run(batches):
        sums = {k: np.zeros((3, len(v[0]))) for k, v in groups.items()}
        many = max(1, min(4096, 4_000_000 // max(1, len(names))))
        for batch in batches:
            for piece in (batch.slice(i, many) for i in range(0, batch.num_rows, many)):
                lists, n_words = piece.column("words"), piece.column("num_words").to_numpy(zero_copy_only=False)
                word = pc.fill_null(pc.index_in(lists.flatten(), value_set=pa.array(names, pa.string())), -1).to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(piece.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                known = word >= 0
                tf = np.bincount(word[known].astype("int64") * piece.num_rows + doc[known], minlength=len(names) * piece.num_rows).reshape(len(names), piece.num_rows)
                has, s = tf > 0, bm25_values(tf, n_words[None, :], df[:, None], n_docs)
                for first, (last, _) in groups.items():
                    docs = np.flatnonzero(has[list(first)].all(axis=0))
                    if len(docs):
                        hit = has[np.ix_(last, docs)]
                        v = np.where(hit, s[np.ix_(last, docs)] + s[np.ix_(first, docs)].sum(axis=0), 0.0)
                        sums[first] += hit.sum(axis=1), v.sum(axis=1), (v * v).sum(axis=1)
        rows = [(s, int(n), t, q) for k, (_, of) in groups.items() for s, n, t, q in zip(of, *sums[k].tolist()) if n]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.float64(), pa.float64()))], names=["set", "n_hits", "total", "squares"])

    parts = index.words.select("num_words", "words").mapInArrow(run, "set string, n_hits long, total double, squares double")
    return parts.groupBy("set").agg(*[F.sum(c).alias(c) for c in parts.columns[1:]])


def top_k(scored: DataFrame, k: int, normalise: bool = True) -> DataFrame:
    """(sub_id, rank, doc_id, score): the best k of each query, score over the norm of all its matches."""
    if normalise:
        scored = scored.join(sums(scored).select("sub_id", "norm"), "sub_id")
        scored = scored.select("sub_id", "doc_id", "score", (F.col("score") / F.col("norm")).alias("final"))
    else:
        scored = scored.withColumn("final", F.col("score"))
    by = Window.partitionBy("sub_id").orderBy(F.desc(F.round("score", ROUND)), "doc_id")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select(
        "sub_id", "rank", "doc_id", F.round("final", ROUND).alias("score"))


def merge_best(ranked: DataFrame, k: int) -> DataFrame:
    """One list of the best k over all sub-queries, each document at its best score."""
    return ranked.groupBy("doc_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def by_page_rank(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """Conjunctive matches by page rank alone."""
    return top_k(matches(index, queries).join(index.docs.select("doc_id", F.col("page_rank").cast("double").alias("score")), "doc_id"), k, normalise=False)
