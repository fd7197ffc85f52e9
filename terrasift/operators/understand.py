"""Query understanding: tokens, segmentation by a corpus language model, place lookup."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrasift.functions.text import QUERY_STOP_WORDS

from .index import Index
from .match import frequencies, query_frame, string_starts, token_hits

MAX_SEGMENT = 3
RARE = 50
_TOKEN = re.compile(r'"([^"]*)"|([^"\s]+)')


@dataclass
class GeoQuery:
    text: str
    tokens: list[str] = field(default_factory=list)
    supporting: list[str] = field(default_factory=list)
    candidates: list[int] = field(default_factory=list)
    expanded: list[int] = field(default_factory=list)
    mode: str = "NONE"
    best: bool = False
    suggestions: list[int] = field(default_factory=list)
    unique_names: dict[int, str] = field(default_factory=dict)


def tokenize(query: str, drop_phrase_stop_words: bool = True) -> list[str]:
    """Words without stop words, and quoted phrases. A phrase loses its stop words too, as they hold
    no position in the index (False keeps them, so that such a phrase matches nothing)."""
    out = []
    for m in _TOKEN.finditer(query.lower()):
        quoted = m.group(1) is not None
        words = re.sub(r"[^a-z0-9\s]", " ", m.group(1) if quoted else m.group(2)).split()
        if quoted:
            if drop_phrase_stop_words:
                words = [w for w in words if w not in QUERY_STOP_WORDS]
            if words:
                out.append(" ".join(words))
        else:
            out += [w for w in words if w not in QUERY_STOP_WORDS]
    return out


def segment_score(count: float, prefix_count: float | None, total: float) -> float:
    """ln(count / C + 1 + 1 / total); C is the prefix's count, or the total where that is RARE at most or there is no prefix."""
    base = total if prefix_count is None or prefix_count <= RARE else prefix_count
    return math.log(count / base + 1 + 1 / total)


def best_segmentation(terms: list[str], counts: dict[str, float], total: float) -> list[str]:
    """The best split into segments of up to MAX_SEGMENT terms; of equal ones, that with the shorter last segment."""
    n = len(terms)
    best: list[tuple[float, int]] = []
    for end in range(n):
        choice = (-math.inf, end)
        for start in range(end, max(-1, end - MAX_SEGMENT), -1):
            seg = " ".join(terms[start : end + 1])
            prefix = " ".join(terms[start:end])
            s = segment_score(counts.get(seg, 0), counts.get(prefix, 0) if prefix else None, total) + (best[start - 1][0] if start else 0.0)
            if s > choice[0]:
                choice = (s, start)
        best.append(choice)
    out, end = [], n - 1
    while end >= 0:
        start = best[end][1]
        out.append(" ".join(terms[start : end + 1]))
        end = start - 1
    return out[::-1]


def corpus_counts(spark: SparkSession, index: Index, strings: list[str]) -> dict[str, float]:
    """Corpus frequencies of words and phrases, in one job."""
    if not strings:
        return {}
    q = query_frame(spark, [(0, strings)])
    return {strings[r.ord]: float(r.ctf) for r in frequencies(token_hits(index, q)).collect()}  # a row for each string


def segment(spark: SparkSession, index: Index, terms: list[str]) -> list[str]:
    spans = sorted({" ".join(terms[a:b]) for a in range(len(terms)) for b in range(a + 1, min(len(terms), a + MAX_SEGMENT) + 1)})
    total = float(index.stats.first()["total_words"]) or 1.0
    return best_segmentation(terms, corpus_counts(spark, index, spans), total)


def understand(spark: SparkSession, index: Index, names: DataFrame, query: str, places: list[int] | None = None, uname: list[str] | None = None) -> GeoQuery:
    """Segments become places where the gazetteer knows them, else supporting tokens; given places make
    every segment supporting. Names of a chosen place are added to the tokens."""
    segments = segment(spark, index, tokenize(query))
    out = GeoQuery(query, tokens=list(segments), candidates=list(places or []))
    found: dict[str, list[int]] = {}
    if segments and not places:
        for r in names.where(F.col("key").isin(segments)).orderBy("id").collect():
            found.setdefault(r["key"], []).append(r["id"])
    for s in segments:
        if s in found:
            out.candidates += [i for i in found[s] if i not in out.candidates]
        else:
            out.supporting.append(s)
    out.tokens += [w.strip().lower() for w in uname or [] if w.strip()]
    return out


def segment_batch(index: Index, queries: DataFrame) -> DataFrame:
    """(sub_id, segments, score) for many queries (sub_id, ord, token): one count of all their
    strings, then the dynamic program for each query. segments are joined by |."""
    import pandas as pd

    total = float(index.stats.first()["total_words"]) or 1.0
    terms = queries.groupBy("sub_id").agg(F.sort_array(F.collect_list(F.struct("ord", "token"))).alias("t")).select("sub_id", F.transform("t", lambda x: x["token"]).alias("terms"))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(MAX_SEGMENT)), lambda n: F.transform(
        F.when(F.size("terms") >= n, F.sequence(F.lit(1), F.size("terms") - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice("terms", i, n), " "))))
    strings = terms.select(F.explode(spans).alias("token")).distinct().select(F.xxhash64("token").alias("sub_id"), F.lit(0).alias("ord"), "token")
    if index.words is not None:
        counts = string_starts(index, strings.select(F.col("token").alias("key"), F.size(F.split("token", " ")).alias("n_words"))).groupBy(F.col("key").alias("token")).agg(F.count(F.lit(1)).alias("ctf"))
    else:
        counts = token_hits(index, strings).groupBy("token").agg(F.sum("tf").alias("ctf"))
    asked = terms.select("sub_id", "terms", F.explode(spans).alias("token")).join(counts, "token", "left")
    rows = asked.groupBy("sub_id", "terms").agg(F.collect_list("token").alias("tokens"), F.collect_list(F.coalesce("ctf", F.lit(0))).alias("ctfs"))

    def run(batches):
        for pdf in batches:
            out = []
            for sub, t, names, ctfs in zip(pdf["sub_id"], pdf["terms"], pdf["tokens"], pdf["ctfs"]):
                known = dict(zip(names, map(float, ctfs)))
                best = best_segmentation(list(t), known, total)
                score, at = 0.0, 0
                for s in best:
                    k = s.count(" ") + 1
                    prefix = " ".join(t[at : at + k - 1])
                    score += segment_score(known.get(s, 0), known.get(prefix, 0) if prefix else None, total)
                    at += k
                out.append((sub, "|".join(best), round(score, 6)))
            yield pd.DataFrame(out, columns=["sub_id", "segments", "score"])

    return rows.mapInPandas(run, "sub_id long, segments string, score double")
