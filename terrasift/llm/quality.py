"""Quality selection by importance resampling.

Two generative models over hashed word n-grams (one and two tokens, BUCKETS buckets) are fitted:
the target's on documents labelled good, the raw one on all documents. A document's score is its
log importance weight, the sum over its n-grams of the log ratio of the two. k documents are drawn
without replacement with probabilities proportional to their weights, by the Gumbel top-k trick:
the k greatest of score plus Gumbel noise from a seeded hash. k is a budget, a share of all rows:
that of labelled documents worth keeping, and SLACK of the others', so that few good ones are lost.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BYTE_VALUE, PART_BYTES, SPACE, free_name, mix64, powers, saved, text_parts
from .mixing import uniform

BUCKETS = 10_000
#: At most so many labelled documents fit the target model and the budget: those of least hash.
LABELLED = 20_000
#: Of the share of labelled documents that are bad, what the budget leaves room for beside the good ones.
SLACK = 0.1
BINS = 2000

_KIND = np.full(256, 1, np.uint8)
_KIND[:128] = [2 if not chr(c).isalnum() and c != 95 else 1 for c in range(128)]
_KIND[SPACE] = 0


def features(data: np.ndarray, offs: np.ndarray):
    """Bucket and row of each token and each pair of neighbours. Tokens are runs of word bytes
    (letters, digits, _ and all beyond ASCII) or of other visible ones; case counts."""
    z = np.zeros(0, np.int64)
    if not len(data):
        return z, z
    kind = _KIND[data]
    first = kind != 0
    first[1:] &= kind[1:] != kind[:-1]
    heads = offs[:-1][offs[:-1] < offs[1:]]
    first[heads] |= kind[heads] != 0
    at = np.flatnonzero(first)
    if not len(at):
        return z, z
    pos = np.arange(len(data))
    pos[at[0] :] -= np.repeat(at, np.diff(np.append(at, len(data))))
    value = np.where(kind != 0, BYTE_VALUE[data], 0).astype(np.uint64) * powers(int(pos.max()) + 1)[pos]
    h = mix64(np.add.reduceat(value, at))
    row = np.searchsorted(offs, at, "right") - 1
    near = row[1:] == row[:-1]
    two = mix64(h[:-1][near] * np.uint64(3) + h[1:][near])
    return (np.concatenate([h, two]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([row, row[1:][near]])


def _labelled(labels: DataFrame) -> DataFrame:
    """(label_id, fine, good): fine if every label says quality 1, good if none says toxic besides; documents
    whose labels disagree on quality are left out. Bounded by LABELLED."""
    return (
        labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg(F.min("quality").alias("q0"), F.max("quality").alias("q1"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
        .where("q0 = 1 or q1 = 0").select("label_id", (F.col("q0") == 1).alias("fine"), ((F.col("q0") == 1) & (F.col("t") == 0)).alias("good"))
        .orderBy(F.md5(F.col("label_id").cast("string")), "label_id").limit(LABELLED)
    )


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """The log ratio of each bucket, and the labelled sample (saved, at most LABELLED rows)."""
    sample = saved(_labelled(labels), "labelled")
    flagged = df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(sample.where("good")), F.col("i") == F.col("label_id"), "left").select("t", F.coalesce("good", F.lit(False)).alias("g"))

    def count(batches):
        raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for batch in batches:
            good = np.asarray(batch.column(1))
            for at, data, offs in text_parts(batch.column(0), PART_BYTES):
                b, row = features(data, offs)
                raw += np.bincount(b, minlength=BUCKETS)
                target += np.bincount(b[good[at + row]], minlength=BUCKETS)
        has = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(raw[has].astype(np.int64)), pa.array(target[has].astype(np.int64))], ["bucket", "raw", "target"])

    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    sums = flagged.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    seen = 0
    for r in sums.collect():  # at most BUCKETS rows
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
        seen += r.target
    if not seen:
        return np.zeros(BUCKETS), sample
    return np.log(target / target.sum()) - np.log(raw / raw.sum()), sample


def scorer(ratio: np.ndarray):
    """A column function: the score of a text column (null and empty texts 0)."""
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        for at, data, offs in text_parts(texts, PART_BYTES):
            b, row = features(data, offs)
            n = len(offs) - 1
            out[at : at + n] = np.bincount(row, ratio[b], n)
        return pa.array(out)

    return score


def budget(sample: DataFrame) -> float:
    """The share of all rows to draw; 1 without labels of both kinds."""
    fine, every = sample.agg(F.coalesce(F.sum(F.col("fine").cast("int")), F.lit(0)), F.count(F.lit(1))).first()
    return 1.0 if fine in (0, every) else (fine + SLACK * (every - fine)) / every


def gumbel_key(score, ident, seed: str):
    u = uniform(F.lit(seed), F.coalesce(ident.cast("string"), F.lit("null")))
    return score - F.log(-F.log(u))


def kth_largest(df: DataFrame, key: str, k: int, few: int = 10_000) -> float:
    """The exact k-th largest value, by histograms of BINS bins that zoom in on it."""
    if k <= 0:
        return float("inf")
    lo, hi, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n or k >= n:
        return float("-inf")
    above = 0  # values greater than hi
    while True:
        inside = df.where((F.col(key) >= lo) & (F.col(key) <= hi))
        b = F.least(F.floor((F.col(key) - F.lit(lo)) / F.lit(hi - lo) * BINS), F.lit(BINS - 1))
        if lo == hi:
            return lo
        rows = inside.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy(F.desc("b")).collect()
        for r in rows:
            if above + r.n >= k:
                lo, hi, n = r.lo, r.hi, r.n
                break
            above += r.n
        if n <= few:
            got = [r[0] for r in df.where((F.col(key) >= lo) & (F.col(key) <= hi)).select(key).collect()]
            return sorted(got, reverse=True)[k - above - 1]


def select_quality(df: DataFrame, labels: DataFrame, seed: str = "quality", id_col: str = "doc_id", text_col: str = "text"):
    """(table, ratio, least key). The table has a row for each row of df: doc_id, score, draw_key, kept.

    Null and empty texts score 0. Rows with one id share the noise; rows tied at the k-th key are
    all kept. Null ids share the noise of 'null'. Without good and bad labels all are kept.
    """
    ratio, sample = fit(df, labels, id_col, text_col)
    score = scorer(ratio)
    scored = saved(df.select(F.col(id_col).cast("long").alias("doc_id"), score(F.col(text_col).cast("string")).alias("score"))
                   .withColumn("draw_key", gumbel_key(F.col("score"), F.col("doc_id"), seed)), "scores")
    share = budget(sample)
    least = float("-inf") if share == 1 else kth_largest(scored, "draw_key", ceil(share * scored.count()))
    return scored.withColumn("kept", F.col("draw_key") >= F.lit(least)), ratio, least


def quality_filter(df: DataFrame, labels: DataFrame, seed: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows that are kept, with df's columns. Scores are computed again on the way, which is cheaper than joining texts."""
    _, ratio, least = select_quality(df, labels, seed, id_col, text_col)
    s = free_name(df, "score")
    out = df.withColumn(s, scorer(ratio)(F.col(text_col).cast("string")))
    return out.where(gumbel_key(F.col(s), F.col(id_col).cast("long"), seed) >= F.lit(least)).select(*[F.col(f"`{c}`") for c in df.columns])
