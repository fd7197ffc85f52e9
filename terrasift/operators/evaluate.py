"""Retrieval metrics over ranked results and graded judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrasift.functions.text import grade_gain, grade_relevant
from terrasift.sources.store import stored

METRICS = {-1: "instructor", 0: "precision", 1: "recall", 2: "f_measure", 3: "eleven_point", 4: "average_precision", 5: "ndcg", 6: "reciprocal_rank", 7: "all"}
CUTS = (1, 5, 10)
IDEAL_GAIN = 10


def judged(results: DataFrame, judgments: DataFrame) -> DataFrame:
    """results (query, doc_id, rank) with rel, gain, and the running precision and recall at each rank."""
    j = judgments.select("query", "doc_id", grade_relevant(F.col("grade")).alias("rel"), grade_gain(F.col("grade")).alias("gain"))
    total = j.groupBy("query").agg(F.sum("rel").alias("n_relevant"))
    w = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    out = results.join(j, ["query", "doc_id"], "left").join(total, "query", "left")
    out = out.select("query", "doc_id", "rank", F.coalesce("rel", F.lit(0)).alias("rel"), F.coalesce("gain", F.lit(0)).alias("gain"), F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"))
    out = out.withColumn("hits", F.sum("rel").over(w))
    return out.withColumn("precision", F.col("hits") / F.col("rank")).withColumn(
        "recall", F.when(F.col("n_relevant") > 0, F.col("hits") / F.col("n_relevant")).otherwise(F.lit(0.0)))


def _at(col: str, k: int) -> Column:
    """The value at rank k; null for fewer results."""
    return F.max(F.when(F.col("rank") == k, F.col(col)))


def _f(p: Column, r: Column, alpha: float = 0.5) -> Column:
    return F.when(p.isNull() | r.isNull(), None).when((p == 0) | (r == 0), 0.0).otherwise(1 / (F.lit(alpha) / p + F.lit(1 - alpha) / r))


def precision_recall(j: DataFrame) -> DataFrame:
    return j.groupBy("query").agg(*[_at(c, k).alias(f"{c}_{k}") for c in ("precision", "recall") for k in CUTS])


def f_measure(j: DataFrame, alpha: float = 0.5) -> DataFrame:
    p = precision_recall(j)
    return p.select("query", *[_f(F.col(f"precision_{k}"), F.col(f"recall_{k}"), alpha).alias(f"f_{k}") for k in CUTS])


def eleven_point(j: DataFrame) -> DataFrame:
    """(query, level, precision): the best precision at a recall of at least level."""
    levels = F.explode(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: i / 10.0)).alias("level")
    return j.select("query", "precision", "recall", levels).groupBy("query", "level").agg(
        F.coalesce(F.max(F.when(F.col("recall") >= F.col("level"), F.col("precision"))), F.lit(0.0)).alias("precision"))


def average_precision(j: DataFrame) -> DataFrame:
    """The mean of the precision at every rank."""
    return j.groupBy("query").agg(F.avg("precision").alias("average_precision"))


def ndcg(j: DataFrame) -> DataFrame:
    """With the ideal gain at every rank; null for fewer results than k."""
    d = F.log2(F.col("rank") + 1)
    return j.groupBy("query").agg(*[
        F.when(F.max("rank") >= k, F.sum(F.when(F.col("rank") <= k, F.col("gain") / d)) / F.sum(F.when(F.col("rank") <= k, IDEAL_GAIN / d))).alias(f"ndcg_{k}") for k in CUTS])


def reciprocal_rank(j: DataFrame) -> DataFrame:
    return j.groupBy("query").agg(F.coalesce(1.0 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"))


def instructor(j: DataFrame) -> DataFrame:
    """The mean relevance of what was returned."""
    return j.groupBy("query").agg(F.avg("rel").alias("mean_relevance"))


def evaluate(results: DataFrame, judgments: DataFrame, metric: int = 7) -> DataFrame:
    """The metric by its number; 7 joins all but the instructor's."""
    j = judged(results, judgments)
    one = {-1: instructor, 0: precision_recall, 1: precision_recall, 2: f_measure, 4: average_precision, 5: ndcg, 6: reciprocal_rank}
    if metric == 3:
        return eleven_point(j)
    if metric in (0, 1):
        kind = METRICS[metric]
        return precision_recall(j).select("query", *[f"{kind}_{k}" for k in CUTS])
    if metric in one:
        return one[metric](j)
    if metric != 7:
        raise ValueError(f"no metric {metric}")
    points = eleven_point(j).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("level", "precision"))).alias("eleven_point"))
    out = precision_recall(j)
    for more in (f_measure(j), points, average_precision(j), ndcg(j), reciprocal_rank(j)):
        out = out.join(more, "query")
    return out


def spearman(scores: DataFrame, integer_mean: bool = True) -> DataFrame:
    """Rank correlation of x and y over (doc, x, y): ranks 1..n by falling value, ties by doc.
    integer_mean keeps a mean of n // 2 for both; otherwise the usual one."""
    n = scores.count()
    if n < 2:
        return scores.agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("rho"))
    ranked = _global_rank(_global_rank(scores, "x", "rx"), "y", "ry")
    z = float(n // 2) if integer_mean else (n + 1) / 2
    a, b = F.col("rx") - F.lit(z), F.col("ry") - F.lit(z)
    return ranked.agg(F.count(F.lit(1)).alias("n"), (F.sum(a * b) / F.sqrt(F.sum(a * a) * F.sum(b * b))).alias("rho"))


def _global_rank(df: DataFrame, by: str, name: str) -> DataFrame:
    """1..n by falling `by`, ties by doc, without one task for all rows: ranks within range
    partitions plus the number of rows in those before."""
    dealt = df.repartitionByRange(F.col(by).desc(), F.col("doc")).withColumn("__part", F.spark_partition_id())
    dealt = stored(dealt, "rank-ranges")
    within = Window.partitionBy("__part").orderBy(F.col(by).desc(), "doc")
    sizes = dealt.groupBy("__part").count()  # a row a partition, so it may go to one task and to all of them
    shift = sizes.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__before"))
    return dealt.join(F.broadcast(shift), "__part").withColumn(name, F.row_number().over(within) + F.col("__before")).drop("__part", "__before")
