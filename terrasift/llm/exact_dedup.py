"""Exact duplicates by a content sort (DataFrame functions only).

Sampled splitters range-partition the rows by a short content key, the external sort of each
partition places equal normalised texts side by side, and a window over the whole normalised
text compares neighbours in full. A content key that holds many rows is salted by identifier,
so that its rows spread over many partitions; what its parts found is then summed by digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import saved

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Non-ASCII characters other than lower-case letters, caseless letters and punctuation, which lower() might change.
_CASED = r"[\P{ASCII}&&[^\p{Ll}\p{Lo}\p{P}]]"
HOT_KEYS = 1024
HOT_ROWS = 256
SALTS = 64


def normalised(text: Column) -> Column:
    """Null as empty, A-Z lowered and nothing else. lower() is used where it does just that."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(text.rlike(_CASED), F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.lower(text))


def content_key(text: Column) -> Column:
    """A short key that equal normalised texts share: bytes of a head, middle and tail, and the length."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    n = F.length(text)
    cut = lambda at, size: F.lower(F.substring(text, at, F.lit(size)) if not isinstance(at, int) else F.substring(text, at, size))
    middle, tail = (n / 2).cast("int") + 1, F.greatest(n - 63, F.lit(1))
    return F.struct(cut(1, 16).alias("head"), F.xxhash64(n, cut(1, 256), cut(middle, 256), cut(tail, 64)).alias("rest"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", payload: bool = False) -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lowering A-Z; null is the empty text. The row with the
    largest id stays (null ids last; of repeated rows with that id, one). With payload=True the
    input's columns come as a struct named `row` and only rows that may stay are returned.
    An empty table gives an empty result; other columns are not looked at.
    """
    spark = df.sparkSession
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                    *([F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text_col]).alias("row")] if payload else []))
    hot = (
        src.groupBy(F.xxhash64(content_key(F.col("text"))).alias("hot_key")).count()
        .where(F.col("count") >= HOT_ROWS).orderBy(F.desc("count"), "hot_key").limit(HOT_KEYS)  # at most 1024 rows: safe to broadcast
        .select("hot_key", F.lit(True).alias("salted"))
    )
    keyed = src.withColumn("k", content_key(F.col("text")))
    keyed = (
        keyed.join(F.broadcast(hot), F.xxhash64("k") == F.col("hot_key"), "left")
        .withColumn("salted", F.coalesce("salted", F.lit(False)))
        .withColumn("salt", F.when(F.col("salted"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(0)))
        .select("doc_id", "text", *(["row"] if payload else []), "salted", "salt", F.col("k.head").alias("head"), F.col("k.rest").alias("rest"))
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(n, "head", "rest", "salt").withColumn("norm", normalised(F.col("text")))
    same = Window.partitionBy("head", "rest", "salt", "norm")
    first = same.orderBy(F.col("doc_id").desc_nulls_last())
    found = (
        dealt.withColumn("rn", F.row_number().over(first))
        .withColumn("part_keep", F.first("doc_id").over(first))
        .withColumn("part_size", F.count(F.lit(1)).over(same))
        .select("doc_id", *(["text", "row"] if payload else []), "salted", "rn", "part_keep", "part_size",
                F.sha2(F.col("norm"), 256).alias("text_sha256"))
    )
    parts = saved(found.where("rn = 1") if payload else found, "content-sort")
    # Parts of salted keys meet again by digest: one row for each part, so at most SALTS for each text.
    whole = (
        parts.where("salted and rn = 1").groupBy("text_sha256")
        .agg(F.max("part_keep").alias("keep"), F.sum("part_size").alias("size"))
        .select(F.col("text_sha256").alias("sha"), "keep", "size")
    )
    whole = saved(whole, "content-sums")
    cols = ["text", "row"] if payload else []
    plain = parts.where("not salted").select(
        "doc_id", *cols, F.col("part_keep").alias("keep_id"), F.col("part_size").alias("group_size"), (F.col("rn") == 1).alias("kept"), "text_sha256")
    hots = parts.where("salted").join(whole, F.col("text_sha256") == F.col("sha"), "left").select(
        "doc_id", *cols, F.col("keep").alias("keep_id"), F.col("size").alias("group_size"),
        ((F.col("rn") == 1) & F.col("doc_id").eqNullSafe(F.col("keep"))).alias("kept"), "text_sha256")
    return plain.unionByName(hots)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with df's columns."""
    out = exact_groups(df, id_col, text_col, payload=True).where("kept")
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns])


ORACLE = """
with n as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
from n window w as (partition by t)
"""
