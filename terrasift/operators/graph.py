"""Link graphs: extraction, redirect folding, page rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terrasift.functions import text as T
from terrasift.sources.store import stored


def page_edges(pages: DataFrame, pattern: str = T.STRICT_LINK, corpus: DataFrame | None = None) -> DataFrame:
    """(src, dst) from (page, html): distinct, without self-links and targets that start with a dot.
    With corpus (page), targets are kept only if they name a page, as is or with .html."""
    links = pages.select(F.col("page").alias("src"), F.explode(T.link_targets(F.col("html"), pattern)).alias("dst")).where("dst <> '' and dst not like '.%'")
    if corpus is not None:
        names = corpus.select(F.col("page").alias("dst")).union(corpus.where("page like '%.html'").select(F.regexp_replace("page", r"\.html$", "").alias("dst"))).distinct()
        links = links.join(names, "dst", "left_semi").select("src", "dst")
    return links.where("src <> dst").distinct()


def redirects(pages: DataFrame) -> DataFrame:
    """(alias, canonical): pages whose title names another file."""
    t = pages.select(F.col("page").alias("alias"), T.redirect_key(T.html_title(F.col("html"))).alias("canonical"))
    return t.where("canonical <> '' and lower(alias) <> canonical")


def fold(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges with aliases replaced by what they stand for, distinct, without self-links."""
    a = aliases.groupBy("alias").agg(F.min("canonical").alias("canonical"))
    s = a.select(F.col("alias").alias("src"), F.col("canonical").alias("new_src"))
    d = a.select(F.col("alias").alias("dst"), F.col("canonical").alias("new_dst"))
    out = edges.join(s, "src", "left").join(d, "dst", "left")
    return out.select(F.coalesce("new_src", "src").alias("src"), F.coalesce("new_dst", "dst").alias("dst")).where("src <> dst").distinct()


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("v")).union(edges.select(F.col("dst").alias("v"))).distinct()


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("out_degree"))


def in_weight(edges: DataFrame) -> DataFrame:
    """(v, s): the sum over inward links of 1 / out-degree of their source."""
    return edges.join(out_degree(edges), "src").groupBy(F.col("dst").alias("v")).agg(F.sum(1.0 / F.col("out_degree")).alias("s"))


def pagerank_parity(edges: DataFrame, damping: float = 0.9) -> DataFrame:
    """(v, rank) = ((1-d) + d s)(1 + d s) / n: two passes in which a vertex's own score is passed on, in closed form."""
    v = vertices(edges)
    n = v.count()
    s = F.coalesce("s", F.lit(0.0))
    return v.join(in_weight(edges), "v", "left").select("v", ((F.lit(1 - damping) + damping * s) * (1 + damping * s) / F.lit(float(n))).alias("rank"))


def pagerank(edges: DataFrame, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """The usual page rank; vertices without outward links give their share to all. Each pass is a
    written table (in the shared checkpoint folder), so lineage stays short and executors may go."""
    v = vertices(edges).cache()
    n = v.count()
    if not n:
        return v.select("v", F.lit(0.0).alias("rank"))
    weighted = edges.join(out_degree(edges), "src").select("src", "dst", (1.0 / F.col("out_degree")).alias("w")).cache()
    dangling = v.join(edges.select(F.col("src").alias("v")).distinct(), "v", "left_anti").cache()
    rank = v.select("v", F.lit(1.0 / n).alias("rank"))
    for i in range(iterations):
        lost = rank.join(dangling, "v").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        got = weighted.join(rank, weighted["src"] == rank["v"]).groupBy("dst").agg(F.sum(F.col("w") * F.col("rank")).alias("got"))
        rank = v.join(got, v["v"] == got["dst"], "left").select(
            "v", (F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if (i + 1) % 5 == 0:
            rank = stored(rank, "rank")
    return rank
