"""Writers: results, evaluations, decision logs, neighbour files, crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def result_lines(rows: DataFrame) -> DataFrame:
    """doc_id, title, score, page_rank and num_views by tabs."""
    return rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("doc_id", "title", "score", "page_rank", "num_views")]).alias("line"))


def write_lines(lines: DataFrame, path: str, mode: str = "append") -> None:
    lines.write.mode(mode).text(path)


def write_tsv(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).csv(path, sep="\t")


def neighbour_lines(near: DataFrame) -> DataFrame:
    """id,n1:n2:… in rank order."""
    s = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "near_id"))).alias("n"))
    return s.select(F.concat(F.col("id").cast("string"), F.lit(","), F.array_join(F.transform("n", lambda x: x["near_id"].cast("string")), ":")).alias("line"))


def write_pages(pages: DataFrame, path: str) -> None:
    """Kept pages by host, under their file names."""
    from terrasift.functions.text import url_host
    pages.select(url_host(F.col("url")).alias("host"), "file", "html").write.mode("overwrite").partitionBy("host").parquet(path)
