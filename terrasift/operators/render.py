"""Presentation: GeoJSON and HTML."""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame, functions as F

from terrasift.functions.text import display_clean


def feature(kind: str, *more: Column) -> Column:
    """One GeoJSON feature of a gazetteer row as JSON text."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    props = F.struct(F.col("name"), F.lit(kind).alias("type"), *more, F.col("population"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("id").cast("string").alias("id"), point.alias("geometry"), props.alias("properties")), {"ignoreNullFields": "false"})


def collection(rows: DataFrame, by: str = "query") -> DataFrame:
    """rows (by, ord, feature) to one FeatureCollection for each `by`, in ord's order. Places of a query are few."""
    parts = rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("ord", "feature"))).alias("f"))
    return parts.select(by, F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("f", lambda x: x["feature"]), ","), F.lit("]}")).alias("geojson"))


def primary_and_expanded(rows: DataFrame) -> DataFrame:
    """rows (query, ord, gazetteer columns): the first is primary, the rest expanded with their search terms."""
    f = F.when(F.col("ord") == 0, feature("primary")).otherwise(feature("expanded", F.lower("name").alias("addl_terms")))
    return collection(rows.select("query", "ord", f.alias("feature")))


def candidates(rows: DataFrame) -> DataFrame:
    """rows (query, ord, gazetteer columns, unique_name)."""
    return collection(rows.select("query", "ord", feature("candidate", F.col("state_name").alias("state"), F.col("unique_name").alias("addl_terms")).alias("feature")))


def nearby(rows: DataFrame) -> DataFrame:
    f = F.when(F.col("ord") == 0, feature("primary")).otherwise(feature("expanded"))
    return collection(rows.select("query", "ord", f.alias("feature")))


def html_row(title: Column, url: Column, score: Column) -> Column:
    return F.concat(F.lit('<li><a href="'), url, F.lit('">'), F.replace(title, F.lit("_wiki_"), F.lit("")), F.lit("</a> <small>"), score.cast("string"), F.lit("</small></li>"))


_PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>{title}</title></head>
<body><form action="/search"><input name="query" value="{query}"></form>
{body}
{footer}
</body></html>
"""


def page(query: str, mode: str, results: list[dict], geojson: str | None = None, suggestions: list[str] | None = None, place_ids: list[int] | None = None) -> str:
    """The page of a query: plain results; with a map of candidates to choose from when its place is
    ambiguous; with a map of places and a link to the best results of all when it was expanded."""
    rows = "\n".join(f'<li><a href="{escape(str(r.get("url") or ""))}">{escape(str(r.get("title") or r["doc_id"]))}</a> <small>{r["score"]}</small></li>' for r in results)
    body = f"<ol>{rows}</ol>"
    data = f'<script type="application/geo+json" id="places">{(geojson or "").replace("<", chr(92) + "u003c")}</script><div id="map"></div>'
    if mode == "AMBIGUOUS":
        body = f"<p>Which {escape(query)} did you mean?</p>{data}{body}"
    elif mode == "EXPANSION":
        ids = ",".join(map(str, place_ids or []))
        body = f'{data}<p><a href="/search?query={escape(query)}&amp;best=true&amp;place={ids}">See all results</a></p>{body}'
    footer = ""
    if suggestions:
        footer = "<div><em>Most Probable Locations:</em><ol>" + "".join(f"<li>{escape(s)}</li>" for s in suggestions) + "</ol></div>"
    return _PAGE.format(title=escape(query), query=escape(query, quote=True), body=body, footer=footer)


__all__ = ["candidates", "collection", "display_clean", "feature", "html_row", "nearby", "page", "primary_and_expanded"]
