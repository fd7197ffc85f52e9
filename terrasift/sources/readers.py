"""Readers: options, corpora, gazetteer files, judgments, results, score vectors, indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrasift.functions import text as T

OPTION_KEYS = ["corpus_prefix", "log_prefix", "index_prefix", "indexer_type", "corpus_analyzer_type", "log_miner_type"]


def parse_options(lines) -> dict[str, str]:
    """key:value lines; # starts a comment line; the first colon splits. All keys must be there."""
    out = {}
    for line in lines:
        line = line.strip()
        if line and not line.startswith("#") and ":" in line:
            k, v = line.split(":", 1)
            out[k.strip()] = v.strip()
    if missing := [k for k in OPTION_KEYS if not out.get(k)]:
        raise ValueError(f"options lack {', '.join(missing)}")
    return out


def read_options(spark: SparkSession, path: str) -> dict[str, str]:
    return parse_options(r.value for r in spark.read.text(path).collect())  # an options file is a few lines


def parse_request(query_string: str) -> dict:
    """The arguments of a search request, with their defaults; bad numbers are ignored."""
    from urllib.parse import unquote_plus
    args: dict = {"query": "", "numdocs": 10, "numterms": 10, "ranker": "geocomprehensive", "format": "text", "place": None, "best": False, "uname": None}
    for part in query_string.split("&"):
        k, _, v = part.partition("=")
        k, v = k.lower(), unquote_plus(v)
        if k in ("numdocs", "numterms"):
            args[k] = int(v) if v.strip().isdigit() else args[k]
        elif k == "best":
            args[k] = v.lower() == "true"
        elif k == "place":
            args[k] = [int(x) for x in v.split(",") if x.strip().isdigit()] or None
        elif k == "uname":
            args[k] = [x for x in v.split(",") if x] or None
        elif k in args:
            args[k] = v
    return args


def html_corpus(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, file_name, title, url, text and html of the files below a folder, hidden ones left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    html = F.decode("content", "UTF-8")
    files = raw.where(~F.col("path").rlike(r"/\.[^/]*(/|$)")).select(name.alias("file_name"), F.col("path"), html.alias("html"))
    return files.select(F.xxhash64("path").alias("doc_id"), "file_name", T.html_title(F.col("html")).alias("title"), T.wiki_url(F.col("file_name")).alias("url"),
                        T.html_fields(F.col("html")).alias("text"), "html")


def page_corpus(pages: DataFrame) -> DataFrame:
    """The same from a table (page_id, url, html)."""
    return pages.select(F.col("page_id").alias("doc_id"), T.url_file(F.col("url")).alias("file_name"), T.html_title(F.col("html")).alias("title"), "url", T.html_fields(F.col("html")).alias("text"), "html")


def stop_words(spark: SparkSession, path: str) -> list[str]:
    return sorted({r.value.strip() for r in spark.read.text(path).collect() if r.value.strip()})


def cities(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, inferSchema=False)
    c = [F.col(f"`{n}`") for n in raw.columns]
    pick = {"x": (0, "double"), "y": (1, "double"), "id": (2, "long"), "name": (3, "string"), "lat": (5, "double"), "lon": (6, "double"), "country": (7, "string"),
            "admin1": (8, "string"), "admin2": (9, "string"), "population": (12, "int"), "elevation": (13, "int"), "timezone": (15, "string")}
    return raw.select(*[c[i].cast(t).alias(k) for k, (i, t) in pick.items()])


def _divisions(spark: SparkSession, path: str, header: bool) -> DataFrame:
    raw = spark.read.csv(path, header=header, inferSchema=False)
    c = [F.col(f"`{n}`") for n in raw.columns]
    return raw.select(c[0].alias("code"), c[2].alias("name"), c[3].cast("long").alias("id"), c[4].cast("double").alias("lon"), c[5].cast("double").alias("lat")).where(F.col("code").contains("US."))


def counties(spark: SparkSession, path: str) -> DataFrame:
    return _divisions(spark, path, header=False)


def states(spark: SparkSession, path: str) -> DataFrame:
    return _divisions(spark, path, header=True)


def neighbour_file(spark: SparkSession, path: str) -> DataFrame:
    """(id, near_id, rank) from lines id,n1:n2:…"""
    parts = spark.read.text(path).where(F.trim("value") != "").select(F.split("value", ",").alias("p"))
    return parts.select(F.col("p")[0].cast("long").alias("id"), F.posexplode(F.filter(F.split(F.coalesce(F.get("p", F.lit(1)), F.lit("")), ":"), lambda x: x != "")).alias("i", "n")).select(
        "id", F.col("n").cast("long").alias("near_id"), (F.col("i") + 1).alias("rank"))


def judgments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="query string, doc_id long, grade string")


def ranked_results(spark: SparkSession, path: str) -> DataFrame:
    """(query, doc_id, rank) from lines query, doc, …, in the file's order within a query."""
    from pyspark.sql import Window
    raw = spark.read.csv(path, sep="\t", schema="query string, doc_id long, rest string").withColumn("at", F.monotonically_increasing_id())
    return raw.select("query", "doc_id", F.row_number().over(Window.partitionBy("query").orderBy("at")).alias("rank"))


def score_vector(spark: SparkSession, path: str) -> DataFrame:
    """(doc, score) from one number a line; doc is the line's number among those that aren't blank, from 0. A file
    is read as one piece, since lines can be numbered only in order; what is read is a number a document."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("whole"))
    lines = F.filter(F.split("whole", "\n"), lambda x: F.trim(F.regexp_replace(x, "\r", "")) != "")
    return raw.select(F.posexplode(lines).alias("doc", "value")).select(F.col("doc").cast("long").alias("doc"), F.trim(F.regexp_replace("value", "\r", "")).cast("double").alias("score"))


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def fetch(url: str, timeout: float = 10.0) -> str:
    """One page over HTTP."""
    from urllib.request import urlopen
    with urlopen(url, timeout=timeout) as r:  # noqa: S310
        return r.read().decode("utf-8", "replace")
