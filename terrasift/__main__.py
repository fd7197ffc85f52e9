"""python -m terrasift --options FILE --mode mining|index|load_places|search|serve …"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from .engine import Engine
from .operators import evaluate, geo as geo_operators
from .sources import readers, sinks


def with_page_rank(pages: DataFrame, path: str) -> DataFrame:
    """The corpus with the page rank that mining wrote, 0 where it has none; as it is if nothing was mined."""
    spark = pages.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return pages
    mined = spark.read.parquet(path).select(F.col("v").alias("file_name"), F.col("rank").alias("page_rank"))
    return pages.drop("page_rank").join(mined, "file_name", "left").withColumn("page_rank", F.coalesce("page_rank", F.lit(0.0)))


def show(table: DataFrame, out: str | None) -> None:
    """By tabs, appended to a folder or printed; a row a query."""
    if out:
        sinks.write_tsv(table, out)
    else:
        for r in table.toLocalIterator():
            print(*r, sep="\t")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="terrasift")
    p.add_argument("--options", required=True)
    p.add_argument("--mode", required=True, choices=["mining", "index", "load_places", "search", "serve", "evaluate", "spearman", "neighbours"])
    p.add_argument("--port", type=int, default=25804)
    p.add_argument("--request", default="", help="query=…&numdocs=…&ranker=…&format=text|html&place=…&best=…&uname=…")
    p.add_argument("--cities")
    p.add_argument("--counties")
    p.add_argument("--states")
    p.add_argument("--neighbours")
    p.add_argument("--results", help="ranked results to evaluate (query, doc by tabs)")
    p.add_argument("--judgments", help="query, doc, grade by tabs")
    p.add_argument("--metric", type=int, default=7)
    p.add_argument("--x", help="score vectors to correlate, a number a line")
    p.add_argument("--y")
    p.add_argument("--out", help="folder that the evaluation or the neighbour lines are appended to")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("terrasift").getOrCreate()
    o = readers.read_options(spark, a.options)
    geo = near = None
    if a.cities and a.counties and a.states:
        geo = Engine.load_places(readers.cities(spark, a.cities), readers.counties(spark, a.counties), readers.states(spark, a.states)).cache()
        near = readers.neighbour_file(spark, a.neighbours) if a.neighbours else None
    if a.mode == "load_places":
        print(geo.count() if geo is not None else 0)
    elif a.mode == "evaluate":
        table = evaluate.evaluate(readers.ranked_results(spark, a.results), readers.judgments(spark, a.judgments), a.metric)
        if "eleven_point" in table.columns:
            table = table.withColumn("eleven_point", F.array_join(F.transform("eleven_point", lambda x: F.round(x["precision"], 6).cast("string")), " "))
        show(table, a.out)
    elif a.mode == "spearman":
        x, y = (readers.score_vector(spark, f).withColumnRenamed("score", c) for f, c in ((a.x, "x"), (a.y, "y")))
        show(evaluate.spearman(x.join(y, "doc")), a.out)
    elif a.mode == "neighbours":
        near = geo_operators.neighbours(readers.cities(spark, a.cities).select("id", "x", "y", "population"))
        lines = sinks.neighbour_lines(near)
        if a.out:
            sinks.write_lines(lines, a.out)
        else:
            print(*(r[0] for r in lines.toLocalIterator()), sep="\n")
    elif a.mode == "mining":
        pages = readers.html_corpus(spark, o["corpus_prefix"]).selectExpr("file_name as page", "html")
        Engine.mine(pages).write.mode("overwrite").parquet(f"{o['index_prefix']}/page_rank")
    elif a.mode == "index":
        Engine.index(with_page_rank(readers.html_corpus(spark, o["corpus_prefix"]), f"{o['index_prefix']}/page_rank"), geo, near, o["index_prefix"])
    else:
        e = Engine.load(spark, o["index_prefix"], geo, near)
        if a.mode == "serve":
            from .server import make_server
            make_server(e, a.port).serve_forever()
        r = readers.parse_request(a.request)
        answer = e.search(r["query"], r["numdocs"], r["ranker"], r["place"], r["best"], r["uname"])
        if r["format"] == "html":
            print(e.html(answer))
        else:
            from .sources.sinks import result_lines
            for line in result_lines(answer.results).collect():
                print(line[0])


if __name__ == "__main__":
    main()
