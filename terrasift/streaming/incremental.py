"""Incremental indexing: each micro-batch of documents adds its rows to the index's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from terrasift.operators.index import Index, build_index, derive


def start(source: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """From a stream (doc_id, text and, where there, title, url, …) into <path>/docs and
    <path>/occurrences, a folder for each batch, so that a batch that is run again replaces its own
    rows. The dictionary and totals are derived when read. trigger: as for DataStreamWriter.trigger."""
    def add(batch: DataFrame, batch_id: int) -> None:
        ix = build_index(batch)
        for name, df in (("docs", ix.docs), ("occurrences", ix.occurrences)):
            df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")

    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def load(spark: SparkSession, path: str) -> Index:
    """The index over all batches; of a document that came again the latest batch counts."""
    docs = spark.read.parquet(f"{path}/docs")
    latest = docs.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    docs = docs.join(latest, ["doc_id", "batch"], "left_semi").drop("batch")
    occurrences = spark.read.parquet(f"{path}/occurrences").join(latest, ["doc_id", "batch"], "left_semi").select("term", "doc_id", "pos")
    return derive(docs, occurrences)


def view_counts(events: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """A stream of events (ts, user_id, event_type) to views by time window and user."""
    return (
        events.where("event_type = 'view'").withWatermark("ts", lateness)
        .groupBy(F.window("ts", window), F.col("user_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("num_views"))
    )
