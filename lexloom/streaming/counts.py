"""Counts of tokens over a stream of documents: the batch aggregates, merged batch by batch.

The engine's aggregates are sums, so a stream keeps a table of partial counts: each micro-batch appends its own under
its number, and a batch that is run again replaces what it wrote before. Reading adds the parts up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators import corpus


def count_tokens(docs: DataFrame, folder: str, checkpoint: str, least: int = 1) -> StreamingQuery:
    """docs: a stream of (doc_id, text). Runs through what there is and stops."""

    def one(batch: DataFrame, number: int) -> None:
        toks = corpus.tokens(corpus.sentences(batch), least)
        corpus.token_counts(toks).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)

    return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.merge_counts(spark.read.schema("token string, cn long, batch int").parquet(folder))


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """events: a stream (or table) of (ts, event_type, value) -> counts and sums by tumbling window and type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
