"""Continuous ingest and windows over streams."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from corpusmill.operators.encode import Encoder, hashing_encoder
from corpusmill.plans.pipeline import ingest

PARTS = 256


def ingest_stream(pages: DataFrame, folder: str, checkpoint: str, encoder: Encoder = hashing_encoder) -> DataStreamWriter:
    """Writer that ingests each micro-batch of ``pages`` once: a batch's chunks and hashes are written under its number,
    so a batch that is repeated after a failure replaces itself. Of the history only the parts are read that hold urls of
    the batch (``PARTS`` by hash of the url)."""

    def part(url: str) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(PARTS)).cast("int")

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        wanted = [r[0] for r in batch.select(part("url").alias("part")).distinct().collect()]  # at most PARTS numbers
        try:
            history = spark.read.parquet(f"{folder}/documents").where((F.col("batch") < number) & F.col("part").isin(wanted)).where("state in ('ok', 'unchanged', 'quality_rejected')")
            known = history.groupBy("url").agg(F.max_by(F.when(F.col("state") != "quality_rejected", F.col("content_hash")), "batch").alias("embedded_hash"))
        except Exception as x:
            if "PATH_NOT_FOUND" not in str(x):
                raise
            known = None
        done = ingest(batch, known, encoder)
        done.documents.withColumn("part", part("url")).write.mode("overwrite").partitionBy("part").parquet(f"{folder}/documents/batch={number}")
        done.chunks.write.mode("overwrite").parquet(f"{folder}/chunks/batch={number}")
        batch.unpersist()

    return pages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def request_windows(events: DataFrame, user: str = "user_id", at: str = "ts", minutes: int = 10, late: str = "30 minutes") -> DataFrame:
    """user, window_start, n_requests of a stream (or table); rows later than ``late`` are left out of a stream."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    out = timed.groupBy(F.col(user).alias("user_id"), F.window("_at", f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n_requests"))
    return out.select("user_id", F.col("w.start").alias("window_start"), "n_requests")


def weekly_counts(questions: DataFrame, topic: str = "topic_label", at: str = "asked_at", late: str = "14 days") -> DataFrame:
    """week_start, topic, size of a stream of questions; weeks start on Monday."""
    timed = questions.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    out = timed.groupBy(F.window("_at", "7 days", startTime="4 days").alias("w"), F.coalesce(topic, F.lit("unknown")).alias("topic")).agg(F.count("*").alias("size"))
    return out.select(F.col("w.start").cast("date").alias("week_start"), "topic", "size")
