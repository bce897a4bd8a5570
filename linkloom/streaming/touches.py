"""Streams over the events table: windows, sessions, dedup and saliency state with watermarks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators import saliency
from linkloom.shared import shared_folder
from linkloom.sources.tables import epoch


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")  # a glob takes a file or a folder
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total): tumbling windows, late rows within the watermark counted."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): sessions a user, closed by a silence of `gap`."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("end"), "n")


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first of rows with the same id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def touched(events: DataFrame) -> DataFrame:
    """Saliency states after each batch, a row a touched user."""
    t = events.select(F.col("user_id").cast("string").alias("node_id"), epoch(F.col("ts").cast("timestamp_ntz")).alias("at"), F.lit(1).cast("long").alias("delta"))
    return saliency.stream_fold(t)


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, exactly once, into the shared folder; the written rows."""
    spark = stream.sparkSession
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    query.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows/*")
