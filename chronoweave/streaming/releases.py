"""Incremental releases: an extension. A stream of id rows keeps a table of births by version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def id_counts(stream: DataFrame, watermark: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Events of each type in tumbling windows, late ones dropped after the watermark; works on batches too."""
    d = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    d = d.withWatermark("ts", watermark) if d.isStreaming else d
    return d.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def append_releases(stream: DataFrame, path: str, checkpoint: str):
    """Keeps a table of (release, stable_id, version), one row an id and release, under path. A micro-batch brings rows of
    any releases: those of its releases that are there already stay, so a release may come in several batches; of an id
    that comes twice the later batch counts. A batch is written beside the table under its number and a restart replays
    it to the same rows, so nothing is lost or doubled; read_releases() takes the last row of each id."""

    def save(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(["release", "stable_id"]).withColumn("batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "release").parquet(path)

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_releases(spark: SparkSession, path: str) -> DataFrame:
    """(release, stable_id, version) as all batches so far have left it."""
    rows = spark.read.parquet(path)
    return rows.groupBy("release", "stable_id").agg(F.max_by("version", "batch").alias("version"))
