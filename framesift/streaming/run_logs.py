"""Windowed accuracy over a stream of scored samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts timestamp, dataset string, sample_id string, is_correct boolean"


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(path)


def windowed_accuracy(scores: DataFrame, *, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Per window and dataset; a sample reported again within the delay counts once. State ends with the watermark."""
    once = scores.withWatermark("ts", late).dropDuplicatesWithinWatermark(["dataset", "sample_id"])
    grouped = once.groupBy(F.window("ts", window), "dataset").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("correct"))
    return grouped.select(F.col("window.start").alias("start"), "dataset", "n", (100.0 * F.col("correct") / F.col("n")).alias("accuracy"))
