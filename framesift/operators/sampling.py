"""First rows, seeded samples and splits. Draws are hashes, so a sample is the same in any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions.draws import digest

BUCKET_DIGITS = 3


def first_n(rows: DataFrame, n: int, *order: str) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def seeded_sample(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows without replacement."""
    return rows.orderBy(digest(seed, F.col(key)), key).limit(n)


def seeded_split(rows: DataFrame, ratio: float, seed: int, key: str) -> DataFrame:
    """Adds is_train: exactly int(n ratio) of n distinct keys, those with the smallest hashes. All rows of a key are on one side.

    No global order: distinct hashes are counted in 16**BUCKET_DIGITS buckets, whole buckets fall on one side of the cut, and only
    the rows of the one bucket that the cut goes through are ranked.
    """
    hashed = rows.withColumn("split_hash", digest(seed, F.col(key))).withColumn("split_bucket", F.substring("split_hash", 1, BUCKET_DIGITS))
    counts = hashed.groupBy("split_bucket").agg(F.count_distinct("split_hash").alias("split_n"))
    along = Window.orderBy("split_bucket")
    counts = counts.select("split_bucket", "split_n", (F.sum("split_n").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("split_n")).alias("split_before"), F.floor(F.sum("split_n").over(Window.partitionBy(F.lit(1))) * F.lit(ratio)).alias("split_cut"))
    placed = hashed.join(F.broadcast(counts), "split_bucket")  # at most 16**BUCKET_DIGITS rows
    through = (F.col("split_before") < F.col("split_cut")) & (F.col("split_before") + F.col("split_n") > F.col("split_cut"))
    inside = placed.where(through).withColumn("is_train", F.dense_rank().over(Window.partitionBy("split_bucket").orderBy("split_hash")) + F.col("split_before") <= F.col("split_cut"))
    whole = placed.where(~through).withColumn("is_train", F.col("split_before") + F.col("split_n") <= F.col("split_cut"))
    extra = ["split_hash", "split_bucket", "split_n", "split_before", "split_cut"]
    return whole.unionByName(inside).drop(*extra)


def split_report(split: DataFrame, ratio: float, key: str) -> DataFrame:
    """n, n_train, n_test, overlap, ratio_ok (within 1 %)."""
    per = split.groupBy(key).agg(F.max(F.col("is_train").cast("int")).alias("a"), F.max((~F.col("is_train")).cast("int")).alias("b"))
    found = per.agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("n_train"), F.sum("b").alias("n_test"), F.sum(F.col("a") * F.col("b")).alias("overlap"))
    return found.withColumn("ratio_ok", F.abs(F.col("n_train") / F.col("n") - ratio) < 0.01)


def first_per_bucket(rows: DataFrame, n: int, bucket: str, *order) -> DataFrame:
    w = Window.partitionBy(bucket).orderBy(*order)
    return rows.withColumn("bucket_rank", F.row_number().over(w)).where(F.col("bucket_rank") <= n).drop("bucket_rank")


def one_per_bucket(rows: DataFrame, seed: int, bucket: str, key: str) -> DataFrame:
    return first_per_bucket(rows, 1, bucket, digest(seed, F.col(key)), key)
