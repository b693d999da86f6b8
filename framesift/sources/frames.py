"""Candidate frames from metadata files, or from the names of the frames where the metadata doesn't hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = r"frame_(\d+)\.jpg$"
META = "sample_id string, video_path string, source_fps double, target_fps double, frame_ids array<bigint>, files array<string>"


def read_metadata(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.schema(META).json(pattern, multiLine=True)


def frames_of(metadata: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """sample_id, pos, frame_id, file. listing (sample_id, file) serves samples whose arrays are empty or differ in length."""
    good = (F.size("frame_ids") > 0) & (F.size("frame_ids") == F.size("files"))
    rows = metadata.where(good).select("sample_id", F.posexplode(F.arrays_zip("frame_ids", "files")).alias("pos", "f"))
    found = rows.select("sample_id", F.col("pos").cast("bigint").alias("pos"), F.col("f.frame_ids").alias("frame_id"), F.col("f.files").alias("file"))
    if listing is None:
        return found
    from pyspark.sql import Window

    rest = listing.join(metadata.where(good).select("sample_id"), "sample_id", "left_anti").withColumn("frame_id", F.regexp_extract("file", NAME, 1))
    rest = rest.where(F.col("frame_id") != "").withColumn("frame_id", F.col("frame_id").cast("bigint"))
    w = Window.partitionBy("sample_id").orderBy("frame_id")
    return found.unionByName(rest.select("sample_id", (F.row_number().over(w) - 1).cast("bigint").alias("pos"), "frame_id", "file"))


def video_index(files: DataFrame, path: str = "path", root: str | None = None) -> DataFrame:
    """stem, path of video files; among equal stems the smallest root wins (or the smallest path)."""
    from framesift.functions.texts import stem

    videos = files.where(F.lower(path).rlike(r"\.(mp4|webm|mkv|avi)$")).withColumn("stem", stem(F.col(path)))
    order = F.struct(*( [F.col(root)] if root else []), F.col(path))
    return videos.groupBy("stem").agg(F.min_by(path, order).alias("path"))
