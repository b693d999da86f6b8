"""Subtitles as segments: path, seq, start_s, end_s, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions import texts


def parse_srt(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Blocks between blank lines; the time line is the first or second; tags go; malformed blocks are skipped."""
    blocks = files.select(F.col(path).alias("path"), F.posexplode(F.split(F.regexp_replace(content, r"\r\n?", "\n"), r"\n[ \t]*\n+")).alias("seq", "block"))
    lines = F.filter(F.split(F.trim(F.regexp_replace("block", r"^\n+|\n+$", "")), "\n"), lambda x: F.trim(x) != "")
    timed = blocks.withColumn("lines", lines)
    at = F.when(F.contains(F.get("lines", F.lit(0)), F.lit("-->")), 1).when(F.contains(F.get("lines", F.lit(1)), F.lit("-->")), 2)
    timed = timed.withColumn("at", at).where(F.col("at").isNotNull())
    stamp = F.get("lines", F.col("at") - 1)
    body = F.slice("lines", F.col("at") + 1, F.greatest(F.size("lines") - F.col("at"), F.lit(0)))
    rows = timed.select(
        "path",
        F.col("seq").cast("bigint").alias("seq"),
        texts.seconds_of(F.trim(F.substring_index(stamp, "-->", 1))).alias("start_s"),
        texts.seconds_of(F.regexp_extract(F.substring_index(stamp, "-->", -1), r"^\s*(\S+)", 1)).alias("end_s"),
        texts.strip_tags(F.array_join(F.transform(body, lambda x: F.trim(x)), " ")).alias("text"),
    )
    return rows.where(F.col("start_s").isNotNull() & F.col("end_s").isNotNull() & (F.col("text") != ""))


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return parse_srt(files)


ENTRY = "array<struct<text:string,line:string,timestamp:array<string>,start:string,end:string>>"


def parse_json(files: DataFrame, offset: str | None = None, path: str = "path", content: str = "content") -> DataFrame:
    """text or line, timestamp [start, end] or start and end; an offset is taken off, times are cut at 0 and ends at starts; by start."""
    shift = F.coalesce(F.col(offset).cast("double"), F.lit(0.0)) if offset else F.lit(0.0)
    rows = files.select(F.col(path).alias("path"), shift.alias("shift"), F.posexplode(F.from_json(content, ENTRY)).alias("place", "e"))
    start = F.greatest(texts.number_or_stamp(F.coalesce(F.get("e.timestamp", F.lit(0)), F.col("e.start"))) - F.col("shift"), F.lit(0.0))
    end = F.greatest(texts.number_or_stamp(F.coalesce(F.get("e.timestamp", F.lit(1)), F.col("e.end"))) - F.col("shift"), start)
    from pyspark.sql import Window

    body = F.trim(F.coalesce("e.text", "e.line"))
    made = rows.select("path", "place", start.alias("start_s"), end.alias("end_s"), body.alias("text")).where(F.col("start_s").isNotNull() & F.col("end_s").isNotNull() & (F.col("text") != ""))
    w = Window.partitionBy("path").orderBy("start_s", "place")
    return made.select("path", (F.row_number().over(w) - 1).cast("bigint").alias("seq"), "start_s", "end_s", "text")
