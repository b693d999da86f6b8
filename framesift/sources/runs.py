"""Run folders and what is read back from them: manifests, selections over many runs, reports, captions."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed names of a run's files.
INDEX_NAME = "selected_frames_index.jsonl"
MANIFEST_NAME = "selected_frames_index.meta.json"

#: Fixed names of samplers that can work on prepared frames.
ON_PREPARED_FRAMES = [
    "clip", "clip-new", "blip", "blip-new", "aks", "aks-blip", "aks-clip", "uniform", "random",
    "siglip2", "siglip2-new", "qframe", "bolt-clip", "bolt-siglip2",
]

_SETTINGS = "struct<keyword_weight_strength:double,ensure_keyword_min_coverage:boolean>"
_INDEX = f"sample_id string, frame_selection_mode int, selection_config {_SETTINGS}, selected_frame_ids array<bigint>"
_MANIFEST = "keyword_weight_strength double, ensure_keyword_min_coverage boolean"


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def check_sampler(method: str, *, prepared: bool) -> None:
    """Raises ValueError where prepared frames are asked of a sampler that can't use them."""
    if prepared and method not in ON_PREPARED_FRAMES:
        raise ValueError(f"{method!r} can't work on prepared frames; these can: {', '.join(ON_PREPARED_FRAMES)}")


def new_run_dir(spark: SparkSession, root: str, at: datetime) -> str:
    """Makes a folder named by the time to the second; one that is there gets the next free number after it."""
    base = f"{root.rstrip('/')}/{at:%Y%m%d_%H%M%S}"
    path, number = base, 0
    while (found := _path(spark, path))[0].exists(found[1]):
        number += 1
        path = f"{base}_{number}"
    found[0].mkdirs(found[1])
    return path


def write_manifest(rows: DataFrame, run_dir: str) -> None:
    """A run's settings, one row, as JSON; the manifest before it is replaced."""
    rows.coalesce(1).write.mode("overwrite").json(f"{run_dir.rstrip('/')}/{MANIFEST_NAME}")


def read_selections(spark: SparkSession, root: str, runs: str = "*") -> DataFrame:
    """strength, coverage, sample_id, frames (distinct, ascending) over all runs whose folder's name matches runs.

    Records of other modes than 0 are left out. A record without one of the settings takes its run's manifest's, if there is one;
    a record that lacks one even so is left out. Of records with one configuration and sample the last counts: in the last
    run by name, there in the last place of the file. Files and folders of both names are read.
    """

    def found(name: str) -> str | None:
        pattern = f"{root.rstrip('/')}/{runs}/{name}"
        files, target = _path(spark, pattern)
        return pattern if files.globStatus(target) else None

    def run_of(name: str):
        return F.regexp_extract("_metadata.file_path", rf"([^/]+)/{name.replace('.', '[.]')}(?:/[^/]*)?$", 1)

    index = found(INDEX_NAME)
    if index is None:
        raise FileNotFoundError(f"no {INDEX_NAME} in {root}/{runs}")
    place = F.struct("run", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    records = spark.read.schema(_INDEX).json(index).withColumn("run", run_of(INDEX_NAME)).withColumn("place", place).where("frame_selection_mode = 0")
    manifest = found(MANIFEST_NAME)
    if manifest is None:
        settings = spark.createDataFrame([], f"run string, {_MANIFEST}")
    else:
        settings = spark.read.schema(_MANIFEST).json(manifest, multiLine=True).withColumn("run", run_of(MANIFEST_NAME)).groupBy("run").agg(F.max("keyword_weight_strength").alias("keyword_weight_strength"), F.max("ensure_keyword_min_coverage").alias("ensure_keyword_min_coverage"))
    known = records.join(settings, "run", "left").select(
        F.coalesce("selection_config.keyword_weight_strength", "keyword_weight_strength").alias("strength"),
        F.coalesce("selection_config.ensure_keyword_min_coverage", "ensure_keyword_min_coverage").alias("coverage"),
        "sample_id", "place", F.coalesce("selected_frame_ids", F.array().cast("array<bigint>")).alias("ids"),
    )
    known = known.where("strength IS NOT NULL AND coverage IS NOT NULL AND sample_id IS NOT NULL")
    return known.groupBy("strength", "coverage", "sample_id").agg(F.array_sort(F.array_distinct(F.max_by("ids", "place"))).alias("frames"))


def read_report(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV report with a header; an error names the columns that it lacks, or says that it has no row."""
    rows = spark.read.csv(path, header=True, inferSchema=True)
    if lacking := sorted(set(required) - set(rows.columns)):
        raise ValueError(f"{path} lacks columns: {', '.join(lacking)}")
    if rows.isEmpty():
        raise ValueError(f"{path} has no row")
    return rows


def write_report(rows: DataFrame, path: str, order: list[str]) -> None:
    """A CSV report in the order of the columns; its files' names ascend in that order."""
    rows.orderBy(*order).write.mode("overwrite").csv(path, header=True)


def fixed_width(rows: DataFrame, formats: dict[str, str], between: str = " | ") -> DataFrame:
    """One column `line`: the named columns under their printf formats, null as an empty cell of the format's width."""
    cells = []
    for name, form in formats.items():
        width = re.match(r"%(-?\d+)", form)
        empty = F.lit(" " * abs(int(width[1])) if width else "")
        cells.append(F.coalesce(F.when(F.col(name).isNotNull(), F.format_string(form, F.col(name))), empty))
    return rows.select(F.concat_ws(between, *cells).alias("line"))


def write_summary(rows: DataFrame, path: str, formats: dict[str, str], *, order: list[str], head: list[str]) -> None:
    """A text summary: the head's lines, then a line for each row in order. Meant for reports of a bounded number of rows: it is one file."""
    spark = rows.sparkSession
    lines = fixed_width(rows.repartition(1).sortWithinPartitions(*order), formats)
    first = spark.createDataFrame([(line,) for line in head], "line string").coalesce(1)
    first.unionByName(lines).coalesce(1).write.mode("overwrite").text(path)


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """video, captions: from a file of one JSON object of lists; entries that are no list are left out (a string that reads as one is taken for one)."""
    whole = spark.read.text(path, wholetext=True)
    entries = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("video", "held"))
    lists = entries.where(F.startswith(F.ltrim("held"), F.lit("["))).select("video", F.from_json("held", "array<string>").alias("captions"))
    return lists.where("captions IS NOT NULL")


def write_embeddings(rows: DataFrame, path: str, summary: dict[str, str], *, order: list[str]) -> DataFrame:
    """Writes a folder per embedding and an index; gives the index.

    rows: video_path, sample_id, preprocess_key, fps, total_frames, frame_indices (array), embedding (array of a frame's vector each). Each row's
    folder `embeddings/embedding_file=<name>` is named after its video, with a number where an earlier row (by order) has that name.
    The index has the row's keys, file, count and shape; index.json has them all under the summary, as one record.
    """
    from framesift.functions import texts
    from framesift.operators.naming import unique_names

    base = F.coalesce(F.nullif(F.regexp_replace(texts.stem(F.col("video_path")), "[^0-9A-Za-z._-]", "_"), F.lit("")), F.lit("video"))
    named = unique_names(rows.withColumn("_base", base), "_base", order, out="embedding_file").drop("_base")
    shape = F.array(F.size("embedding"), F.coalesce(F.size(F.get("embedding", F.lit(0))), F.lit(0)))
    named = named.withColumn("num_sampled_frames", F.size("frame_indices")).withColumn("embedding_shape", shape)
    named.write.partitionBy("embedding_file").parquet(f"{path}/embeddings")
    index = named.select("video_path", "sample_id", "preprocess_key", "embedding_file", "num_sampled_frames", "fps", "total_frames", "embedding_shape")
    index.write.json(f"{path}/index")
    counts = index.agg(F.count(F.lit(1)).alias("num_videos_success"))
    counts.select(*[F.lit(v).alias(k) for k, v in summary.items()], "num_videos_success").coalesce(1).write.json(f"{path}/index.json")
    return rows.sparkSession.read.schema(index.schema).json(f"{path}/index")
