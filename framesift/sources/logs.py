"""Result logs that many writers append to: a header record that the first one sets, and appends that are whole or absent.

A log is a folder. `_header.json` names its columns; it is set once, by compare-and-swap. An append first writes its CSV files to a staging folder
beside the log's data, through Spark's own commit; then it holds its columns against the header (or sets it); then one rename makes all of its files
part of the log, as `batch=<id>`. So a reader sees all rows of an append or none, headers never mix, and an append that fails anywhere
before the rename leaves nothing but a staging folder, which it deletes. Appends don't wait for one another.

Any store that Spark writes serves, if its rename of a folder is atomic (local disks, HDFS).
"""

from __future__ import annotations

import json
import os
import time
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER, STAGING = "_header.json", "_staging"
#: Seconds to wait for a header that another writer has begun.
PATIENCE = 10.0
#: Fixed columns of the log of evaluations over a split (a third layout beside the run log's two).
SPLIT_RUN_COLUMNS = [
    "timestamp", "dataset", "seed", "task_filter", "num_samples", "evaluated_samples", "correct_count", "accuracy_percent", "num_frames",
    "avg_inference_time", "frame_sampling_method", "avg_frame_sampling_time", "avg_embedding_build_time", "avg_selected_frame_count",
    "avg_total_time_hours", "over_max_tokens_count", "model_name", "lora_path", "train_ratio", "eval_split",
]
#: Decimals that its numbers are written with (fixed); whole numbers have none.
SPLIT_RUN_DECIMALS = {"correct_count": 6, "accuracy_percent": 2, "avg_inference_time": 3, "avg_frame_sampling_time": 6, "avg_embedding_build_time": 6, "avg_selected_frame_count": 6, "avg_total_time_hours": 6}


class _Store:
    """The file system of a path, as the driver sees it."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def local(self, name: str) -> str | None:
        where = urlparse(self.fs.makeQualified(self.path(name)).toString())
        return unquote(where.path) if where.scheme == "file" else None

    def set_once(self, name: str, text: str) -> bool:
        """Makes a file, unless there is one by now."""
        self.fs.mkdirs(self.path(""))
        if local := self.local(name):
            # A link to a whole file either appears or fails: nobody ever sees a part of it.
            made = f"{local}.{uuid.uuid4().hex}"
            with open(made, "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(made, local)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(made)
        try:
            out = self.fs.create(self.path(name), False)
        except Exception:
            if self.fs.exists(self.path(name)):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.path(name)):
            return None
        source = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()


def header_of(spark: SparkSession, path: str) -> list[str] | None:
    """The log's columns; null before the first append. Waits for one that is just being written."""
    store, until = _Store(spark, path), time.monotonic() + PATIENCE
    while (text := store.read(HEADER)) is not None:
        try:
            return json.loads(text)["columns"]
        except ValueError:
            if time.monotonic() > until:
                raise
            time.sleep(0.1)
    return None


def append_log(rows: DataFrame, path: str) -> bool:
    """Appends all rows, or none: False where the log has other columns, or in another order."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    store, columns = _Store(spark, path), list(rows.columns)
    if (known := header_of(spark, path)) is not None and known != columns:
        return False
    staged = f"{STAGING}/{name}"
    try:
        rows.write.option("header", True).option("escape", '"').csv(f"{store.root}/{staged}")
        if not store.set_once(HEADER, json.dumps({"columns": columns})) and header_of(spark, path) != columns:
            return False
        if not store.fs.rename(store.path(staged), store.path(f"batch={name}")):
            raise OSError(f"{path}: the append could not be made part of the log")
        return True
    finally:
        store.fs.delete(store.path(staged), True)


def read_log(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """All appended rows, as texts; ValueError where a required column isn't in the header."""
    columns = header_of(spark, path)
    if columns is None:
        raise FileNotFoundError(f"{path} is no log")
    if lacking := [c for c in required or [] if c not in columns]:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    schema = ", ".join(f"`{c}` string" for c in columns)
    root = path.rstrip("/")
    if not spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/batch=*")):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(f"{root}/batch=*", header=True, multiLine=True, escape='"')


def split_run_log(rows: DataFrame, *, train: str = "use_train_split") -> DataFrame:
    """The columns of the log of evaluations over a split, in order and in its number formats; those that rows lack are null."""
    if train in rows.columns:
        rows = rows.withColumn("eval_split", F.when(F.col(train).cast("boolean"), "train").otherwise("test"))

    def cell(name: str):
        if name not in rows.columns:
            return F.lit(None).cast("string").alias(name)
        if name in SPLIT_RUN_DECIMALS:
            return F.format_string(f"%.{SPLIT_RUN_DECIMALS[name]}f", F.col(name).cast("double")).alias(name)
        return F.col(name).cast("string").alias(name)

    return rows.select(*map(cell, SPLIT_RUN_COLUMNS))
