"""Session defaults. Every value can be overridden by the submitter; none is set on a session that already has it."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter's own session is used."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    settings = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(n),
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{n}]").appName("framesift")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stored(df: DataFrame) -> DataFrame:
    """Computed once and kept in the folder that all executors share (spark.checkpoint.dir); a local session without one gets its own."""
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="framesift-"))
    return df.checkpoint(eager=True)
