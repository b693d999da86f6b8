"""What the corpus operators share: column intake, reliable checkpoints, the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the corpus contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def intake(df: DataFrame, **columns: tuple[str, str]) -> DataFrame:
    """Only the named columns, under our own names and types: name=(column of df, type).

    Extra columns never reach an operator, so their names can't clash with its own.
    """
    return df.select(*[df[source].cast(kind).alias(name) for name, (source, kind) in columns.items()])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of words; empty for null and for texts without a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def trimmed_words(text: Column) -> Column:
    """As words_of, but without a lambda, so that it stays in generated code: [''] for no word."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    return F.split(bare, SPACES)


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


#: Rows of a batch that goes to Python. Texts are large rows: at 10,000 a batch they would fill a worker.
TEXT_ROWS = 1000


def text_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on sends batches of TEXT_ROWS rows at most to Python (it may already send fewer)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= TEXT_ROWS:
        df.sparkSession.conf.set(key, str(TEXT_ROWS))
    return df


def release_memory() -> None:
    """Gives a Python worker's free memory back to the system: workers outlive tasks, and the executor's JVM needs it too."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim is not None:
        trim(0)


def tidy(spark: SparkSession) -> None:
    """Gives back what nothing refers to any more: memory of the driver, and with its garbage the shuffle files that Spark keeps until it is collected."""
    release_memory()
    spark._jvm.System.gc()


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function of batches, after which its worker's memory is given back."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        release_memory()

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A local session without one gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="framesift-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def work_path(spark: SparkSession, what: str) -> str:
    """A new folder's path in the shared folder, under this application's own."""
    return f"{work_dir(spark)}/{what}-{uuid.uuid4().hex}"


def work_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/framesift-{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def remove_work(spark: SparkSession) -> None:
    """Deletes all that operators have stored in the shared folder for this application; results that still read it can't be computed again."""
    remove(spark, work_dir(spark))


def materialized(df: DataFrame) -> DataFrame:
    """Computed once and kept in the shared folder: lost executors lose nothing of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
