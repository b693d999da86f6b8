"""The corpus pipeline: five stages from documents to token shards, each written and read again by the next.

Each stage works on all rows that its predecessor kept. The last one's rows describe the documents of the
shards in the order of the file; a document that the mix takes twice is in it twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framesift.llm import mixing, stages, tokenbin
from framesift.llm.common import remove, table, work_path

#: Words that a task of the last stage remembers: executors that have run the other stages have less memory left for Python.
CACHE_WORDS = 1 << 16


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification; documents whose language can't be told go."""
    return stages.keep_identified(docs, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup; one document of each group stays."""
    return stages.keep_one_of_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return stages.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.emit_copies(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, read back: doc_id, start, n_tokens, ids_crc32."""
    out = work_path(spark, "shards")
    tokenbin.write_shards(docs, out, cache_words=CACHE_WORDS)
    return tokenbin.describe_shards(spark, out).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]

#: Language models, hashed fingerprints and tokenizing have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; between stages the rows are Parquet in the shared folder.

    A stage's rows are deleted when the next stage's are written; the shards stay, which the result reads (common.remove_work).
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        found = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return found
        path = work_path(spark, f"stage-{name}")
        found.write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
