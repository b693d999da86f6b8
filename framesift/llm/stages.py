"""The operators as filters of whole tables: documents in, documents out, with the columns they came with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm import decontam, langid, shingles
from framesift.llm.common import materialized, tidy

#: Ids that may be broadcast to drop rows (8 bytes each).
BROADCAST_IDS = 1_000_000


def without_ids(docs: DataFrame, ids: DataFrame, *, id_col: str = "doc_id", broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """docs without the rows whose id is in ids (one column, stored). Null ids stay.

    The ids are broadcast after their count is checked, so that no text is exchanged; more of them are joined.
    """
    ids = ids.select(ids.columns[0]).withColumnRenamed(ids.columns[0], "dropped_id")
    if ids.count() <= broadcast_ids:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[id_col].cast("long") == ids["dropped_id"], "left_anti")


def keep_identified(docs: DataFrame, labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Documents whose language can be told. The model learns from labelled.

    Null texts and texts without a letter go, and texts in which the model finds nothing that sets one language apart (in none of its
    scripts, say): their languages are all as likely. Where nothing can be learnt, or just one language, only the former go. Repeated rows and rows without
    an id are judged one by one.
    """
    model = langid.train(labelled.where(~langid.held_out(labelled[id_col])), text_col=text_col, lang_col=lang_col, id_col=id_col)
    if len(model.languages) < 2:
        return docs.where(docs[text_col].cast("string").rlike(r"\p{L}"))
    mark = "language_" + "_".join(docs.columns)
    found = langid.identify(docs, model, text_col=text_col, out=mark)
    told = (F.col(f"`{mark}`.lang_pred") != langid.UNDETERMINED) & (F.col(f"`{mark}`.score") > 1 / len(model.languages) + 1e-9)
    del model  # tasks have it by broadcast
    tidy(docs.sparkSession)
    return found.where(told).select(*[docs[c] for c in docs.columns])


def keep_one_of_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = BROADCAST_IDS, **params) -> DataFrame:
    """One document of each component of near-duplicates: the one with the smallest id. Near are texts within op6's bits
    of its fingerprint, and texts that have 0.8 or more of their five-word shingles in common.

    Rows are told apart by id and text: different texts under one id are documents of their own, of which the one with the least
    hash stays if they are near copies; rows that repeat both are one document, of which one row stays. Rows without an id have
    no rank among copies and stay.
    """
    found = materialized(shingles.near_copies(docs, id_col=id_col, text_col=text_col, **params))
    tidy(docs.sparkSession)
    firsts = found.where(F.col("id") == F.col("component"))
    repeated = materialized(firsts.groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("kept")).where("rows > 1"))
    dropped = found.where(F.col("id") != F.col("component")).select("id", "key")
    any_repeated = repeated.limit(1).count() > 0
    if any_repeated:
        dropped = dropped.unionByName(firsts.join(repeated, "root").where(F.col("key") != F.col("kept")).select("id", "key"))
    dropped = materialized(dropped.distinct().select(F.col("id").alias("dropped_id"), F.col("key").alias("dropped_key")))
    if dropped.count() <= broadcast_ids:
        dropped = F.broadcast(dropped)
    key = F.xxhash64(docs[text_col].cast("string"))
    kept = docs.join(dropped, (docs[id_col].cast("long") == dropped["dropped_id"]) & (key == dropped["dropped_key"]), "left_anti")
    if not any_repeated:
        return kept
    mark = "text_key_" + "_".join(docs.columns)
    unnamed = kept.where(kept[id_col].isNull())
    return kept.where(kept[id_col].isNotNull()).withColumn(mark, key).dropDuplicates([id_col, mark]).drop(mark).unionByName(unnamed)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **params) -> DataFrame:
    """Documents that overlap no benchmark item. The text decides: rows that share an id, or have none, are judged one by one."""
    key = F.xxhash64(docs[text_col].cast("string"))
    texts = docs.select(key.alias("key"), docs[text_col].alias("text"))
    found = materialized(decontam.find_overlaps(texts, benchmark, id_col="key", **params).select("doc").distinct())
    mark = "text_key_" + "_".join(docs.columns)
    return without_ids(docs.withColumn(mark, key), found, id_col=mark).drop(mark)
