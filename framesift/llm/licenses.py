"""License scans by diagonal voting.

Templates are word sequences: short phrases and opening passages of well-known licenses. Every rolling word
2-gram and 5-gram of a text is hashed and joined to the template positions with the same hash. A hit votes for
a diagonal: its place in the text less its place in the template. Votes are counted per diagonal, neighbouring diagonals of
one template (words inserted or left out) are merged, and a span is verified: each hit's words must equal the
template's, a phrase needs all its grams on one diagonal, a passage needs COVERAGE of its grams within
a span of at most STRETCH times its length.

All of it is DataFrame expressions: grams are made and probed inside generated code, and only hits, with one
row for each document, are exchanged. The template table is a constant, whose size is checked before it is broadcast.

Defined results: a null text is empty; without a match counts are 0, places null, labels empty and the score
0; repeated rows and null ids are documents of their own. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framesift.llm.common import lower_ascii

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed phrases and labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Opening passages of licenses, in the words of the licenses.
PASSAGES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "the person who associated a work with this deed has dedicated the work to the public domain": "cc0",
}
PHRASE_GRAM, PASSAGE_GRAM = 2, 5
COVERAGE = 0.6
STRETCH = 1.5
#: Diagonals at most so far apart are merged.
NEAR = 3
#: Template grams that may be broadcast (about 100 bytes each).
BROADCAST_GRAMS = 200_000


def _grams(words, at, size: int):
    return [F.get(words, at + j) for j in range(size)]


def template_grams(spark: SparkSession, phrases: Mapping[str, str], passages: Mapping[str, str]) -> DataFrame:
    """hash, gram, template, place, n_grams, label, is_base."""
    rows = []
    for kind, (size, found) in enumerate(((PHRASE_GRAM, phrases), (PASSAGE_GRAM, passages))):
        for text, label in found.items():
            words = text.split()
            if len(words) < size:
                raise ValueError(f"a template needs {size} words: {text!r}")
            rows += [(size, words[i : i + size], f"{kind}:{text}", i, len(words) - size + 1, label, kind == 0) for i in range(len(words) - size + 1)]
    if len(rows) > BROADCAST_GRAMS:
        raise ValueError(f"{len(rows)} template grams are too many to broadcast")
    made = spark.createDataFrame(rows, "size int, words array<string>, template string, place int, n_grams int, label string, is_base boolean")
    key = F.when(F.col("size") == PHRASE_GRAM, F.xxhash64(F.lit(PHRASE_GRAM), *_grams(F.col("words"), F.lit(0), PHRASE_GRAM)))
    key = key.otherwise(F.xxhash64(F.lit(PASSAGE_GRAM), *_grams(F.col("words"), F.lit(0), PASSAGE_GRAM)))
    return made.select(key.alias("hash"), F.array_join("words", " ").alias("gram"), "size", "template", "place", "n_grams", "label", "is_base")


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: Mapping[str, str] = PHRASES, passages: Mapping[str, str] = PASSAGES) -> DataFrame:
    """Verified spans: row, id, n_words, label, is_base, start, end, coverage; with them a row with a null label for each row of docs."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        docs[id_col].cast("long").alias("id"),
        F.split(lower_ascii(F.coalesce(docs[text_col].cast("string"), F.lit(""))), NOT_WORD).alias("words"),
    )
    lead = (F.get("words", F.lit(0)) == "").cast("int")
    trail = ((F.size("words") > 1) & (F.element_at("words", -1) == "")).cast("int")
    rows = rows.select("*", lead.alias("lead"), (F.size("words") - lead - trail).cast("long").alias("n_words"))
    # Place -1 stands for the document itself.
    spread = rows.select("row", "id", "n_words", "lead", "words", F.explode(F.sequence(F.lit(-1), F.size("words") - PHRASE_GRAM)).alias("at"))
    both = F.array(*[F.xxhash64(F.lit(size), *_grams(F.col("words"), F.col("at"), size)) for size in (PHRASE_GRAM, PASSAGE_GRAM)])
    own = F.xxhash64(F.lit("document"))
    hashes = F.when(F.col("at") < 0, F.array(own)).otherwise(both)
    probes = spread.select("row", "id", "n_words", "lead", "words", "at", F.explode(hashes).alias("hash"))
    spark = docs.sparkSession
    grams = template_grams(spark, phrases, passages)
    itself = spark.range(1).select(own.alias("hash"), *[F.lit(None).cast(grams.schema[c].dataType).alias(c) for c in grams.columns[1:]])
    hits = probes.join(F.broadcast(grams.unionByName(itself)), "hash")
    same = F.col("template").isNull() | (F.array_join(F.slice("words", F.col("at") + 1, F.col("size")), " ") == F.col("gram"))
    hits = hits.where(same).select("row", "id", "n_words", "template", "n_grams", "label", "is_base", "place", (F.col("at") - F.col("lead")).alias("at"))
    votes = hits.groupBy("row", "id", "n_words", "template", "n_grams", "label", "is_base", (F.col("at") - F.col("place")).alias("diagonal"))
    voted = votes.agg(F.min("at").alias("start"), F.max("at").alias("last"), F.collect_set("place").alias("places"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.when(F.col("is_base") | (F.col("diagonal") - F.lag("diagonal").over(along) > NEAR), 1).otherwise(0)
    islands = voted.withColumn("apart", apart).withColumn("island", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("row", "id", "n_words", "template", "n_grams", "label", "is_base", "island").agg(
        F.min("start").alias("start"), F.max("last").alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n_places")
    )
    size = F.when(F.col("is_base"), PHRASE_GRAM).otherwise(PASSAGE_GRAM)
    merged = merged.select("*", (F.col("last") + size).alias("end"), (F.col("n_places") / F.col("n_grams")).alias("coverage"))
    fits = (F.col("end") - F.col("start")) <= STRETCH * (F.col("n_grams") + size - 1)
    proven = F.when(F.col("is_base"), F.col("coverage") == 1.0).otherwise((F.col("coverage") >= COVERAGE) & fits)
    return merged.where(F.col("label").isNull() | proven).select("row", "id", "n_words", "label", "is_base", "start", "end", "coverage")


def label_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: Mapping[str, str] = PHRASES, passages: Mapping[str, str] = PASSAGES) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best span's coverage)."""
    spans = scan_licenses(docs, id_col=id_col, text_col=text_col, phrases=phrases, passages=passages)
    base = F.when(F.col("is_base"), F.col("start")).cast("long")

    def joined(label):
        return F.array_join(F.array_sort(F.collect_set(label)), ",")

    return spans.groupBy("row", "id", "n_words").agg(
        F.count(base).alias("n_base"),
        F.min(base).alias("first_word"),
        F.max(base).alias("last_word"),
        joined(F.when(F.col("is_base"), F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("label").isNotNull(), F.col("coverage"))), F.lit(0.0)).alias("score"),
    ).drop("row")


def query(spark, sf_dir):
    from framesift.llm.common import table

    return label_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
