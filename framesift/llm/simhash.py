"""SimHash near-duplicates, found by an inverted index over byte positions with count filtering.

A fingerprint has 64 bits, 8 bytes. Two that differ in at most r bits differ in at most r bytes, so
they share at least 8 - r positional bytes: the guaranteed minimum. Postings of single bytes would pair a
256th of the table with itself, so a posting is under several bytes at once. For r = 3 the byte positions are the points of the
cube {0,1}^3, and a posting's four are a block of the Steiner system S(3,4,8): four positions whose numbers' exclusive or is 0.
Any three positions that differ lie in a block, whose complement is a block too, so two fingerprints that share the minimum
of five meet under one of 14 keys. For other r the postings are under every combination of 8 - r positions.

Under a key the bytes that a pair shares are tallied, pairs below the minimum fall out, and of the others
the differing bits are counted.

Exact copies are one fingerprint before anything is posted. A group under one key holds distinct values
of its free bytes only, so its size is bounded, and a group never emits its pairs: it is linked
inside by a spanning star of each of its parts. Groups up to PAIRWISE compare all members at once in memory; in
larger ones each member looks up its neighbours (all masks of up to r free bits), so that work grows with the members,
not their square. Every link between different fingerprints lies inside some group, so none is lost.

Defined results: a null or word-less text has fingerprint zero and is linked like any other; fewer words than a
shingle are one shingle; shingles count with repeats; rows that repeat an id are rows of their own; a null
id is never the name of a component unless it has no other. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import materialized, releasing, text_batches
from framesift.llm.components import connected_components

SEED = 42
MAX_BITS = 3
SHINGLE = 3
PAIRWISE = 1024
#: Hashes whose bits are counted at once; longer texts are counted piece by piece.
PIECE = 1 << 15


def shingle_hashes(text: str | None, k: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every k-word shingle of the text, A-Z lower-cased; words are split at ASCII white space."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < k:
        return np.array([digest(b" ".join(words), seed)], dtype=np.uint64)
    shifted = [words[i:] for i in range(k)]
    return np.fromiter((digest(b" ".join(s), seed) for s in zip(*shifted, strict=False)), dtype=np.uint64, count=len(words) - k + 1)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), PIECE):
        piece = hashes[at : at + PIECE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp (64 bits as a signed long), a row for each row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.fromiter((simhash(shingle_hashes(t, shingle)) for t in batch["text"]), dtype=np.uint64, count=len(batch))
            yield pd.DataFrame({"id": batch["id"], "fp": found.view(np.int64)})

    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].cast("string").alias("text"))
    return text_batches(rows).mapInPandas(releasing(run), "id string, fp long").select(F.col("id").cast("long").alias("id"), "fp")


def blocks(max_bits: int) -> list[tuple[int, ...]]:
    """Byte positions of the keys: any two fingerprints that share 8 - max_bits bytes or more share all bytes of one."""
    if max_bits == 3:
        return [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
    return list(combinations(range(8), 8 - max_bits))


def postings(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """which (the block of byte positions), shared (their bytes), fp."""
    kept = []
    for which, places in enumerate(blocks(max_bits)):
        mask = sum(0xFF << 8 * p for p in places)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        kept.append(F.struct(F.lit(which).cast("byte").alias("which"), F.col("fp").bitwiseAND(F.lit(mask)).alias("shared")))
    return fps.select("fp", F.explode(F.array(*kept)).alias("key")).select("key.which", "key.shared", "fp")


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the eight positional bytes each pair shares."""
    differing = a ^ b
    return sum(((differing >> np.uint64(8 * p)) & np.uint64(0xFF) == 0).astype(np.int8) for p in range(8))


def _parts(fps: np.ndarray, max_bits: int) -> np.ndarray:
    """Index of the first member of each member's part, where parts link at max_bits differing bits or fewer."""
    m = len(fps)
    label = np.arange(m)
    if m <= PAIRWISE:
        one, two = np.triu_indices(m, 1)
        enough = tally(fps[one], fps[two]) >= 8 - max_bits
        one, two = one[enough], two[enough]
        near = np.bitwise_count(fps[one] ^ fps[two]) <= max_bits
        one, two = one[near], two[near]
        while len(one):
            before = label.copy()
            np.minimum.at(label, two, label[one])
            np.minimum.at(label, one, label[two])
            if (label == before).all():
                break
        return label
    varying = int(np.bitwise_or.reduce(fps ^ fps[0]))
    places = [np.uint64(1) << np.uint64(b) for b in range(64) if varying >> b & 1]
    order = np.argsort(fps)
    ranked = fps[order]
    masks = [np.bitwise_or.reduce(np.array(c, dtype=np.uint64)) for n in range(1, max_bits + 1) for c in combinations(places, n)]
    while True:
        before = label.copy()
        for mask in masks:
            wanted = fps ^ mask
            at = np.minimum(np.searchsorted(ranked, wanted), m - 1)
            there = ranked[at] == wanted
            other = order[at[there]]
            label[there] = np.minimum(label[there], label[other])
        while not (label[label] == label).all():
            label = label[label]
        if (before == label).all():
            return label


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a, b: pairs of fingerprints that span every part of the link graph. fps: one column fp."""

    def star(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = [], []
            for members in batch["fps"]:
                own = np.sort(np.asarray(members, dtype=np.int64)).view(np.uint64)
                label = _parts(own, max_bits)
                linked = np.flatnonzero(label != np.arange(len(own)))
                a.append(own[label[linked]])
                b.append(own[linked])
            yield pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)}) if a else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    # The small rows would be one task's to multiply: the number of partitions is given, so that they aren't merged.
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp").distinct()
    groups = postings(fps, max_bits).groupBy("which", "shared").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return groups.select("fps").mapInPandas(releasing(star), "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """A row for each row of docs: id, fp, component (the smallest id reachable over links)."""
    return components_of(materialized(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle)), max_bits)


def components_of(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """id, fp -> id, fp, component. rows is read three times; it should be stored."""
    return parts_of(rows, links(rows.select("fp"), max_bits)).drop("root")


def parts_of(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (id, fp and others) with root (names the part that found links) and component (its smallest id; parts may share one)."""
    distinct = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(found)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "root", "component")
    return rows.join(named, "fp").select(*rows.columns, "root", "component")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def query(spark, sf_dir):
    from framesift.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), hex16(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
