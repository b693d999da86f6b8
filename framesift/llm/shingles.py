"""Pairs of texts with SIMILARITY or more of their word shingles in common, by prefix filtering; exact.

A text is the set of its shingle hashes, rarest first: the order is that of counts in a sample of the texts, and any order that
all texts share gives the same pairs. Two sets of Jaccard similarity 4/5 meet in the first n - ceil(4n/5) + 1 of their places, so only
these are posted. Under a shingle with up to PAIRWISE texts all pairs of fitting sizes are candidates, and those that share too few
posted shingles fall out. Under one with more, each text is first held against a few hubs. Where that leaves a group in several
parts, its texts are dealt to blocks of about BLOCK shingles; each two blocks meet in a task that holds their whole sets, counts what
they share by an inverted index and emits only links that join two parts, never pairs. Every candidate is verified on whole sets.

Defined results: fewer words than a shingle are one shingle; a text without a word is like no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import materialized, releasing, text_batches, tidy
from framesift.llm.components import connected_components
from framesift.llm.simhash import MAX_BITS, SHINGLE, links, parts_of, shingle_hashes, simhash

#: Words of a shingle; the similarity is UP / DOWN.
WORDS = 5
UP, DOWN = 4, 5
PAIRWISE = 64
HUBS = 4
PAIRS_AT_ONCE = 100_000
#: Shingles of a block of texts (8 bytes each); two blocks are in memory at once.
BLOCK = 1_000_000
#: One text of so many is counted for the order; shingles seen this often there are common, the first of them are known by count.
SAMPLED, COMMON, COMMON_LIMIT = 16, 3, 200_000
#: Texts that may be broadcast by key (8 bytes each).
BROADCAST_KEYS = 1_000_000


def common_shingles(docs: DataFrame, text_col: str = "text", words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) and counts of shingles that are common in the sample."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 100):
                yield pd.DataFrame({"h": np.concatenate([np.unique(shingle_hashes(x, words)).view(np.int64) for x in batch["text"][at : at + 100]])})

    rows = docs.select(docs[text_col].cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    counts = text_batches(rows).mapInPandas(releasing(run), "h long").groupBy("h").count().where(F.col("count") >= COMMON)
    found = counts.orderBy(F.desc("count"), "h").limit(COMMON_LIMIT).toPandas()
    hashes = found["h"].to_numpy(dtype=np.int64)
    order = np.argsort(hashes)
    return hashes[order], found["count"].to_numpy(dtype=np.int64)[order]


def signatures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id, key (hash of the text), fp (of op6), t (key of the set), n (size of the set), s (its rarest, which are posted): a row for each row of docs."""
    known = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text_col, words))

    def ordered(text: str | None) -> np.ndarray:
        own = np.unique(shingle_hashes(text, words).view(np.int64))
        hashes, counts = known.value
        if not len(own) or not len(hashes):
            return own
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        return own[np.lexsort((own, np.where(hashes[at] == own, counts[at], 0)))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            fps = np.fromiter((simhash(shingle_hashes(x, SHINGLE)) for x in batch["text"]), dtype=np.uint64, count=len(batch))
            sets = [ordered(x) for x in batch["text"]]
            keys = np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in sets), dtype=np.uint64, count=len(batch))
            yield pd.DataFrame({"id": batch["id"], "key": batch["key"], "fp": fps.view(np.int64), "t": keys.view(np.int64), "n": [len(s) for s in sets], "s": [s[: len(s) - -(-UP * len(s) // DOWN) + 1] for s in sets]})

    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].cast("string").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    found = text_batches(rows).mapInPandas(releasing(run), "id string, key long, fp long, t long, n int, s array<long>")
    return found.withColumn("id", F.col("id").cast("long"))


def _emit(groups: DataFrame, kind: str) -> DataFrame:
    """a, b, na, nb (a < b): pairs of the members of groups, by kind: all pairs, or pairs with hubs."""

    def pairs(h: int, t: np.ndarray, n: np.ndarray) -> Iterator[np.ndarray]:
        order = np.argsort(t)
        t, n = t[order], n[order]
        if kind == "hubs":
            firsts = [int(np.argmin(t.view(np.uint64) ^ np.uint64(h % HUBS * 0x3E3779B97F4A7C15)))]
        else:
            firsts = range(len(t) - 1)
        for i in firsts:
            j = np.arange(0 if kind == "hubs" else i + 1, len(t))
            fit = (DOWN * np.minimum(n[i], n[j]) >= UP * np.maximum(n[i], n[j])) & (j != i)
            low, high = np.minimum(i, j[fit]), np.maximum(i, j[fit])
            if len(low):
                yield np.stack([t[low], t[high], n[low], n[high]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, count = [], 0
            for h, t, n in zip(batch["h"], batch["t"], batch["n"], strict=True):
                for found in pairs(h, np.asarray(t), np.asarray(n, dtype=np.int64)):
                    held.append(found)
                    count += found.shape[1]
                    if count >= PAIRS_AT_ONCE:
                        yield pd.DataFrame(np.concatenate(held, axis=1).T, columns=["a", "b", "na", "nb"])
                        held, count = [], 0
            if held:
                yield pd.DataFrame(np.concatenate(held, axis=1).T, columns=["a", "b", "na", "nb"])

    groups = groups.select("h", F.col("members.t").alias("t"), F.col("members.n").alias("n"))
    return groups.mapInPandas(releasing(run), "a long, b long, na long, nb long")


def _sets(keys: DataFrame, rows: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """t, fp, s: whole sets, made again for the texts t of keys only. rows is stored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"t": batch["t"], "fp": batch["fp"], "s": [np.unique(shingle_hashes(x, words).view(np.int64)) for x in batch["text"]]})

    keys = rows.select("t", "key", "fp").join(keys.distinct(), "t", "left_semi").groupBy("t").agg(F.min(F.struct("key", "fp")).alias("least"))
    keys = materialized(keys.select("t", "least.key", "least.fp"))
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    wanted = text_batches(texts.join(keys, "key").select("t", "fp", "text"))
    return materialized(wanted.mapInPandas(releasing(run), "t long, fp long, s array<long>").dropDuplicates(["t"]))


def _verified(pairs: DataFrame, rows: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """a, b: fingerprints of the pairs whose whole sets are similar. pairs is stored."""
    sets = _sets(pairs.select(F.col("a").alias("t")).unionByName(pairs.select(F.col("b").alias("t"))), rows, texts, words)
    one = sets.select(F.col("t").alias("a"), F.col("fp").alias("fa"), F.col("s").alias("sa"))
    two = sets.select(F.col("t").alias("b"), F.col("fp").alias("fb"), F.col("s").alias("sb"))
    both = pairs.join(one, "a").join(two, "b")
    alike = both.where((UP + DOWN) * F.size(F.array_intersect("sa", "sb")) >= UP * (F.col("na") + F.col("nb")))
    return materialized(alike.select(F.col("fa").alias("a"), F.col("fb").alias("b")).distinct())


def joining(one: list[np.ndarray], two: list[np.ndarray], one_parts: np.ndarray, two_parts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Places in one and in two of similar sets, as far as they join parts that no earlier link of these has joined."""
    if not len(one) or not len(two):
        return
    names, parts = np.unique(np.concatenate([one_parts, two_parts]), return_inverse=True)
    ours, theirs = parts[: len(one)].copy(), parts[len(one) :].copy()
    shingles = np.concatenate(two)
    sizes = np.array([len(x) for x in two])
    order = np.argsort(shingles, kind="stable")
    owners = np.repeat(np.arange(len(two)), sizes)[order]
    known, first, counts = np.unique(shingles[order], return_index=True, return_counts=True)
    for i, own in enumerate(one):
        if not len(own) or (theirs == ours[i]).all():
            continue
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        at = at[known[at] == own]
        n = counts[at]
        where = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(owners[where], minlength=len(two))
        for j in np.flatnonzero(((UP + DOWN) * shared >= UP * (len(own) + sizes)) & (theirs != ours[i])):
            gone, kept = theirs[j], ours[i]
            if gone != kept:
                yield i, int(j)
                ours[ours == gone] = kept
                theirs[theirs == gone] = kept


def _joined(members: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """a, b: links that join parts of groups. members: h, t, n, root; sets: t, fp, s."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                side, root, fps = np.asarray(r.side), np.asarray(r.root), np.asarray(r.fp)
                held = [np.asarray(x) for x in r.s]
                one = np.flatnonzero(side == r.low)
                two = np.flatnonzero(side == r.high)
                found = list(joining([held[i] for i in one], [held[j] for j in two], root[one], root[two]))
                yield pd.DataFrame({"a": [fps[one[i]] for i, _ in found], "b": [fps[two[j]] for _, j in found]}, dtype="int64")

    blocks = members.groupBy("h").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    dealt = members.join(blocks, "h").withColumn("side", F.pmod(F.xxhash64("t", "h"), "blocks").cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("h", "t", "root", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))
    met = dealt.join(sets, "t").groupBy("h", "low", "high").agg(F.collect_list(F.struct("side", "root", "fp", "s")).alias("m"))
    met = met.select("low", "high", *[F.col(f"m.{c}").alias(c) for c in ("side", "root", "fp", "s")])
    few = int(members.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    members.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(few, 4) if few > 0 else 4))
    try:
        return materialized(met.mapInPandas(releasing(run), "a long, b long").distinct())
    finally:
        members.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(few))


def similar_links(rows: DataFrame, near: DataFrame, texts: DataFrame, *, words: int = WORDS, pairwise: int = PAIRWISE, block: int = BLOCK) -> DataFrame:
    """a, b: fingerprints whose links, with those of near, span every part that pairs of similar texts link.

    rows: signatures, stored; near: links a, b between fingerprints, stored; texts: key, text.
    """
    posted = rows.where("n > 0").select("t", "n", F.explode("s").alias("h"))
    groups = posted.groupBy("h").agg(F.collect_set(F.struct("t", "n")).alias("members")).where(F.size("members") > 1)
    groups = materialized(groups)
    tidy(rows.sparkSession)  # the exchange of all posted places is read no more
    small, large = groups.where(F.size("members") <= pairwise), groups.where(F.size("members") > pairwise)
    counted = _emit(small, "all").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))
    # Past the posted places of the one whose last comes first, ceil(4n/5) - 1 places remain.
    rest = F.ceil(F.greatest("na", "nb") * UP / DOWN) - 1
    counted = counted.where((UP + DOWN) * (F.col("shared") + rest) >= UP * (F.col("na") + F.col("nb"))).drop("shared")
    hubs = _emit(large, "hubs")
    found = _verified(materialized(counted.unionByName(hubs).distinct()), rows, texts, words)
    tidy(rows.sparkSession)  # nor are the candidates' whole sets
    same = rows.where("n > 0").groupBy("t").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # one set, repeated otherwise
    found = found.unionByName(same.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")))
    if not large.limit(1).count():
        return found
    # Pairs that share a large group, of any count of shared shingles, unless they are linked by now.
    roots = connected_components(near.unionByName(found))
    of_text = rows.select("t", "fp").distinct().dropDuplicates(["t"]).join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    of_text = of_text.select("t", F.coalesce("root", "fp").alias("root"))
    members = large.select("h", F.explode("members").alias("m")).select("h", "m.t", "m.n").join(of_text, "t")
    mixed = members.groupBy("h").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("h")
    members = materialized(members.join(mixed, "h").select("h", "t", "n", "root"))
    if not members.limit(1).count():
        return found
    return found.unionByName(_joined(members, _sets(members.select("t"), rows, texts, words), block))


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, max_bits: int = MAX_BITS, pairwise: int = PAIRWISE, block: int = BLOCK) -> DataFrame:
    """A row for each row of docs: id, key (xxhash64 of the text), fp, root (names the component), component (its smallest id, over SimHash links and similar texts)."""
    rows = materialized(signatures(docs, id_col=id_col, text_col=text_col, words=words))
    near = materialized(links(rows.select("fp"), max_bits))
    tidy(docs.sparkSession)
    text = docs[text_col].cast("string")
    texts = docs.select(F.xxhash64(text).alias("key"), text.alias("text"))
    every = near.unionByName(similar_links(rows, near, texts, words=words, pairwise=pairwise, block=block))
    return parts_of(rows.select("id", "key", "fp"), every)
