"""Substring dedup: repeated word windows, merged to spans in their sources.

No graph is compacted (no k-mer nodes, no nonbranching test). Windows are compared by 96 bits of two independent hashes of
all their words, not word by word.

The graph's edges are WINDOW-word windows; an edge that starts at two places or more is repeated, and every word
that a repeated edge covers is removed. Consecutive repeated edges of a source overlap in all but one word, so they
compact to one path; paths come back to their sources by a join on the coordinates and are cut out of the text there.

Edges of all texts are never exchanged. First a sample of shorter edges is: in each run of windows the
smallest hash among the GRAM-word edges inside a window (its minimizer). Equal windows have equal minimizers at equal
offsets, so a window can only be repeated if its minimizer is. Windows whose minimizer is repeated are then
compared themselves, in full.

Hot edges: what repeats within one batch of texts is settled there; it sends the batch's one witness for others, and its own
finding on a key of its own. So at most one row per edge and batch meets in a task, however many copies there are. Texts are
exchanged once, by a hash of id and text; the plan reads that exchange three times. Rows that are alike in both are one source with
so many copies: every window of it repeats, and only the first row is looked at.

Edges are 64-bit polynomial hashes of word hashes, finally mixed; windows also carry 32 bits of one with another base over other
word hashes, so that two different windows pass for one with a chance of 2^-96.

Defined results: a null text has no words; texts shorter than a window keep all; rows that repeat an id are documents of
their own, and repeat each other where their words do; null ids are ids like any other. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm.common import text_batches

WINDOW = 35
GRAM = 18
#: Words hashed together; what repeats among them is settled there.
BATCH_WORDS = 2_000_000
CACHE_WORDS = 300_000
BASE = 0x9E3779B97F4A7C15
CHECK_BASE = 0xD1342543DE82EF95
#: key and ord name a source; g is the windows' second hash.
FOUND = "known boolean, h long, g int, key long, ord int, pos int, len int"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


_HASHES = _Hashes()
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(n, 1 << 16)
        known = np.ones(size, dtype=np.uint64)
        known[1:] = np.cumprod(np.full(size - 1, base, dtype=np.uint64))
        if size <= 1 << 20:
            _POWERS[base] = known
    return known[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


class Rolling:
    """Hashes of all k-word windows of a text."""

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        self.own = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=self.n)
        self.sums = self._summed(self.own, BASE)

    def _summed(self, values: np.ndarray, base: int) -> np.ndarray:
        sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(values * _powers(base, self.n), out=sums[1:])
        return sums

    def windows(self, k: int) -> np.ndarray:
        count = self.n - k + 1
        return _mix((self.sums[k:] - self.sums[:-k]) * _powers(pow(BASE, -1, 1 << 64), count))

    def checks(self, k: int, places: np.ndarray) -> np.ndarray:
        """The second hash of the windows at these places."""
        sums = self._summed(_mix(self.own ^ np.uint64(CHECK_BASE)), CHECK_BASE)
        inverse = _powers(pow(CHECK_BASE, -1, 1 << 64), self.n - k + 1)
        return _mix((sums[places + k] - sums[places]) * inverse[places]).astype(np.uint32).view(np.int32)


def minimizers(grams: np.ndarray, span: int) -> np.ndarray:
    """For each run of `span` grams the place of its smallest hash, the last one of equals."""
    n = len(grams) - span + 1
    place = np.arange(len(grams))

    def smaller(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(grams[a] < grams[b], a, b)

    width = 1
    while width * 2 <= span:
        place = smaller(place[:-width], place[width:])
        width *= 2
    if width < span:
        place = smaller(place[: n], place[span - width : span - width + n])
    return place[:n]


def _settle(h: list[np.ndarray], g: list[np.ndarray], keys: list, ords: list, pos: list[np.ndarray], join_runs: bool) -> pd.DataFrame:
    """Rows for one batch: single hashes with their place; for those that repeat here a witness each, and their places as known."""
    sizes = [len(x) for x in h]
    hashes, checks, places = np.concatenate(h), np.concatenate(g), np.concatenate(pos)
    owner = np.repeat(np.arange(len(h)), sizes)
    order = np.lexsort((checks, hashes)) if checks.any() else np.argsort(hashes, kind="stable")
    ranked, ranked_g = hashes[order], checks[order]
    fresh = np.concatenate([[True], (ranked[1:] != ranked[:-1]) | (ranked_g[1:] != ranked_g[:-1])])
    first = np.flatnonzero(fresh)
    counts = np.diff(np.concatenate([first, [len(order)]]))
    multi = np.empty(len(order), dtype=bool)
    multi[order] = np.repeat(counts > 1, counts)
    single = ~multi
    witness = first[counts > 1]
    m_owner, m_place = owner[multi], places[multi]
    if join_runs and len(m_place):
        begun = np.concatenate([[True], (np.diff(m_owner) != 0) | (np.diff(m_place) != 1)])
        starts = np.flatnonzero(begun)
        length = np.diff(np.concatenate([starts, [len(m_place)]]))
        m_owner, m_place = m_owner[starts], m_place[starts]
    else:
        length = np.ones(len(m_place), dtype=np.int64)
    key_ = np.asarray(keys, dtype=np.int64)
    ord_ = np.asarray(ords, dtype=np.int64)
    blank, known = len(witness), len(m_place)
    s_owner = owner[single]
    spread = _mix(m_place.astype(np.uint64) * np.uint64(BASE) + _mix(m_owner.astype(np.uint64) + np.uint64(len(hashes))))
    return pd.DataFrame(
        {
            "known": np.concatenate([np.zeros(single.sum() + blank, dtype=bool), np.ones(known, dtype=bool)]),
            "h": np.concatenate([hashes[single], ranked[witness], spread]).view(np.int64),
            "g": np.concatenate([checks[single], ranked_g[witness], np.zeros(known, dtype=np.int32)]),
            "key": np.concatenate([key_[s_owner], np.zeros(blank, dtype=np.int64), key_[m_owner]]),
            "ord": np.concatenate([ord_[s_owner], np.full(blank, -1), ord_[m_owner]]),
            "pos": np.concatenate([places[single], np.full(blank, -1), m_place]),
            "len": np.concatenate([np.ones(single.sum(), dtype=np.int64), np.zeros(blank, dtype=np.int64), length]),
        }
    )


def _batched(batches: Iterator[pd.DataFrame], make, join_runs: bool) -> Iterator[pd.DataFrame]:
    """make(row) gives (hashes, second hashes, places, words counted). Yields settled batches of about BATCH_WORDS words."""
    h, g, keys, ords, pos, n = [], [], [], [], [], 0
    for batch in batches:
        for row in batch.itertuples(index=False):
            hashes, checks, places, words = make(row)
            if len(hashes):
                h.append(hashes)
                g.append(checks)
                keys.append(row.key)
                ords.append(row.ord)
                pos.append(places)
            n += words
            if n >= BATCH_WORDS:
                if h:
                    yield _settle(h, g, keys, ords, pos, join_runs)
                h, g, keys, ords, pos, n = [], [], [], [], [], 0
    if h:
        yield _settle(h, g, keys, ords, pos, join_runs)


def _repeated(found: DataFrame) -> DataFrame:
    """key, at_ord, at_pos, at_len: three arrays, an entry for each repeated place of the key's texts."""
    n = F.count(F.lit(1)).over(Window.partitionBy("known", "h", "g"))
    kept = found.withColumn("n", n).where((F.col("known") | (F.col("n") > 1)) & (F.col("ord") >= 0))
    grouped = kept.groupBy("key").agg(F.collect_list(F.struct("ord", "pos", "len")).alias("places"))
    return grouped.select("key", *[F.col(f"places.{c}").alias(f"at_{c}") for c in ("ord", "pos", "len")])


def _own(row) -> tuple[np.ndarray, np.ndarray]:
    """Places and lengths of a row's own ordinal (others are there only where the keys of different rows are equal)."""
    if row.at_pos is None:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    own = np.asarray(row.at_ord) == row.ord
    return np.asarray(row.at_pos, dtype=np.int64)[own], np.asarray(row.at_len, dtype=np.int64)[own]


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id, n_words, n_removed, text (kept words, one space between), spans (array of struct(start, length) removed)."""
    gram = max(1, (window + 1) // 2)
    span = window - gram + 1
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    rows = text_batches(rows).withColumn("key", F.xxhash64("id", "text")).repartition("key")
    alike = Window.partitionBy("key").orderBy("id", "text")
    rows = rows.select(
        "*",
        (F.dense_rank().over(alike) - 1).alias("ord"),
        (F.row_number().over(alike) == F.rank().over(alike)).alias("first"),
        F.count(F.lit(1)).over(alike.rangeBetween(Window.currentRow, Window.currentRow)).alias("copies"),
    )
    # Text's name of an id, for a null would turn all of a batch's into floats.
    rows = rows.select("key", "ord", "first", "copies", F.col("id").cast("string").alias("id"), "text")

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def make(row):
            words = words_of(row.text)
            if len(words) < window:
                return (), (), (), len(words)
            grams = Rolling(words).windows(gram)
            places = np.unique(minimizers(grams, span))
            return grams[places], np.zeros(len(places), dtype=np.int32), places, len(words)

        return _batched(batches, make, join_runs=False)

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def make(row):
            words = words_of(row.text)
            if len(words) < window:
                return (), (), (), len(words)
            rolling = Rolling(words)
            marked = np.zeros(len(words), dtype=bool)
            marked[np.asarray(row.at_pos)[np.asarray(row.at_ord) == row.ord]] = True
            places = np.flatnonzero(marked[minimizers(rolling.windows(gram), span)])
            return rolling.windows(window)[places], rolling.checks(window, places), places, len(words)

        return _batched(batches, make, join_runs=True)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                words = words_of(row.text)
                if row.copies > 1 and len(words) >= window:
                    out.append((row.id, len(words), len(words), "", [{"start": 0, "length": len(words)}]))
                    continue
                places, lengths = _own(row)
                if not len(places):
                    out.append((row.id, len(words), 0, b" ".join(words).decode("utf-8", "surrogatepass"), []))
                    continue
                change = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(change, places, 1)
                np.add.at(change, places + lengths + window - 1, -1)
                gone = np.cumsum(change)[:-1] > 0
                step = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                kept = b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])
                spans = [{"start": int(a), "length": int(b - a)} for a, b in zip(starts, ends, strict=True)]
                out.append((row.id, len(words), int(gone.sum()), kept.decode("utf-8", "surrogatepass"), spans))
            yield pd.DataFrame(out, columns=["id", "n_words", "n_removed", "text", "spans"])

    firsts = rows.where("first").select("key", "ord", "text")
    sampled = _repeated(firsts.mapInPandas(sample, FOUND))
    repeated = _repeated(firsts.join(sampled.hint("merge"), "key").select("key", "ord", "text", "at_ord", "at_pos").mapInPandas(edges, FOUND))
    placed = rows.join(repeated.hint("merge"), "key", "left").select("id", "ord", "copies", "text", "at_ord", "at_pos", "at_len")
    done = placed.mapInPandas(cut, "id string, n_words long, n_removed long, text string, spans array<struct<start:int,length:int>>")
    return done.withColumn("id", F.col("id").cast("long"))


def query(spark, sf_dir):
    from framesift.llm.common import table

    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, unnest(range(1, len(w) - 33)) AS p, unnest(list_transform(range(1, len(w) - 33), lambda p: array_to_string(w[p : p + 34], ' '))) AS t FROM d WHERE len(w) >= 35),
repeated AS (SELECT t FROM windows GROUP BY t HAVING count(*) > 1),
steps AS (SELECT r, p, 1 AS step FROM windows SEMI JOIN repeated USING (t) UNION ALL SELECT r, p + 35, -1 FROM windows SEMI JOIN repeated USING (t) UNION ALL SELECT r, unnest(range(1, len(w) + 1)), 0 FROM d),
covered AS (SELECT r, p, sum(sum(step)) OVER (PARTITION BY r ORDER BY p) > 0 AS gone FROM steps GROUP BY r, p),
kept AS (SELECT r, count(*) AS n, string_agg(w[p], ' ' ORDER BY p) AS text FROM covered JOIN d USING (r) WHERE NOT gone AND p <= len(w) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
