"""Token ids as compressed binary shards: a static range asymmetric numeral system (rANS).

One frequency table, counted over the whole corpus, is shared by all blocks. A block holds whole
documents, about BLOCK_IDS ids or one longer document, and any reader can start at any block. Inside a block each part
of lanes x steps ids (16 in a full block) is coded on its own by interleaved coders: its checkpoint has every lane's state and the place
in the stream, and a CRC-32 of its ids. So parts decode alone (decode_range) or all together: numpy steps all lanes of all parts at once.

A block, little-endian:

    magic b"FSB2", lanes u32, steps u32, n_ids u64, n_parts u32, n_words u32, n_docs u32,
    doc lengths u32[n_docs], part CRCs u32[n_parts], part word offsets u32[n_parts],
    part states u64[n_parts, lanes], words u32[n_words]

Id i of a part is coded by lane i % lanes at step i // lanes. Coding runs backwards and decoding forwards, as
rANS is last in, first out. Each lane has a 64-bit state of at least 2^31 and exchanges 32-bit words. Short blocks have fewer lanes, so that
states stay a small part of them.

Shards are written through Spark (a Parquet container with a row for each block), so any store that Spark
writes serves, and its commit protocol makes shards whole when executors are lost.

Defined results: a null text is empty; every document ends with the end id, so none is empty; null ids of
documents sort first; repeated ids are documents of their own, in the order of their ids. An empty
table gives no blocks. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm.common import releasing, remove, text_batches, work_path

END_ID = 2
BLOCK_IDS = 1 << 21
#: Lanes of a full block, the fewest, and ids of a block for each lane.
LANES, LEAST_LANES, IDS_A_LANE = 256, 4, 1 << 10
CHECKPOINT_STEPS = 1 << 9
PRECISION = 20
#: Bytes of packed ids counted at once.
COUNT_BYTES = 1 << 22
LOWER = 1 << 31
MAGIC = b"FSB2"
HEAD = "<4sIIQIII"
#: Words kept by each of the two generations of a task's tokenizing cache, and the longest word kept.
CACHE_WORDS, CACHE_CHARS = 1 << 19, 64
#: White space of Python's split() that the tokenizer takes for ordinary characters.
ODD_SPACES = ("\x1c", "\x1d", "\x1e", "\x1f")


# ---- tokenizing


#: Beside visible ASCII the characters for which cut() is known to split, lower and compose as the tokenizer does.
PLAIN = re.compile(r"[!-~\u00a1-\u024f]+")
#: Fixed pattern of the vocabulary's pieces (its own, which is part of its file).
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Marks that often end a word; each is a piece of its own after letters.
STOPS = ".,;:!?"
#: Fixed parts of the vocabulary's file under which a text may be cut into words and pieces here.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: visible Latin-1 characters stand for themselves, other bytes for those from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Words(dict):
    """Word -> its ids as bytes.

    For a vocabulary whose file asks for just what cut() does (KNOWN), a word of plain characters is cut into pieces here
    and the library's model codes each piece once; any other word goes through the library's whole chain. For any
    other file every text goes through the library whole. A full cache becomes the old one, whose words come back when they are met.
    """

    def __init__(self, tokenizer, cache_words: int | None = None):
        import regex

        self.cache_words = cache_words or CACHE_WORDS

        self.tokenizer, self.model = tokenizer, tokenizer.model
        # Each part's own state: the whole file's would hold the vocabulary as well.
        chain = {k: json.loads(part.__getstate__()) if (part := getattr(tokenizer, k)) is not None else None for k in KNOWN}
        self.by_words = chain == KNOWN and getattr(self.model, "end_of_word_suffix", None) == "</w>"
        self.kind = "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.pieces: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.find, self.letters = regex.compile(PIECE).findall, _byte_letters()
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.marks = {t[0] for t in self.special}  # one character tells of most words that they hold none

    def forget(self) -> None:
        """Empties the caches: workers outlive tasks."""
        self.clear()
        self.old, self.pieces = {}, {}

    def packed(self, ids: list[int]) -> bytes:
        return array("H" if self.kind == "<u2" else "I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def coded(self, text: str) -> bytes:
        """The ids of one piece, lower-case."""
        letters = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
        return self.packed([t.id for t in self.model.tokenize(letters)])

    def piece(self, text: str) -> bytes:
        if (known := self.pieces.get(text)) is None:
            known = self.coded(text)
            if len(self.pieces) >= self.cache_words:
                self.pieces.clear()
            self.pieces[text] = known
        return known

    def cut(self, word: str) -> bytes:
        """A word that isn't letters only."""
        if word[-1] in STOPS and (bare := word[:-1].lower()).isalpha():
            return self[bare] + self.piece(word[-1])
        return b"".join(map(self.piece, self.find(word.lower())))

    def __missing__(self, word: str) -> bytes:
        if len(word) > CACHE_CHARS:
            return self.encode(word)
        if self.old and (ids := self.old.get(word)) is not None:
            pass
        elif not (word.isprintable() if word.isascii() else PLAIN.fullmatch(word)):
            ids = self.encode(word)
        elif word.isalpha():
            ids = self.coded(word) if (low := word.lower()) == word else self[low]
        elif any(m in word for m in self.marks) and any(s in word for s in self.special):
            ids = self.encode(word)
        else:
            ids = self.cut(word)
        if len(self) >= self.cache_words:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


_CODERS: dict[str, _Words] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def coder(path: str, cache_words: int = CACHE_WORDS) -> _Words:
    if path not in _CODERS:
        from tokenizers import Tokenizer

        _CODERS[path] = _Words(Tokenizer.from_file(path))
    _CODERS[path].cache_words = cache_words
    return _CODERS[path]


def encode_text(words: _Words, text: str) -> bytes:
    """The ids of a whole text, equal to the tokenizer's own on the text at once: its pattern never crosses white
    space, and neither normal form nor case mapping do."""
    if not words.by_words or any(c in text for c in ODD_SPACES):
        return words.encode(text)
    return b"".join(map(words.__getitem__, text.split()))


# ---- coding


def normalized_frequencies(counts: dict[int, int], precision: int = PRECISION) -> tuple[np.ndarray, np.ndarray]:
    """Ids that occur, ascending, and their frequencies: at least 1 each, summing to 2**precision."""
    ids = np.array(sorted(counts), dtype=np.int64)
    if not len(ids):
        return ids, np.zeros(0, dtype=np.int64)
    total = 1 << precision
    if len(ids) > total:
        raise ValueError(f"{len(ids)} ids don't fit a table of 2**{precision}")
    n = np.array([counts[i] for i in ids.tolist()], dtype=np.float64)
    freq = np.maximum(1, np.floor(n / n.sum() * (total - len(ids)))).astype(np.int64)
    over = total - int(freq.sum())
    freq[int(freq.argmax())] += over
    return ids, freq


class Table:
    """Frequencies as lookup arrays: by id for coding, by slot for decoding."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray, precision: int = PRECISION):
        self.precision = precision
        top = int(ids[-1]) + 1 if len(ids) else 0
        self.freq = np.zeros(top, dtype=np.uint64)
        self.base = np.zeros(top, dtype=np.uint64)
        self.freq[ids] = freq
        self.base[ids] = np.cumsum(freq) - freq
        self.slots = np.repeat(ids, freq).astype(np.uint32)


def lanes_for(n: int) -> int:
    return max(LEAST_LANES, min(LANES, n // IDS_A_LANE))


def encode_block(ids: np.ndarray, lengths: np.ndarray, table: Table, lanes: int | None = None, steps: int = CHECKPOINT_STEPS) -> bytes:
    """lanes: by the count of ids, unless given."""
    n = len(ids)
    lanes = lanes or lanes_for(n)
    per_part = lanes * steps
    whole = n // per_part
    made = [encode_parts(ids[: whole * per_part], whole, lanes, table)] if whole else []
    if n > whole * per_part or not n:
        made.append(encode_parts(ids[whole * per_part :], 1, lanes, table))  # the rest, a shorter part
    states = np.concatenate([s for s, _, _ in made])
    counts = np.concatenate([c for _, c, _ in made])
    words = np.concatenate([w for _, _, w in made])
    crcs = np.array([zlib.crc32(ids[at : at + per_part].astype("<u4").tobytes()) for at in range(0, max(n, 1), per_part)], dtype="<u4")
    offsets = (np.cumsum(counts) - counts).astype("<u4")
    head = struct.pack(HEAD, MAGIC, lanes, steps, n, len(crcs), len(words), len(lengths))
    return b"".join([head, lengths.astype("<u4").tobytes(), crcs.tobytes(), offsets.tobytes(), states.astype("<u8").tobytes(), words.astype("<u4").tobytes()])


def encode_parts(ids: np.ndarray, parts: int, lanes: int, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of equal length, side by side: (states by part and lane, count of words by part, words part by part)."""
    own = ids.reshape(parts, -1)
    shift, limit = np.uint64(table.precision), np.uint64(63 - table.precision)
    whole = np.uint64(1 << table.precision)
    x = np.full((parts, lanes), LOWER, dtype=np.uint64)
    words: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    kind = np.uint16 if parts < 1 << 16 else np.uint32  # short ones are sorted by radix
    last = own.shape[1] - 1
    for at in range(last // lanes * lanes if last >= 0 else -1, -1, -lanes):
        now = own[:, at : at + lanes]
        width = now.shape[1]
        live = x if width == lanes else x[:, :width].copy()
        f, flat = table.freq[now], live.reshape(-1)
        full = np.flatnonzero(live >= f << limit)
        if len(full):
            high = flat[full]
            words.append(high.astype("<u4"))  # the low word
            owners.append((full // width).astype(kind))
            flat[full] = high >> np.uint64(32)
        quotient = live // f
        # q << shift | x % f, plus base: with r = x - q * f, x + q * (2**shift - f) + base
        live += quotient * (whole - f)
        live += table.base[now]
        if width < lanes:
            x[:, :width] = live
    if not words:
        return x, np.zeros(parts, dtype=np.int64), np.zeros(0, dtype="<u4")
    owner = np.concatenate(owners[::-1])
    return x, np.bincount(owner, minlength=parts), np.concatenate(words[::-1])[np.argsort(owner, kind="stable")]


class Block:
    """A block's head and arrays; raises ValueError where it is none."""

    def __init__(self, data: bytes):
        if len(data) < struct.calcsize(HEAD) or data[:4] != MAGIC:
            raise ValueError("not a block")
        _, self.lanes, self.steps, self.n, self.n_parts, n_words, n_docs = struct.unpack_from(HEAD, data)
        at = struct.calcsize(HEAD)
        arrays = []
        for kind, count in (("<u4", n_docs), ("<u4", self.n_parts), ("<u4", self.n_parts), ("<u8", self.n_parts * self.lanes), ("<u4", n_words)):
            arrays.append(np.frombuffer(data, dtype=kind, count=count, offset=at))
            at += arrays[-1].nbytes
        self.lengths, self.crcs, self.offsets, states, self.stream = arrays
        self.states = states.reshape(self.n_parts, self.lanes)
        self.per_part = self.lanes * self.steps

    def decode(self, first: int, last: int, table: Table) -> np.ndarray:
        """The ids of parts first to last (excluded), from their checkpoints."""
        begin, end = first * self.per_part, min(last * self.per_part, self.n)
        whole = min(last, self.n // self.per_part) - first  # of full length
        made = [decode_parts(self.states[first : first + whole], self.offsets[first : first + whole], self.stream, self.per_part, table)] if whole > 0 else []
        if (rest := end - begin - max(whole, 0) * self.per_part) > 0 or not self.n:
            made.append(decode_parts(self.states[last - 1 : last], self.offsets[last - 1 : last], self.stream, rest, table))
        ids = np.concatenate([m.reshape(-1) for m, _ in made])
        for p in range(first, last):
            own = ids[(p - first) * self.per_part : (p - first + 1) * self.per_part]
            if zlib.crc32(own.astype("<u4").tobytes()) != int(self.crcs[p]):
                raise ValueError(f"checksum of part {p} doesn't hold")
        if any((x != LOWER).any() for _, x in made):
            raise ValueError("a part doesn't end in the state that coding began with")
        return ids


def decode_parts(states: np.ndarray, offsets: np.ndarray, stream: np.ndarray, length: int, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """Parts of equal length, side by side: (ids by part, last states, those that coding began with)."""
    shift, slot_mask = np.uint64(table.precision), np.uint64((1 << table.precision) - 1)
    word, lower = np.uint64(32), np.uint64(LOWER)
    x, at = states.astype(np.uint64), offsets.astype(np.int64)
    parts, lanes = x.shape
    ids = np.empty((parts, length), dtype=np.uint32)
    for i in range(0, length, lanes):
        width = min(lanes, length - i)
        live = x if width == lanes else x[:, :width].copy()
        slot = live & slot_mask
        found = table.slots[slot]
        ids[:, i : i + width] = found
        slot -= table.base[found]
        live >>= shift
        live *= table.freq[found]
        live += slot
        short = np.flatnonzero(live < lower)
        if len(short):
            part = short // width
            taken = np.bincount(part, minlength=parts)
            places = np.arange(len(short)) + (at - np.cumsum(taken) + taken)[part]
            if places.max() >= len(stream):
                raise ValueError("a part reads beyond the stream")
            flat = live.reshape(-1)
            flat[short] = (flat[short] << word) | stream[places]
            at += taken
        if width < lanes:
            x[:, :width] = live
    return ids, x


def decode_block(block: bytes, table: Table, steps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids as u32, document lengths); raises ValueError where a checksum doesn't hold. steps: what the block must have been coded with, if given."""
    held = Block(block)
    if steps not in (None, held.steps):
        raise ValueError(f"the block has {held.steps} steps a part")
    return held.decode(0, held.n_parts, table), held.lengths


def decode_range(block: bytes, table: Table, start: int, count: int) -> np.ndarray:
    """count ids from a place on: only the parts that hold them are decoded."""
    held = Block(block)
    if not 0 <= start <= start + count <= held.n:
        raise ValueError(f"the block has {held.n} ids")
    if not count:
        return np.zeros(0, dtype=np.uint32)
    first, last = start // held.per_part, -(-(start + count) // held.per_part)
    return held.decode(first, last, table)[start - first * held.per_part :][:count]


# ---- Spark


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID, cache_words: int = CACHE_WORDS) -> DataFrame:
    """id, ids: every text's ids and the end id, packed; with them a row for each task, whose counts say how often it saw each id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, total = coder(path, cache_words), np.zeros(1, dtype="<i8")
        end = words.packed([end_id])
        for batch in batches:
            made = [encode_text(words, t or "") + end for t in batch["text"]]
            for some in _by_size(made, COUNT_BYTES):
                found = np.bincount(np.frombuffer(b"".join(some), dtype=words.kind), minlength=len(total))
                found[: len(total)] += total
                total = found
            yield pd.DataFrame({"id": batch["id"], "ids": made, "counts": None})
        words.forget()
        yield pd.DataFrame({"id": [None], "ids": [None], "counts": [total.astype("<i8").tobytes()]})

    rows = docs.select(F.col("id").cast("string").alias("id"), "text")  # as text, or null ids would turn all into floats
    return text_batches(rows).mapInPandas(releasing(run), "id string, ids binary, counts binary").select(F.col("id").cast("long").alias("id"), "ids", "counts")


def _by_size(held: list[bytes], size: int) -> Iterator[list[bytes]]:
    """Slices of a list that end where they reach a size."""
    first, n = 0, 0
    for i, x in enumerate(held, 1):
        n += len(x)
        if n >= size or i == len(held):
            yield held[first:i]
            first, n = i, 0


def count_ids(tokenized: DataFrame) -> DataFrame:
    """token, n over all documents, from the tasks' counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for counts in batch["counts"]:
                n = np.frombuffer(counts, dtype="<i8")
                seen = np.flatnonzero(n)
                yield pd.DataFrame({"token": seen, "n": n[seen]})

    return tokenized.where("counts IS NOT NULL").select("counts").mapInPandas(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def write_shards(docs: DataFrame, out: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, cache_words: int = CACHE_WORDS) -> None:
    """Tokenizes and writes docs in ascending order of id: out/table, out/blocks, out/shards (the count of ids before each).

    Texts are tokenized once; their ids wait in out/ids while the shared table is counted (it is as large as the
    vocabulary, which bounds it) and are then exchanged once, by ranges of id. Each range is a shard, coded in a
    stream with one block in memory at a time. Repeated ids follow the order of their packed ids. cache_words: words that a task remembers
    (some 150 bytes each, twice); fewer take less memory and more time.
    """
    spark, path = docs.sparkSession, tokenizer or tokenizer_path()
    kind = coder(path).kind
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    tokenize(rows, path, end_id, cache_words).write.option("compression", "zstd").parquet(f"{out}/ids")
    tokenized = spark.read.parquet(f"{out}/ids")
    counted = {int(r["token"]): int(r["n"]) for r in count_ids(tokenized).collect()}  # bounded by the vocabulary
    ids, freq = normalized_frequencies(counted)
    spark.createDataFrame(pd.DataFrame({"token": ids, "freq": freq}), "token long, freq long").coalesce(1).write.parquet(f"{out}/table")
    shared = spark.sparkContext.broadcast((ids, freq))

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        table, shard = Table(*shared.value), TaskContext.get().partitionId()
        names, held, n_held, start, number = [], [], 0, 0, 0

        def block() -> pd.DataFrame:
            nonlocal names, held, n_held, start, number
            lengths = np.array([len(x) for x in held], dtype=np.int64)
            row = pd.DataFrame({"shard": [shard], "block": [number], "start": [start], "n_ids": [n_held], "docs": [names], "data": [encode_block(np.concatenate(held), lengths, table)]})
            names, held, start, n_held, number = [], [], start + n_held, 0, number + 1
            return row

        for batch in batches:
            for name, packed in zip(batch["id"], batch["ids"], strict=True):
                own = np.frombuffer(packed, dtype=kind)
                if held and n_held + len(own) > BLOCK_IDS:
                    yield block()
                names.append(None if name is None else int(name))
                held.append(own)
                n_held += len(own)
        if held:
            yield block()

    ordered = tokenized.where("ids IS NOT NULL").select("id", "ids").repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "ids")
    ordered = ordered.select(F.col("id").cast("string").alias("id"), "ids")
    ordered.mapInPandas(releasing(code), "shard int, block int, start long, n_ids long, docs array<long>, data binary").write.parquet(f"{out}/blocks")
    per = spark.read.parquet(f"{out}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    bases, at = [], 0
    for r in per:  # a row for each shard, as many as tasks have written
        bases.append((r["shard"], at))
        at += r["n"]
    spark.createDataFrame(bases, "shard int, base long").coalesce(1).write.parquet(f"{out}/shards")
    remove(spark, f"{out}/ids")


def read_documents(spark: SparkSession, out: str, wanted: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """id, ids (binary, little-endian u32) of some documents: blocks are found by their lists of ids, and in each only the parts that hold a wanted
    document are decoded. wanted is joined, not collected; a null id finds none."""
    rows = spark.read.parquet(f"{out}/table").orderBy("token").collect()  # bounded by the vocabulary
    shared = spark.sparkContext.broadcast((np.array([r["token"] for r in rows], dtype=np.int64), np.array([r["freq"] for r in rows], dtype=np.int64)))
    ids = wanted.select(wanted[id_col].cast("long").alias("id")).distinct()
    blocks = spark.read.parquet(f"{out}/blocks")
    places = blocks.select("shard", "block", F.posexplode("docs").alias("at", "id")).join(ids, "id").groupBy("shard", "block").agg(F.collect_set("at").alias("places"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Table(*shared.value)
        for batch in batches:
            for r in batch.itertuples(index=False):
                ends = np.cumsum(Block(r.data).lengths.astype(np.int64))
                for at in sorted(int(p) for p in r.places):
                    n = int(ends[at] - (ends[at - 1] if at else 0))
                    yield pd.DataFrame({"id": [int(r.docs[at])], "ids": [decode_range(r.data, table, int(ends[at]) - n, n).astype("<u4").tobytes()]})

    return blocks.join(places, ["shard", "block"]).select("docs", "data", "places").mapInPandas(releasing(run), "id long, ids binary")


def read_shards(spark: SparkSession, out: str) -> DataFrame:
    """Every document of the shards, decoded: id, start (ids before it), ids as binary (little-endian u32)."""
    return _decoded(spark, out, lambda ids: {"ids": ids.astype("<u4").tobytes()}, "ids binary")


def describe_shards(spark: SparkSession, out: str) -> DataFrame:
    """As read_shards, with the count and CRC-32 of the decoded ids in place of the ids."""
    return _decoded(spark, out, lambda ids: {"n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}, "n_tokens long, ids_crc32 long")


def _decoded(spark: SparkSession, out: str, told: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    rows = spark.read.parquet(f"{out}/table").orderBy("token").collect()  # bounded by the vocabulary
    shared = spark.sparkContext.broadcast((np.array([r["token"] for r in rows], dtype=np.int64), np.array([r["freq"] for r in rows], dtype=np.int64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Table(*shared.value)
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids, lengths = decode_block(r.data, table)
                ends, first = np.cumsum(lengths), r.start + r.base
                found = [{"start": first + end - n} | told(ids[end - n : end]) for end, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                made = pd.DataFrame(found)
                made.insert(0, "id", pd.array([None if pd.isna(d) else int(d) for d in r.docs], dtype="Int64"))
                yield made

    blocks = spark.read.parquet(f"{out}/blocks")
    bases = spark.read.parquet(f"{out}/shards")  # a row for each shard
    return blocks.join(bases, "shard").select("docs", "data", "start", "base").mapInPandas(releasing(run), f"id long, start long, {schema}")


def query(spark, sf_dir):
    from framesift.llm.common import table

    out = work_path(spark, "shards")
    write_shards(table(spark, sf_dir, "documents"), out)
    return describe_shards(spark, out).withColumnRenamed("id", "doc_id")
