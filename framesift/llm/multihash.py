"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Each paragraph is hashed to a wide vector, and a text's fingerprint is the sum of its paragraphs'
vectors, lane by lane, modulo powers of two. So the order of paragraphs doesn't matter, and
a paragraph is inserted or deleted by adding or subtracting its vector (combine()), without the text.

A vector has two parts. Identity: 16 lanes modulo 2^32 from SHA-512 of the paragraph; texts with the
same multiset of paragraphs have equal lanes, others differ but for a hash collision. Likeness: 124
lanes modulo 2^32, each the sum of the signs +1 or -1 that hash bits give to the paragraph's word
triples. As sums of random signs their inner product estimates the shared triples (Alon, Matias and Szegedy's sketch),
so likeness() is a cosine: about the share of triples that two texts have in common, with a
standard error of 0.09.

The form of a fingerprint is the count of triples, the identity lanes and the likeness lanes, 8 hex digits each. Fingerprints
of nothing are all zero. No text has 2^31 words, so the signed likeness lanes never wrap, however often a triple repeats.

Everything is DataFrame expressions. Paragraphs and triples are made inside generated code and summed
in the task that reads the text; only sums leave it.

Defined results: a null text is empty; empty lines aren't paragraphs; a paragraph with fewer than three
words counts as one triple; null ids sort first; rows that repeat an id stay rows of their own, ordered by
text. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm.common import intake, trimmed_words
from framesift.llm.neighbours import with_successors

IDENTITY = 16
#: Two likeness lanes in one 64-bit sum, 31 bits apart: no text has 2^31 words, so the lower never reaches the upper.
PAIRS, APART = 31, 31
HASHES = 2
LANES = HASHES * PAIRS * 2
PICK = 1 | 1 << APART
LOW = (1 << APART) - 1


def _rows_of_triples(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text -> keys, p (place of the paragraph), i (of the triple in it), identity digest on a paragraph's first row, two hashes of a word triple."""
    paragraphs = rows.select(*keys, F.posexplode(F.split("text", r"\n+")).alias("p", "paragraph"))
    words = paragraphs.select(*keys, "p", F.when(F.col("paragraph") != "", F.sha2("paragraph", 512)).alias("digest"), trimmed_words(F.col("paragraph")).alias("words"))
    spread = words.select(*keys, "p", "digest", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 3, F.lit(0)))).alias("i"))
    second, third = F.get("words", F.col("i") + 1), F.get("words", F.col("i") + 2)
    first = F.get("words", F.col("i"))
    return spread.select(
        *keys,
        "p",
        "i",
        F.when(F.col("i") == 0, F.col("digest")).alias("digest"),
        F.when(F.col("digest").isNotNull(), F.xxhash64(first, second, third)).alias("h0"),
        F.when(F.col("digest").isNotNull(), F.xxhash64(third, first, second, F.lit(1))).alias("h1"),
    )


def fingerprint_sums(rows: DataFrame, keys: list[str], repeated: bool = False) -> DataFrame:
    """keys, text -> keys, fingerprint. The keys name one text each; rows of other texts never share a key.

    repeated: rows of equal text may share one; `times` says how many do.
    """
    triples = _rows_of_triples(rows, keys)
    sums = [F.count("h0").alias("n")]
    for h in range(HASHES):
        for j in range(PAIRS):
            sums.append(F.coalesce(F.sum(F.shiftrightunsigned(F.col(f"h{h}"), j).bitwiseAND(F.lit(PICK))), F.lit(0).cast("long")).alias(f"s{h}_{j}"))
    for k in range(IDENTITY):
        lane = F.conv(F.substring("digest", 1 + 8 * k, 8), 16, 10).cast("long")
        sums.append(F.coalesce(F.sum(lane), F.lit(0).cast("long")).alias(f"e{k}"))
    if not repeated:
        return triples.groupBy(*keys).agg(*sums).select(*keys, _written().alias("fingerprint"))
    times = F.count(F.when((F.col("p") == 0) & (F.col("i") == 0), 1)).alias("times")
    found = triples.groupBy(*keys).agg(*sums, times)
    once = [F.expr(f"{c} div times").alias(c) for c in found.columns if c not in (*keys, "times")]
    return found.select(*keys, "times", *once).select(*keys, "times", _written().alias("fingerprint"))


def _hex(value: Column, digits: int) -> Column:
    return F.lower(F.lpad(F.hex(value), digits, "0"))


def _written() -> Column:
    n = F.col("n")
    parts = [_hex(n % (1 << 32), 8)]
    parts += [_hex(F.col(f"e{k}") % (1 << 32), 8) for k in range(IDENTITY)]
    for h in range(HASHES):
        for j in range(PAIRS):
            both = F.col(f"s{h}_{j}")
            for count in (both.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(both, APART)):
                parts.append(_hex((2 * count - n).bitwiseAND(F.lit(0xFFFFFFFF)), 8))
    return F.concat(*parts)


def likeness_lanes(fingerprint: Column) -> Column:
    """Array of signed lanes."""
    start = 8 + 8 * IDENTITY
    raw = F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda i: F.conv(fingerprint.substr(F.lit(start + 1) + 8 * i, F.lit(8)), 16, 10).cast("long"))
    return F.transform(raw, lambda v: F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Cosine of two lane arrays, cut to 0 and 1; 1 where `same` holds, 0 if just one is of nothing."""
    size = F.sqrt(_dot(a, a) * _dot(b, b))
    return F.when(same, 1.0).when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(a, b) / size)))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of a's paragraphs with b's inserted (sign 1) or deleted (-1)."""

    def lane(i: Column) -> Column:
        one, other = (F.conv(f.substr(F.lit(1) + 8 * i, F.lit(8)), 16, 10).cast("long") for f in (a, b))
        return F.lower(F.lpad(F.hex(F.pmod(one + sign * other, F.lit(1 << 32))), 8, "0"))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(IDENTITY + LANES)), lane), "")


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, fingerprint.

    Rows are named by their id and the hash of their text, which stay the same when a lost task runs again. The sums of
    rows equal in both are divided by their number.
    """
    rows = intake(docs, id=(id_col, "string"), text=(text_col, "string"))
    rows = rows.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("name", F.sha2("text", 256))
    found = fingerprint_sums(rows, ["id", "name"], repeated=True)
    return found.select("id", "fingerprint", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("col")


def compare_with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of each text, of the text with its second half replaced by the next text's beginning, and both likenesses.

    The texts are exchanged once, to meet their successors; fingerprints are summed in those same partitions.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    placed = with_successors(rows, "id", ["text"], buckets)
    order = Window.partitionBy("bucket").orderBy("at")
    paired = placed.withColumn("next_text", F.coalesce(F.lead("text").over(order), F.lit("")))
    n = F.char_length("text")
    cut = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - cut), F.col("next_text").substr(F.lit(1), cut))
    paired = paired.select("id", "bucket", "at", "guest", "text", n.cast("long").alias("n_chars"), F.when(~F.col("guest"), edited).alias("edited"))
    sides = F.explode(
        F.when(F.col("guest"), F.array(F.struct(F.lit(0).alias("side"), F.col("text")))).otherwise(
            F.array(F.struct(F.lit(0).alias("side"), F.col("text")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))
        )
    ).alias("version")
    versions = paired.select("bucket", "at", "guest", "id", "n_chars", sides).select(
        "bucket", "at", "guest", "id", "n_chars", "version.side", F.col("version.text").alias("text"), F.sha2("version.text", 256).alias("sha256")
    )
    keys = ["bucket", "at", "guest", "id", "n_chars", "side", "sha256"]
    found = fingerprint_sums(versions, keys)
    by_place = Window.partitionBy("bucket").orderBy("at", "side")
    found = found.select(
        *keys,
        "fingerprint",
        F.lead("fingerprint", 1).over(by_place).alias("edited_fingerprint"),
        F.lead("sha256", 1).over(by_place).alias("edited_sha256"),
        F.lead("fingerprint", 2).over(by_place).alias("next_fingerprint"),
    ).where((F.col("side") == 0) & ~F.col("guest"))
    lanes = [likeness_lanes(F.col(c)).alias(f"l{i}") for i, c in enumerate(("fingerprint", "edited_fingerprint", "next_fingerprint"))]
    found = found.select("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint", *lanes)
    return found.select(
        "id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("l0"), F.col("l1"), F.col("fingerprint") == F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("l0"), F.col("l2"), F.col("fingerprint") == F.col("next_fingerprint")).alias("near_next"),
    )


def query(spark, sf_dir):
    from framesift.llm.common import table

    return compare_with_edits(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
