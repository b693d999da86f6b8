r"""Merkle manifest of a table: a tree of hashes for each group, and one over the groups' roots.

A leaf is the hash of a row's fields. A group's leaves, in order, are cut into blocks of FANOUT^STEPS; a block is one
ordered array, and its levels collapse inside it by sequence, transform, slice and aggregate, without an exchange. The
blocks' roots are the leaves of the next round, which has FANOUT^STEPS times fewer rows. The same routine makes the tree over the groups.

Proofs go the other way: a node's path is a list of levels, each the hashes left of it in its run of FANOUT and those right of it.
A block's root gets its path once, and its leaves add their own part of it. folded() walks a path from any leaf to the root.

Places are counted without a global window: rows are sorted by ranges of (group, order) and stored, and only counts by range and
group, a row for each, are summed. A group of any size is spread over ranges and blocks.

H(x) is the lowercase hex SHA-256 of the UTF-8 inputs one after the other. A field is `-` if null, else its count of UTF-8 bytes, `:` and its
value. The last run of a level may be shorter, even one node; it is hashed too. A lone leaf is its group's root itself.

Defined results: null groups are a group of their own, the first; null ids sort first; rows that repeat an id are leaves of their own,
in the order of their hashes; equal leaves stand side by side. An empty table gives an empty result.
Extra columns are ignored, and no name of theirs can clash, as rows are taken in by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm.common import LOWER, UPPER, table, work_path

FANOUT = 8
#: Levels that one block collapses: 8^3 leaves in an array of 512 hashes, 32 KB.
STEPS = 3
#: Tampering for the check: rows whose id's CRC-32 is divisible by this have their text's A-Z lower-cased.
TAMPERED = 3


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _range(first: Column, last: Column) -> Column:
    """first..last; empty where last is below first (sequence() would count down)."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _joined(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with pos (place in the group, from 0) and n (size of the group). group has no nulls; order sorts nulls first.

    Rows are stored once in the shared folder, sorted by ranges, each with its place in its range; what is joined
    to them is a count for each range and group.
    """
    spark = rows.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    path = work_path(spark, "ranked")
    # monotonically_increasing_id: the range's number and the place in it, taken after the sort.
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33)).write.parquet(path)
    ranked = spark.read.parquet(path)
    counts = ranked.groupBy(group, "part").agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("n_part"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "part", "least", F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("base"), F.sum("n_part").over(Window.partitionBy(group)).alias("n"))
    placed = ranked.join(counts, [group, "part"])
    return placed.withColumn("pos", F.col("place") - F.col("least") + F.col("base")).drop("place", "part", "least", "base")


def _runs(level: Column, fanout: int) -> Column:
    """A level's nodes as an array of runs of fanout."""
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(level) / fanout).cast("int") - 1), lambda r: F.slice(level, r * fanout + 1, fanout))


def _levels(leaves: Column, steps: Column, fanout: int) -> Column:
    """Array of levels, each an array of runs of nodes: the leaves first, the hashes of a level's runs next."""

    def collapse(levels: Column, _: Column) -> Column:
        return F.concat(levels, F.array(_runs(F.transform(F.element_at(levels, -1), lambda run: F.sha2(_joined(run), 256)), fanout)))

    return F.aggregate(_range(F.lit(1), steps), F.array(_runs(leaves, fanout)), collapse)


def _siblings(levels: Column, at: Column, steps: Column, fanout: int) -> Column:
    """Path of leaf `at` inside its block: for each level the hashes of its run left and right of it."""

    def level(k: Column) -> Column:
        own = F.floor(at / F.pow(F.lit(float(fanout)), k)).cast("int")
        run, inside = F.get(F.get(levels, k), F.floor(own / fanout).cast("int")), own % fanout
        return F.struct(_joined(F.slice(run, F.lit(1), inside)).alias("l"), _joined(F.slice(run, inside + 2, F.lit(fanout))).alias("r"))

    return F.transform(_range(F.lit(0), steps - 1), level)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


def proof(path: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return F.sha2(_joined(F.transform(path, lambda s: F.concat(s["l"], s["r"]))), 256)


def climb(leaves: DataFrame, *, fanout: int = FANOUT, steps: int = STEPS) -> list[DataFrame]:
    """The rounds of blocks of a tree for each group, all stored; the last has one block a group, whose levels end in its root.

    leaves: group (no nulls), pos, n, h, carried (any struct). A round: group, block, here (levels that it collapses), depth (those left), own, levels.
    """
    spark, block = leaves.sparkSession, fanout**steps
    # Levels that a group of n leaves has: one for each power of fanout below n.
    depth = sum(((F.col("n") > F.lit(fanout**k)).cast("int") for k in range(1, 62 // (fanout.bit_length() - 1))), (F.col("n") > 1).cast("int"))
    below = leaves.select("group", "pos", "h", "carried", depth.alias("depth"))
    stored: list[DataFrame] = []
    while True:
        here = F.least(F.lit(steps), F.col("depth"))
        packed = below.groupBy("group", F.floor(F.col("pos") / block).alias("block"), "depth").agg(F.sort_array(F.collect_list(F.struct("pos", "h", "carried"))).alias("own"))
        packed = packed.select("group", "block", here.alias("here"), (F.col("depth") - here).alias("depth"), "own", _levels(F.col("own.h"), here, fanout).alias("levels"))
        path = work_path(spark, "levels")
        packed.write.parquet(path)
        stored.append(spark.read.parquet(path))
        if not stored[-1].where("depth > 0").limit(1).count():
            return stored
        below = stored[-1].select("group", F.col("block").alias("pos"), _top().alias("h"), F.lit(None).cast("int").alias("carried"), "depth")


def _top() -> Column:
    """A block's root: the only node of its last level."""
    return F.get(F.get(F.element_at("levels", -1), F.lit(0)), F.lit(0))


def descend(stored: list[DataFrame], above: DataFrame | None = None, fanout: int = FANOUT) -> DataFrame:
    """group, root, top, h, carried, up (path from the leaf to top): a row for each leaf. above: group, top, up, which go on over the roots."""
    opened = stored[-1].withColumn("root", _top())
    if above is None:
        opened = opened.withColumn("top", F.col("root")).withColumn("up", F.array().cast("array<struct<l:string,r:string>>"))
    else:
        opened = opened.join(above, "group")  # a row for each group; Spark broadcasts it where it is small
    for blocks in [*reversed(stored[:-1]), None]:
        places = F.sequence(F.lit(0), F.size("own") - 1)
        leaves = F.transform(places, lambda i: F.struct(F.get("own", i).alias("leaf"), _siblings(F.col("levels"), i, F.col("here"), fanout).alias("path")))
        opened = opened.select("group", "root", "top", "up", F.explode(leaves).alias("x"))
        opened = opened.select("group", "root", "top", "x.leaf.*", F.concat("x.path", "up").alias("up"))
        if blocks is not None:
            opened = blocks.join(opened.select("group", F.col("pos").alias("block"), "root", "top", "up"), ["group", "block"])
    return opened.drop("pos")


def manifest(rows: DataFrame, *, fanout: int = FANOUT, steps: int = STEPS) -> DataFrame:
    """rows: group (null allowed), id, leaf, carried -> group, id, leaf, carried, subroot, root, path (to the root of all).

    The rows are stored first, without the texts that their leaves were hashed from: ranges are sampled from them, and sorted.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("group")), F.lit(""))  # null first, the others by their bytes
    rows = rows.select(key.alias("group"), "id", F.col("leaf").alias("h"), "carried")
    path = work_path(rows.sparkSession, "leaves")
    rows.write.parquet(path)
    rows = rows.sparkSession.read.parquet(path)
    placed = numbered(rows, "group", ["id", "h"]).select("group", "pos", "n", "h", F.struct("id", "carried").alias("carried"))
    stored = climb(placed, fanout=fanout, steps=steps)
    roots = numbered(stored[-1].select(F.lit("").alias("all"), "group", _top().alias("h")), "all", ["group"])
    over = climb(roots.select(F.col("all").alias("group"), "pos", "n", "h", F.struct("group").alias("carried")), fanout=fanout, steps=steps)
    over = descend(over, fanout=fanout).select("carried.group", "top", "up")
    return descend(stored, over, fanout=fanout).select(
        F.when(F.col("group") != "", F.substring("group", 2, 1 << 30)).alias("group"),
        "carried.id",
        F.col("h").alias("leaf"),
        "carried.carried",
        F.col("root").alias("subroot"),
        F.col("top").alias("root"),
        F.col("up").alias("path"),
    )


def audit(docs: DataFrame, *, fanout: int = FANOUT, steps: int = STEPS) -> DataFrame:
    """The manifest of documents, and for each one the root that its leaf gives after tampering, along the untampered path."""
    text = docs["text"].cast("string")
    id_ = docs["doc_id"].cast("long")
    hit = F.coalesce(F.crc32(id_.cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))
    fields = [docs["source"].cast("string"), docs["lang"].cast("string"), docs["n_chars"].cast("long")]
    changed = F.when(hit, leaf_hash(id_, *fields, F.translate(text, UPPER, LOWER)))
    rows = docs.select(fields[1].alias("group"), id_.alias("id"), leaf_hash(id_, *fields, text).alias("leaf"), changed.alias("carried"))
    found = manifest(rows, fanout=fanout, steps=steps)
    found = found.select("id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.coalesce("carried", "leaf"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::varchar) || ':' || {value}::varchar, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Levels as a recursion; each leaf's path is every level's run without its own node.
ORACLE = f"""
WITH RECURSIVE crc AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(doc_id::varchar, '')]),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::BIGINT[]), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295::BIGINT) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents)
),
leaves AS (
  SELECT doc_id, lang, {_leaf_sql('text')} AS leaf,
    CASE WHEN crc % {TAMPERED} = 0 THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {_leaf_sql('text')} END AS used,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos
  FROM documents JOIN crc USING (doc_id)
),
inner_nodes AS (
  SELECT lang, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // {FANOUT}, sha256(string_agg(h, '' ORDER BY pos)), ceil(any_value(n) / {FANOUT})::BIGINT
  FROM inner_nodes WHERE n > 1 GROUP BY lang, level, pos // {FANOUT}
),
subroots AS (SELECT lang, h AS subroot, level AS depth, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM inner_nodes WHERE n = 1),
outer_nodes AS (
  SELECT 0 AS level, pos, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // {FANOUT}, sha256(string_agg(h, '' ORDER BY pos)), ceil(any_value(n) / {FANOUT})::BIGINT
  FROM outer_nodes WHERE n > 1 GROUP BY level, pos // {FANOUT}
),
sides AS (
  SELECT l.doc_id, i.level, coalesce(string_agg(i.h, '' ORDER BY i.pos) FILTER (i.pos < l.pos // pow({FANOUT}, i.level)::BIGINT), '') AS lefts,
    coalesce(string_agg(i.h, '' ORDER BY i.pos) FILTER (i.pos > l.pos // pow({FANOUT}, i.level)::BIGINT), '') AS rights
  FROM leaves l JOIN inner_nodes i ON i.lang IS NOT DISTINCT FROM l.lang AND i.n > 1 AND i.pos // {FANOUT} = l.pos // pow({FANOUT}, i.level + 1)::BIGINT
  GROUP BY ALL
  UNION ALL
  SELECT l.doc_id, s.depth + o.level, coalesce(string_agg(o.h, '' ORDER BY o.pos) FILTER (o.pos < s.pos // pow({FANOUT}, o.level)::BIGINT), ''),
    coalesce(string_agg(o.h, '' ORDER BY o.pos) FILTER (o.pos > s.pos // pow({FANOUT}, o.level)::BIGINT), '')
  FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN outer_nodes o ON o.n > 1 AND o.pos // {FANOUT} = s.pos // pow({FANOUT}, o.level + 1)::BIGINT
  GROUP BY ALL
),
paths AS (SELECT doc_id, list({{'l': lefts, 'r': rights}} ORDER BY level) AS path, sha256(string_agg(lefts || rights, '' ORDER BY level)) AS proof FROM sides GROUP BY doc_id),
folds AS (
  SELECT doc_id, 1 AS i, used AS h, path FROM leaves LEFT JOIN paths USING (doc_id)
  UNION ALL
  SELECT doc_id, i + 1, sha256(path[i].l || h || path[i].r), path FROM folds WHERE i <= len(path)
)
SELECT l.doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN (SELECT h AS root FROM outer_nodes WHERE n = 1)
LEFT JOIN paths USING (doc_id) JOIN folds f ON f.doc_id = l.doc_id AND f.i = coalesce(len(f.path), 0) + 1
"""
