"""Benchmark decontamination by spaced-seed hashing.

A mask names the places of a window that count; the others may hold any word. Every window of every text and
of every benchmark item is hashed under each mask, hashes are joined, and each hit fixes a diagonal: the item laid
over the text at one offset. There the overlap is verified: words are compared along the diagonal, and it counts if either

- the best stretch, where a match earns 1 and a substitution costs PENALTY, holds at least MIN_MATCHED matching words, or
  COVERAGE of a shorter item's; or
- COVERAGE of the item's words match, wherever the others are.

Words are runs of letters and digits, lower-cased. For the second rule an item is cut into one part more than
it may have substitutions, so one part is whole, and the first words of each part are a seed (SEGMENT): no overlap
of that rule is missed. Parts of a five-word item are too short for that; it is hashed with each one of its words left out. Of fewer
words COVERAGE is all of them, and such an item is one seed. So an item of one common word marks every text that has it:
min_item leaves items out, if a benchmark holds such.

What is broadcast has rows of fixed size, and its count is checked first; more of them are joined by an exchange of both sides.
Windows are made and probed inside generated code, so that without that exchange only places leave a task: seeds carry no
words. Places of a text are voted into diagonals, those go back to their text by its hash, and only what lies along them is compared.

Defined results: null texts and items are empty and match nothing; rows of docs that share an id are reported as
one document; null ids likewise; items that share an id are items of their own, of which the best is reported; an item that
occurs several times in a document is reported once, by its longest (then first) overlap. Empty tables give an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import materialized

#: Fixed masks: 1 counts, 0 is ignored. Both have 8 places that count; every one or two adjacent substitutions leave a hit near.
MASKS = ("111001011011", "110110100111")
SEGMENT = "111"
#: For items of FIVE words: all but one word, and where in the item each is laid.
FIVE = 5
LEFT_OUT = (("1111", (0, 1)), ("10111", (0,)), ("11011", (0,)), ("11101", (0,)))
MIN_ITEM = 1
MIN_MATCHED = 13
COVERAGE = 0.8
PENALTY = 3
#: Rows that may be broadcast: seeds (28 bytes each), texts' diagonals (20 bytes each), words of items (10 bytes each).
BROADCAST_HASHES = 2_000_000
BROADCAST_LAID = 2_000_000
BROADCAST_WORDS = 4_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def seed_hash(marks: Column, at: Column, mask: str, number: int) -> Column:
    """Of the hashes of words (marks), each of which is hashed once however many windows and masks it is in. Null where the window runs over the end."""
    counted = [F.get(marks, at + i) for i, c in enumerate(mask) if c == "1"]
    return F.when(at + len(mask) <= F.size(marks), F.xxhash64(F.lit(number), *counted))


def _covered(n_item: Column) -> Column:
    """Words of an item that are COVERAGE of it."""
    return F.ceil(COVERAGE * n_item)


def _windows(rows: DataFrame, masks: Sequence[str], keep: list[str], number: str | None = None) -> DataFrame:
    """keep, at, hash: every window under every mask; on request the mask's number too."""
    shortest = min(len(m) for m in masks)
    rows = rows.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("marks"))
    last = F.size("marks") - shortest  # guarded inside explode: a filter would split the text a second time
    spread = rows.select(*keep, "marks", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("at"))
    hashes = F.array(*[seed_hash(F.col("marks"), F.col("at"), m, i) for i, m in enumerate(masks)])
    made = F.posexplode(hashes).alias(number, "hash") if number else F.explode(hashes).alias("hash")
    return spread.select(*keep, "at", made)


def _seeds(items: DataFrame, masks: Sequence[str]) -> tuple[list[str], DataFrame]:
    """The masks that these items need, and hash, key, item_at, n_item of each place where one is laid."""
    n, masks, fixed = F.col("n_item"), list(masks), len(masks)
    masks.append(SEGMENT)
    part = F.floor(n / (n - _covered(n) + 1))
    laid = (F.col("mask") < fixed) | ((F.col("mask") == fixed) & (n > FIVE) & (F.col("at") % part == 0))
    short = {r["n_item"] for r in items.where(n <= FIVE).select("n_item").distinct().collect()}  # five numbers at most
    for size in sorted(short):
        for mask, places in LEFT_OUT if size == FIVE else (("1" * size, (0,)),):
            laid |= (n == size) & (F.col("mask") == len(masks)) & F.col("at").isin(*places)
            masks.append(mask)
    made = _windows(items, masks, ["key", "n_item"], number="mask").where(F.col("hash").isNotNull() & laid)
    return masks, made.select("hash", "key", F.col("at").alias("item_at"), "n_item").distinct()


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    masks: Sequence[str] = MASKS,
    min_matched: int = MIN_MATCHED,
    min_item: int = MIN_ITEM,
    broadcast_hashes: int = BROADCAST_HASHES,
    broadcast_laid: int = BROADCAST_LAID,
    broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """doc, item, start (word of the text), n_words, n_matched, item_words: one row for each document and item that overlap."""
    items = benchmark.select(benchmark[item_col].cast("long").alias("item"), words_of(benchmark[item_text_col].cast("string")).alias("words"))
    items = items.where((F.size("words") > 0) & (F.size("words") >= min_item))
    items = materialized(items.select("item", F.xxhash64("item", "words").alias("key"), "words", F.size("words").alias("n_item")).dropDuplicates(["key"]))
    masks, seeds = _seeds(items, masks)
    seeds = materialized(seeds.withColumnRenamed("key", "item_key"))
    if seeds.count() <= broadcast_hashes:
        seeds = F.broadcast(seeds)
    text = docs[text_col].cast("string")
    rows = docs.select(F.xxhash64(text).alias("key"), words_of(text).alias("words"))
    diagonal = (F.col("at") - F.col("item_at")).alias("diagonal")
    hits = _windows(rows, masks, ["key"]).join(seeds, "hash").select("key", "item_key", "n_item", diagonal).distinct()
    laid = materialized(hits.groupBy("key").agg(F.collect_list(F.struct("item_key", "n_item", "diagonal")).alias("laid")))
    if (laid.agg(F.sum(F.size("laid") + 1)).head()[0] or 0) <= broadcast_laid:
        laid = F.broadcast(laid)
    wanted = items.select(F.col("key").alias("item_key"), "item", F.col("words").alias("item_words"))
    if (items.agg(F.sum("n_item")).head()[0] or 0) <= broadcast_words:
        wanted = F.broadcast(wanted)
    rows = docs.select(docs[id_col].cast("long").alias("doc"), F.xxhash64(text).alias("key"), text.alias("text")).join(laid, "key")
    rows = rows.select("doc", words_of(F.col("text")).alias("words"), F.explode("laid").alias("at"))
    skip = F.greatest(-F.col("at.diagonal"), F.lit(0))
    theirs = F.slice("words", F.greatest(F.col("at.diagonal"), F.lit(0)) + 1, F.col("at.n_item") - skip)
    aligned = rows.select("doc", "at.item_key", "at.n_item", "at.diagonal", skip.alias("skip"), theirs.alias("theirs")).join(wanted, "item_key")
    ours = F.slice("item_words", F.col("skip") + 1, F.col("n_item") - F.col("skip"))
    judged = aligned.select("doc", "item", "diagonal", "n_item", _best(ours, F.col("theirs")).alias("best"))
    enough = F.least(F.lit(min_matched), _covered(F.col("n_item")))
    whole = F.struct(F.col("best.first").alias("start"), (F.col("best.last") + 1 - F.col("best.first")).alias("length"), F.col("best.all").alias("matched"))
    stretch = F.struct("best.start", "best.length", "best.matched")
    judged = judged.withColumn("best", F.when(F.col("best.matched") >= enough, stretch).when(F.col("best.all") >= _covered(F.col("n_item")), whole))
    proven = judged.where(F.col("best").isNotNull())
    start = F.greatest(F.col("diagonal"), F.lit(0)) + F.col("best.start")
    proven = proven.select("doc", "item", F.struct(F.col("best.matched").alias("matched"), (-start).alias("before"), F.col("best.length").alias("length"), "n_item").alias("found"))
    best = proven.groupBy("doc", "item").agg(F.max("found").alias("found"))
    return best.select(
        "doc",
        "item",
        (-F.col("found.before")).cast("long").alias("start"),
        F.col("found.length").cast("long").alias("n_words"),
        F.col("found.matched").cast("long").alias("n_matched"),
        F.col("found.n_item").cast("long").alias("item_words"),
    )


def _best(ours: Column, theirs: Column) -> Column:
    """struct(start, length, matched) of the best stretch of two aligned word lists, and all matches: first, last, all."""
    same = F.zip_with(ours, theirs, lambda a, b: F.coalesce(a == b, F.lit(False)))
    zero = F.lit(0)
    state = F.struct(*[zero.alias(n) for n in ("at", "sum", "from", "hit", "best_sum", "start", "length", "matched", "all", "last")], F.lit(-1).alias("first"))

    def step(s: Column, ok: Column) -> Column:
        fresh = s["sum"] <= 0
        gained = F.when(ok, 1).otherwise(-PENALTY)
        total = F.when(fresh, gained).otherwise(s["sum"] + gained)
        begin = F.when(fresh, s["at"]).otherwise(s["from"])
        matched = F.when(fresh, ok.cast("int")).otherwise(s["hit"] + ok.cast("int"))
        better = total > s["best_sum"]
        return F.struct(
            (s["at"] + 1).alias("at"),
            total.alias("sum"),
            begin.alias("from"),
            matched.alias("hit"),
            F.when(better, total).otherwise(s["best_sum"]).alias("best_sum"),
            F.when(better, begin).otherwise(s["start"]).alias("start"),
            F.when(better, s["at"] + 1 - begin).otherwise(s["length"]).alias("length"),
            F.when(better, matched).otherwise(s["matched"]).alias("matched"),
            (s["all"] + ok.cast("int")).alias("all"),
            F.when(ok, s["at"]).otherwise(s["last"]).alias("last"),
            F.when(ok & (s["first"] < 0), s["at"]).otherwise(s["first"]).alias("first"),
        )

    return F.aggregate(same, state, step, lambda s: F.struct(*[s[n].alias(n) for n in ("start", "length", "matched", "first", "last", "all")]))


def query(spark, sf_dir):
    from framesift.llm.common import table

    found = find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("doc", "doc_id").withColumnRenamed("item", "item_id")


#: Matches along a diagonal as a string of 1 and 0: a mask lies on it where its pattern is found.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'), '[^\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, w, len(w) AS n FROM (
  SELECT item_id, regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'), '[^\p{L}\p{N}]+') AS w FROM benchmark) WHERE w[1] <> ''),
need AS (SELECT q, n, ceil(0.8 * n)::BIGINT AS covered, least(13, ceil(0.8 * n))::BIGINT AS enough, floor(n / (n - ceil(0.8 * n) + 1))::BIGINT AS part FROM b),
ours AS (SELECT q, unnest(range(len(w))) AS j, unnest(w) AS word FROM b),
theirs AS (SELECT r, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
diagonals AS (SELECT r, q, i - j AS diagonal FROM theirs JOIN ours USING (word) JOIN need USING (q) GROUP BY r, q, i - j HAVING count(*) >= min(enough)),
laid AS (SELECT r, q, diagonal, unnest(range(b.n)) AS j FROM diagonals JOIN b USING (q)),
marked AS (SELECT l.r, l.q, l.diagonal, l.j, (l.j + l.diagonal >= 0 AND coalesce(d.w[l.j + l.diagonal + 1] = b.w[l.j + 1], false))::INT AS ok FROM laid l JOIN d USING (r) JOIN b USING (q)),
lines AS (SELECT r, q, diagonal, string_agg(ok::VARCHAR, '' ORDER BY j) AS bits FROM marked GROUP BY ALL),
hit AS (SELECT r, q, diagonal FROM lines JOIN need USING (q) WHERE regexp_matches(bits, '111..1.11.11') OR regexp_matches(bits, '11.11.1..111')
  OR (n > 5 AND len(list_filter(range(0, n, part), lambda p: substr(bits, p + 1, 3) = '111')) > 0) OR n <= 5),
sums AS (SELECT m.*, (SUM(CASE WHEN ok = 1 THEN 1 ELSE -3 END) OVER w)::BIGINT AS s, (SUM(ok) OVER w)::BIGINT AS k FROM marked m JOIN hit USING (r, q, diagonal) WINDOW w AS (PARTITION BY r, q, diagonal ORDER BY j)),
lows AS (SELECT *, least(0, coalesce(min(s * 1000000 - j - 1) OVER (PARTITION BY r, q, diagonal ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM sums),
ends AS (SELECT *, ceil(low / 1000000.0)::BIGINT AS base, (ceil(low / 1000000.0) * 1000000 - low)::BIGINT AS first FROM lows),
best AS (SELECT r, q, diagonal, arg_max({'f': first, 'e': j}, (s - base) * 1000000 - j) AS z, max(s - base) AS top, sum(ok)::BIGINT AS every, min(j) FILTER (ok = 1) AS one, max(j) FILTER (ok = 1) AS last FROM ends GROUP BY ALL),
told AS (SELECT b.*, z.f AS f, z.e AS e, (SELECT sum(ok) FROM marked m WHERE m.r = b.r AND m.q = b.q AND m.diagonal = b.diagonal AND m.j BETWEEN z.f AND z.e)::BIGINT AS matched FROM best b),
kept AS (SELECT r, q, n, CASE WHEN matched >= enough THEN diagonal + f ELSE diagonal + one END AS start, CASE WHEN matched >= enough THEN e - f + 1 ELSE last - one + 1 END AS n_words,
  CASE WHEN matched >= enough THEN matched ELSE every END AS n_matched FROM told JOIN need USING (q) WHERE matched >= enough OR every >= covered)
SELECT doc_id, item_id, start::BIGINT AS start, n_words::BIGINT AS n_words, n_matched::BIGINT AS n_matched, n::BIGINT AS item_words FROM (
  SELECT d.doc_id, b.item_id, k.*, row_number() OVER (PARTITION BY d.doc_id, b.item_id ORDER BY n_matched DESC, k.start, n_words DESC, k.n DESC) AS place FROM kept k JOIN d USING (r) JOIN b USING (q)) WHERE place = 1
"""
