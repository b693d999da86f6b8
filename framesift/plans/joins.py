"""Join-shaped operators: file indexes, subtitles, caches, grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesift.operators import intervals, lookups
from framesift.plans import register
from framesift.plans.views import MOM, SEG, load, moments, segments


@register(
    "jn_video_index",
    """WITH idx AS (SELECT regexp_replace(regexp_replace(url, '^.*/', ''), '[?#].*$', '') AS stem, min(page_id)::BIGINT AS page_id FROM pages GROUP BY 1)
SELECT d.doc_id::BIGINT AS sample_id, i.page_id FROM documents d JOIN idx i ON i.stem = d.doc_id::VARCHAR""",
)
def video_index(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select(F.col("page_id").cast("bigint").alias("page_id"), F.regexp_replace(F.regexp_replace("url", r"^.*/", ""), r"[?#].*$", "").alias("stem"))
    index = lookups.first_by_key(pages, "stem", "page_id")
    samples = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("sample_id"), F.col("doc_id").cast("string").alias("stem"))
    return samples.join(index, "stem").select("sample_id", "page_id")


@register(
    "jn_first_path",
    """WITH cand AS (SELECT c_custkey::BIGINT AS id, unnest([c_custkey * 7, c_custkey * 5, c_custkey * 3]) AS path, unnest([0, 1, 2]) AS place FROM customer)
SELECT id, arg_min(path, place)::BIGINT AS path FROM cand WHERE path IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY id""",
)
def first_path(spark, sf_dir):
    key = F.col("c_custkey").cast("bigint")
    wanted = load(spark, sf_dir, "customer").select(key.alias("id"), F.array(key * 7, key * 5, key * 3).alias("paths"))
    there = load(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").cast("bigint").alias("path"))
    return lookups.first_existing(wanted, there, key="id", candidates="paths", path="path")


_MATCH = f"WITH {SEG}, hit AS (SELECT m.event_id, m.video, m.at_s, arg_min(s.text, s.seq) AS subtitle FROM mom m LEFT JOIN seg s ON s.video = m.video AND m.at_s >= s.start_s AND m.at_s < s.end_s GROUP BY ALL)"


@register("jn_subtitle_interval", f"{_MATCH} SELECT event_id, video, coalesce(subtitle, '') AS subtitle FROM hit")
def subtitles(spark, sf_dir):
    at = moments(spark, sf_dir).select("event_id", "video", "at_s")
    return intervals.match_segments(at, segments(spark, sf_dir), group="video", at="at_s", slot=21600.0).select("event_id", "video", "subtitle")


@register("jn_subtitle_distinct", f"{_MATCH}, fst AS (SELECT video, subtitle, min(at_s) AS first_at FROM hit WHERE subtitle <> '' GROUP BY ALL) SELECT video, string_agg(subtitle, ' ' ORDER BY first_at, subtitle) AS subtitles FROM fst GROUP BY video")
def subtitles_distinct(spark, sf_dir):
    at = moments(spark, sf_dir).select("event_id", "video", "at_s")
    return intervals.distinct_texts(intervals.match_segments(at, segments(spark, sf_dir), group="video", at="at_s", slot=21600.0), group="video", at="at_s")


@register("jn_cache_anti", "SELECT doc_id::BIGINT AS sample_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def cache_misses(spark, sf_dir):
    wanted = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("sample_id"))
    cached = load(spark, sf_dir, "labels").select(F.col("doc_id").cast("bigint").alias("sample_id"))
    return lookups.missing(wanted, cached, "sample_id")


@register("jn_cache_policy", "SELECT CASE WHEN l.doc_id IS NULL THEN 'miss' WHEN l.toxic = 1 THEN 'empty' ELSE 'hit' END AS state, count(*)::BIGINT AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def cache_policy(spark, sf_dir):
    wanted = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("sample_id"))
    cached = load(spark, sf_dir, "labels").select(F.col("doc_id").cast("bigint").alias("sample_id"), F.when(F.col("toxic") == 0, F.array(F.lit("kw"))).otherwise(F.array().cast("array<string>")).alias("kws"))
    return lookups.cache_state(wanted, cached, "sample_id", "kws").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


_GRID = "SELECT flag, status, number FROM (SELECT DISTINCT l_returnflag AS flag FROM lineitem), (SELECT DISTINCT l_linestatus AS status FROM lineitem), (SELECT DISTINCT l_linenumber::BIGINT AS number FROM lineitem)"


def _configured(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").cast("bigint").alias("number"))


@register("jn_param_grid", _GRID)
def grid(spark, sf_dir):
    return lookups.value_grid(_configured(spark, sf_dir), ["flag", "status", "number"])


@register("abl_missing_configs", f"{_GRID} EXCEPT SELECT l_returnflag, l_linestatus, l_linenumber::BIGINT FROM lineitem")
def missing_configs(spark, sf_dir):
    return lookups.missing_configurations(_configured(spark, sf_dir), ["flag", "status", "number"])


@register("jn_captions_by_index", "SELECT o_orderkey::BIGINT AS id, list_extract(['a', 'b', 'c', 'd'], l_linenumber)  AS caption, l_linenumber::BIGINT AS at FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber BETWEEN 1 AND 4")
def captions(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.col("o_orderkey").cast("bigint").alias("id"), F.col("l_linenumber").cast("bigint").alias("at"), F.array(*map(F.lit, "abcd")).alias("captions"))
    return lookups.pick_by_index(rows, "captions", "at").select("id", F.col("picked").alias("caption"), "at")


@register(
    "jn_verify_counts",
    """WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders), m AS (SELECT c_nationkey AS nation, c_custkey AS k, o.k IS NOT NULL AS there FROM customer LEFT JOIN o ON o.k = c_custkey),
g AS (SELECT nation, CAST(k AS VARCHAR) AS shown, row_number() OVER (PARTITION BY nation ORDER BY CAST(k AS VARCHAR)) AS place FROM m WHERE NOT there)
SELECT m.nation::BIGINT AS nation, count(*) FILTER (there)::BIGINT AS found, count(*) FILTER (NOT there)::BIGINT AS missing,
(SELECT coalesce(string_agg(shown, ',' ORDER BY shown), '') FROM g WHERE g.nation = m.nation AND place <= 5) AS examples FROM m GROUP BY m.nation""",
)
def verify_counts(spark, sf_dir):
    wanted = load(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("bigint").alias("nation"), F.col("c_custkey").alias("k"))
    there = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    found = lookups.verify(wanted, there, ["k"], by=["nation"])
    return found.select("nation", "found", "missing", F.array_join("missing_examples", ",").alias("examples"))
