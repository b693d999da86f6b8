"""Calibration, ablations, timings, rounds and inventories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framesift.operators import ranking, scoring, selection
from framesift.plans import register
from framesift.plans.selection import K, _power
from framesift.plans.views import SC, load, scored, sims


def _confidence(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem")
    return rows.select((F.col("l_quantity") / 60.0).alias("prob"), (F.col("l_returnflag") == "N").cast("int").alias("correct"))


@register(
    "cal_bins",
    """WITH c AS (SELECT l_quantity / 60.0::DOUBLE AS prob, (l_returnflag = 'N')::INT AS correct FROM lineitem), b AS (SELECT greatest(1, ceil(round(prob * 10, 9)))::BIGINT AS bin, * FROM c)
SELECT k.bin, count(b.bin)::BIGINT AS n, round(avg(correct), 6) AS accuracy, round(avg(prob), 6) AS mean_prob FROM (SELECT unnest(range(1, 11)) AS bin) k LEFT JOIN b USING (bin) GROUP BY k.bin""",
)
def bins(spark, sf_dir):
    return scoring.confidence_bins(_confidence(spark, sf_dir))


@register("cal_corr", "SELECT count(*)::BIGINT AS n, round(corr(l_quantity / 60.0::DOUBLE, (l_returnflag = 'N')::INT), 6) AS corr FROM lineitem")
def corr(spark, sf_dir):
    return scoring.correlation(_confidence(spark, sf_dir), "prob", "correct")


_SELECTED = f"""{SC}, r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY score DESC, frame_id) AS r, ((pos + 1) * least({K}, n) - 1) // n AS segment FROM sc),
a AS (SELECT 'top' AS config, video, frame_id FROM r WHERE r <= {K}), b AS (SELECT 'segment' AS config, video, frame_id FROM (SELECT *, row_number() OVER (PARTITION BY video, segment ORDER BY score DESC, frame_id) AS s FROM r) WHERE s = 1),
c AS (SELECT DISTINCT 'uniform' AS config, sc.video, sc.frame_id FROM sc JOIN range(0, {K}) t(i) ON (i * n) // {K} = pos), sel AS (FROM a UNION ALL FROM b UNION ALL FROM c)"""


def _selected(spark, sf_dir):
    rows = scored(spark, sf_dir)
    picked = {"top": selection.pick_top, "segment": selection.pick_segment_best, "uniform": selection.pick_uniform}
    found = None
    for name, pick in picked.items():
        one = pick(rows, K).select(F.lit(name).alias("config"), "video", "frame_id")
        found = one if found is None else found.unionByName(one)
    return found


@register(
    "abl_overlap_matrix",
    f"""WITH {_SELECTED}, v AS (SELECT DISTINCT config, video FROM sel), sh AS (SELECT a.config AS config_a, b.config AS config_b, video, count(*) / {K}.0::DOUBLE AS share FROM sel a JOIN sel b USING (video, frame_id) GROUP BY ALL)
SELECT x.config AS config_a, y.config AS config_b, count(*)::BIGINT AS n_samples, round(avg(coalesce(share, 0)), 4) AS mean_overlap FROM v x JOIN v y USING (video) LEFT JOIN sh ON sh.config_a = x.config AND sh.config_b = y.config AND sh.video = x.video GROUP BY ALL""",
)
def matrix(spark, sf_dir):
    return scoring.overlap_matrix(_selected(spark, sf_dir), K)


_SETS = f"""{_SELECTED}, ss AS (SELECT video, list(frame_id) FILTER (config = 'top') AS x, list(frame_id) FILTER (config = 'uniform') AS y FROM sel GROUP BY video),
cmp AS (SELECT video, len(list_intersect(x, y)) AS o, len(list_distinct(list_concat(x, y))) AS u, greatest(len(x), len(y), 1) AS big FROM ss)"""


def _pairs(spark, sf_dir):
    rows = _selected(spark, sf_dir)
    sets = rows.groupBy("video").agg(F.collect_set(F.when(F.col("config") == "top", F.col("frame_id"))).alias("x"), F.collect_set(F.when(F.col("config") == "uniform", F.col("frame_id"))).alias("y"))
    return scoring.compare_sets(sets, "x", "y")


@register("abl_same_frame", f"WITH {_SETS} SELECT video, o::BIGINT AS overlap, u::BIGINT AS union_size, round(100.0 * o / big, 6)::DOUBLE AS same_frame_percent, round(o / u::DOUBLE, 6)::DOUBLE AS jaccard FROM cmp")
def same_frame(spark, sf_dir):
    return _pairs(spark, sf_dir).drop("x", "y", "only_a", "only_b")


@register("abl_summary", f"WITH {_SETS} SELECT count(*)::BIGINT AS n_samples, round(avg(round(100.0 * o / big, 6)), 6)::DOUBLE AS alignment, round(avg(round(o / u::DOUBLE, 6)), 6)::DOUBLE AS mean_jaccard FROM cmp")
def summary(spark, sf_dir):
    return _pairs(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_samples"), F.round(F.avg("same_frame_percent"), 6).alias("alignment"), F.round(F.avg("jaccard"), 6).alias("mean_jaccard"))


@register("abl_common_samples", "WITH r AS (SELECT DISTINCT event_type AS config, user_id::BIGINT AS video FROM events), f AS (SELECT video FROM r GROUP BY video HAVING count(*) = (SELECT count(DISTINCT config) FROM r)) SELECT config, video FROM r SEMI JOIN f USING (video)")
def common(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(F.col("event_type").alias("config"), F.col("user_id").cast("bigint").alias("video")).distinct()
    return scoring.common_samples(rows, config="config", sample="video")


def _alloc(strength: float) -> str:
    return f"SELECT {strength}::DOUBLE AS strength, video, kw_id, weight, (fl + CASE WHEN row_number() OVER (PARTITION BY video ORDER BY fr DESC, kw_id) <= {K} - sum(fl) OVER (PARTITION BY video) THEN 1 ELSE 0 END)::BIGINT AS quota FROM (SELECT *, floor(round(weight * {K}, 9)) AS fl, round(round(weight * {K}, 9) - floor(round(weight * {K}, 9)), 9) AS fr FROM (SELECT video, kw_id, round(CASE WHEN sum(pow(phi, {strength})) OVER w > 1e-12 THEN pow(phi, {strength}) / sum(pow(phi, {strength})) OVER w ELSE 1.0 / count(*) OVER w END, 9)::DOUBLE AS weight FROM phi WINDOW w AS (PARTITION BY video)))"


@register(
    "abl_alloc_by_rank",
    f"WITH {_power(1.0)}, al AS ({' UNION ALL '.join(_alloc(s) for s in (0.0, 1.0, 4.0))}), rk AS (SELECT *, row_number() OVER (PARTITION BY strength, video ORDER BY weight DESC, kw_id) AS kw_rank FROM al) SELECT strength, kw_rank, count(*)::BIGINT AS n, round(avg(quota), 6) AS mean_quota FROM rk GROUP BY ALL",
)
def alloc_by_rank(spark, sf_dir):
    phi = selection.local_evidence(sims(spark, sf_dir))
    found = None
    for strength in (0.0, 1.0, 4.0):
        one = selection.quotas(selection.power_weights(phi, strength), K).withColumn("strength", F.lit(strength))
        found = one if found is None else found.unionByName(one)
    return scoring.allocation_by_rank(found, config=["strength"])


@register("tim_by_task", "SELECT event_type AS task, count(*)::BIGINT AS n, round(avg(value), 6) AS mean_s, round(max(value), 6) AS max_s FROM events GROUP BY 1")
def timing(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("task")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_s"), F.round(F.max("value"), 6).alias("max_s"))


@register("tim_model_diff", "WITH m AS (SELECT l_shipdate::DATE AS d, l_returnflag AS model, l_quantity AS v FROM lineitem), g AS (SELECT year(d)::BIGINT AS task, avg(v) FILTER (model = 'A') AS a, avg(v) FILTER (model = 'N') AS b FROM m WHERE model IN ('A', 'N') GROUP BY 1) SELECT task, round(a, 6) AS mean_a, round(b, 6) AS mean_b, round(b - a, 6) AS delta, CASE WHEN a > 0 THEN round(b / a, 6) ELSE 'Infinity'::DOUBLE END AS ratio FROM (SELECT task, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM g)")
def model_diff(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("bigint").alias("task"), "l_returnflag", "l_quantity")
    return scoring.model_differences(rows, key="task", model="l_returnflag", value="l_quantity", first="A", second="N")


_ROUNDS = "rd AS (SELECT l_orderkey::BIGINT AS sample, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS round_idx, l_returnflag AS answer, l_quantity / 50.0::DOUBLE AS prob FROM lineitem)"


def _rounds(spark, sf_dir):
    """An order's lines as rounds, numbered one after the other."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = load(spark, sf_dir, "lineitem").withColumn("round", F.row_number().over(order).cast("bigint"))
    return rows.select(F.col("l_orderkey").cast("bigint").alias("sample"), F.col("round").alias("round_idx"), F.col("l_returnflag").alias("answer"), (F.col("l_quantity") / 50.0).alias("prob"))


@register(
    "early_stop_round",
    f"""WITH {_ROUNDS}, p AS (SELECT *, coalesce(prob > 0.3 AND lag(prob) OVER w > 0.3 AND lag(answer) OVER w = answer, false) AS on_ FROM rd WINDOW w AS (PARTITION BY sample ORDER BY round_idx)),
i AS (SELECT *, sum(CASE WHEN on_ THEN 0 ELSE 1 END) OVER (PARTITION BY sample ORDER BY round_idx) AS island FROM p),
l AS (SELECT *, sum(CASE WHEN prob > 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY sample, island ORDER BY round_idx) AS len FROM i)
SELECT sample, min(round_idx) FILTER (len >= 2)::BIGINT AS stop_round FROM l GROUP BY sample""",
)
def early_stop(spark, sf_dir):
    return ranking.early_stop(_rounds(spark, sf_dir), sample="sample", order="round_idx", answer="answer", prob="prob", threshold=0.3, streak=2, letters=("A", "N", "R"))


@register("win_carry_forward", f"WITH {_ROUNDS} SELECT sample, round_idx, last_value(CASE WHEN prob > 0.5 THEN answer END IGNORE NULLS) OVER (PARTITION BY sample ORDER BY round_idx ROWS UNBOUNDED PRECEDING) AS kept FROM rd")
def carried(spark, sf_dir):
    rows = _rounds(spark, sf_dir).withColumn("sure", F.when(F.col("prob") > 0.5, F.col("answer")))
    return ranking.carry_forward(rows, "sure", group="sample", order="round_idx", out="kept").select("sample", "round_idx", "kept")


@register("cache_hits", "WITH u AS (SELECT l_suppkey::BIGINT AS sample, l_partkey::BIGINT AS frame_id, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) = 1 AS miss FROM lineitem) SELECT sample, (count(*) FILTER (miss))::BIGINT AS misses, (count(*) FILTER (NOT miss))::BIGINT AS hits FROM u GROUP BY sample")
def cache_hits(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("bigint").alias("sample"), F.col("l_partkey").cast("bigint").alias("frame_id"), F.struct("l_orderkey", "l_linenumber").alias("step"))
    used = ranking.first_use(rows, keys=["sample", "frame_id"], order="step")
    return used.groupBy("sample").agg(F.sum("cache_miss").alias("misses"), F.sum(1 - F.col("cache_miss")).alias("hits"))


@register("bundle_nested", "SELECT o_orderkey::BIGINT AS video, count(*)::BIGINT AS n_questions, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS questions FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def bundles(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    grouped = rows.groupBy(F.col("o_orderkey").cast("bigint").alias("video")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("q"))
    return grouped.select("video", F.size("q").cast("bigint").alias("n_questions"), F.array_join(F.transform("q", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",").alias("questions"))


@register("inventory_stats", "SELECT d.source AS dataset, count(*)::BIGINT AS files, count(DISTINCT d.lang)::BIGINT AS kinds, sum(length(text))::BIGINT AS chars, (count(*) FILTER (l.doc_id IS NULL))::BIGINT AS missing FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def inventory(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("known"))
    rows = docs.select("doc_id", "source", "lang", F.char_length("text").alias("chars")).join(labels, "doc_id", "left")
    return rows.groupBy(F.col("source").alias("dataset")).agg(F.count(F.lit(1)).alias("files"), F.count_distinct("lang").alias("kinds"), F.sum("chars").alias("chars"), F.count_if(F.col("known").isNull()).alias("missing"))


@register("score_stats", f"WITH {SC} SELECT video, count(*)::BIGINT AS n, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score FROM sc GROUP BY video")
def stats(spark, sf_dir):
    return scoring.score_stats(scored(spark, sf_dir), ["video"])
