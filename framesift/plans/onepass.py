"""Several results from one pass: selections side by side, all filters' accuracies, rasters, the recursive selector's tree, step lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.operators import lookups, resample, scoring, selection
from framesift.plans import register
from framesift.plans.selection import _TIME, _aks_sql
from framesift.plans.views import MRA, NUMERIC, SAMPLES, SC, frames, load, numeric, samples, scored

K, BINS, EDGE = 16, 20, 6
#: Encoders as the components of a vector.
ENCODERS = {"clip": 0, "siglip2": 1, "blip": 2}


def _encoded(spark, sf_dir) -> DataFrame:
    return frames(spark, sf_dir).select("video", "frame_id", "pos", "n", *[F.round(F.get("vec", F.lit(i)), 9).alias(f"score_{name}") for name, i in ENCODERS.items()])


def _encoder_sql(name: str) -> str:
    return f"sc AS (SELECT label::BIGINT AS video, vec_id::BIGINT AS frame_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n, round(embedding[{ENCODERS[name] + 1}]::DOUBLE, 9) AS score FROM embeddings)"


def _method_sql(rule: str, encoder: str | None) -> str:
    own = _encoder_sql(encoder or "clip")
    if rule == "uniform":
        return f"WITH {own} SELECT video, {_TIME}, frame_id FROM sc SEMI JOIN (SELECT DISTINCT video AS v, (i * n) // {K} AS p FROM sc, range(0, {K}) t(i)) u ON u.v = video AND u.p = pos"
    if rule == "top":
        return f"WITH {own}, r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY score DESC, frame_id) AS r FROM sc) SELECT video, {_TIME}, frame_id FROM r WHERE r <= {K}"
    if rule == "segments":
        return _aks_sql(K, 0.8, -100, 5).replace(f"WITH {SC}", f"WITH {own}")
    return f"""WITH {own}, z AS (SELECT *, round(coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0), 12) AS mass FROM sc WINDOW w AS (PARTITION BY video)),
y AS (SELECT *, mass - min(mass) OVER (PARTITION BY video) AS m FROM z),
c AS (SELECT *, round(CASE WHEN sum(m) OVER (PARTITION BY video) > 0 THEN sum(m) OVER (PARTITION BY video ORDER BY pos ROWS UNBOUNDED PRECEDING) / sum(m) OVER (PARTITION BY video) ELSE (pos + 1) / n END, 9) AS cdf FROM y),
p AS (SELECT video, i, least(count(*) FILTER (cdf < round((1.0/{K})::DOUBLE + i * ((1 - 1.0/{K}) - 1.0/{K})::DOUBLE / ({K} - 1), 9)), any_value(n) - 1) AS pos FROM c, range(0, {K}) t(i) GROUP BY video, i)
SELECT video, row_number() OVER (PARTITION BY video ORDER BY pos, i) - 1 AS ord, frame_id FROM p JOIN sc USING (video, pos)"""


@register("sel_methods", " UNION ALL ".join(f"SELECT video, '{name}' AS method, ord, frame_id FROM ({_method_sql(*how)})" for name, how in selection.METHODS.items()))
def methods(spark, sf_dir):
    return selection.select_methods(_encoded(spark, sf_dir), K)


# ---- the recursive selector's tree


def _tree_sql(k: int, t1: float, t2: float, depth: int) -> str:
    levels, nodes = min(depth, k.bit_length() - 1), []
    chain = _aks_sql(k, t1, t2, depth).split("\ne AS")[0]
    last = f"""b{levels} AS (SELECT *, row_number() OVER (PARTITION BY video, f, l ORDER BY z DESC, ap) AS br FROM a{levels}),
c{levels} AS (SELECT *, true AS d FROM b{levels})"""
    for i in range(levels + 1):
        parent = "NULL::BIGINT AS parent_first, NULL::BIGINT AS parent_last" if i == 0 else "any_value(p.f)::BIGINT AS parent_first, any_value(p.l)::BIGINT AS parent_last"
        join = "" if i == 0 else f" JOIN c{i - 1} p ON p.video = x.video AND p.frame_id = x.frame_id"
        nodes.append(
            f"""SELECT x.video, x.depth::BIGINT AS depth, x.f::BIGINT AS first, x.l::BIGINT AS last, {parent}, round(avg(x.z), 6) AS mean, round(avg(x.z) FILTER (x.br <= {k}), 6) AS top, round(stddev_pop(x.z), 6) AS deviation, any_value(x.d) AS done
FROM c{i} x{join} WHERE NOT x.done AND x.m >= {k} GROUP BY x.video, x.depth, x.f, x.l"""
        )
    return f"{chain.rstrip().rstrip(',')},\n{last}\n" + " UNION ALL ".join(nodes)


@register("sel_aks_tree", _tree_sql(K, 0.3, 0.05, 5))
def tree(spark, sf_dir):
    found = selection.segment_tree(scored(spark, sf_dir), K, t1=0.3, t2=0.05)
    return found.select("video", F.col("depth").cast("bigint").alias("depth"), "first", "last", "parent_first", "parent_last", *[F.round(c, 6).alias(c) for c in ("mean", "top", "deviation")], "done")


@register("sel_aks_depths", f"SELECT video, depth, count(*)::BIGINT AS n FROM ({_tree_sql(K, 0.3, 0.05, 5)}) WHERE done GROUP BY video, depth")
def depths(spark, sf_dir):
    return selection.depth_histogram(selection.segment_tree(scored(spark, sf_dir), K, t1=0.3, t2=0.05)).select("video", F.col("depth").cast("bigint").alias("depth"), "n")


# ---- accuracies and overlaps


def _judged(spark, sf_dir) -> DataFrame:
    """Choices of the labelled documents and numbers of the lines, with options and task."""
    choices = samples(spark, sf_dir).where("options IS NOT NULL").select("options", "task_type", F.lit(None).cast("double").alias("truth_number"), F.lit(None).cast("double").alias("number"), F.lit(True).alias("is_mcq"), "truth", "answer")
    lines = numeric(spark, sf_dir).select(F.lit(None).cast("array<string>").alias("options"), F.col("task").alias("task_type"), "truth_number", "number", "is_mcq", "truth", "answer")
    return choices.unionByName(lines)


@register(
    "agg_accuracy_filters",
    f"""WITH {SAMPLES}, {NUMERIC}, j AS (
  SELECT task_type, true AS mc, (truth = answer)::INT AS ok, NULL::DOUBLE AS mra, 0 AS counted FROM samples WHERE is_mcq UNION ALL
  SELECT task, false, 0, {MRA}, (p IS NOT NULL)::INT FROM numbers
),
w AS (SELECT *, unnest(list_concat(CASE WHEN mc THEN ['all', 'mcq'] ELSE ['all', 'generation', 'numeric'] END, CASE WHEN task_type IS NULL THEN [] ELSE [task_type] END)) AS wanted FROM j),
t AS (SELECT wanted, sum(ok)::BIGINT AS correct, (count(*) FILTER (mc))::BIGINT AS n_mcq, coalesce(sum(mra), 0) AS mra_sum, sum(counted)::BIGINT AS n_numeric FROM w GROUP BY wanted)
SELECT wanted, correct, n_mcq, round(mra_sum, 4) AS mra_sum, n_numeric, round(CASE wanted WHEN 'generation' THEN 0 WHEN 'numeric' THEN coalesce(100.0 * mra_sum / nullif(n_numeric, 0), 0)
  WHEN 'all' THEN coalesce(100.0 * (correct + mra_sum) / nullif(n_mcq + n_numeric, 0), 0) ELSE coalesce(100.0 * correct / nullif(n_mcq, 0), 0) END, 6)::DOUBLE AS accuracy FROM t""",
)
def accuracy_by_filter(spark, sf_dir):
    return scoring.accuracies(_judged(spark, sf_dir)).withColumn("mra_sum", F.round("mra_sum", 4))


_GRID = (8, 16)


def _grid_sql(k: int) -> str:
    return f"""SELECT {k}::BIGINT AS budget, video, 100.0 * count(*) FILTER (a AND b) / greatest(count(*) FILTER (a), count(*) FILTER (b), 1) AS same, count(*) FILTER (a AND b) / greatest(count(*) FILTER (a OR b), 1) AS jac,
  bool_or(a AND r <= 3)::INT AS ca, bool_or(b AND r <= 3)::INT AS cb
  FROM (SELECT video, r, coalesce(pos IN (SELECT (i * n) // {k} FROM range({k}) t(i)), false) AS a, r <= {k} AS b FROM r) GROUP BY video"""


@register(
    "abl_grid_summary",
    f"""WITH {SC}, r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY score DESC, frame_id) AS r FROM sc), g AS ({' UNION ALL '.join(map(_grid_sql, _GRID))})
SELECT budget, count(*)::BIGINT AS num_samples, round(avg(round(same, 6)), 6)::DOUBLE AS topk_alignment_percent, round(avg(round(jac, 6)), 6)::DOUBLE AS avg_jaccard, round(100.0 * sum(ca) / count(*), 6)::DOUBLE AS coverage_accuracy_percent,
  round(100.0 * sum(cb) / count(*), 6)::DOUBLE AS topk_accuracy_percent, sum(ca)::BIGINT AS coverage_correct, sum(cb)::BIGINT AS topk_correct FROM g GROUP BY budget""",
)
def grid_summary(spark, sf_dir):
    """Even and best frames for each budget of a grid; an answer is right where one of the three best frames is among the selected."""
    rows = scored(spark, sf_dir).withColumn("score_clip", F.col("score"))
    best = selection.pick_top(rows, 3).select("video", F.col("frame_id").alias("key"))
    keys = best.groupBy("video").agg(F.collect_set("key").alias("keys"))
    found = None
    for budget in _GRID:
        both = selection.select_methods(rows, budget, {"coverage": ("uniform", None), "topk": ("top", "clip")})
        sets = both.groupBy("video").agg(*[F.collect_set(F.when(F.col("method") == m, F.col("frame_id"))).alias(m) for m in ("coverage", "topk")]).join(keys, "video")
        one = scoring.compare_sets(sets, "coverage", "topk").select(F.lit(budget).cast("bigint").alias("budget"), "same_frame_percent", "jaccard", *[F.arrays_overlap(m, "keys").cast("int").alias(f"{m}_correct") for m in ("coverage", "topk")])
        found = one if found is None else found.unionByName(one)
    return scoring.ablation_summary(found, ["budget"])


#: Selections by a least score beside the even one; high bars give nothing for most videos.
BARS = (0.1, 0.2, 0.9)
_BARRED = f"""{SC}, sel AS (SELECT DISTINCT 'uniform' AS config, video, frame_id, pos, n FROM sc JOIN range(0, {K}) t(i) ON (i * n) // {K} = pos UNION ALL {' UNION ALL '.join(f"SELECT 'over_{b}', video, frame_id, pos, n FROM sc WHERE score > {b}" for b in BARS)}),
sp AS (SELECT c.config, v.video FROM (VALUES ('uniform'), {', '.join(f"('over_{b}')" for b in BARS)}) c(config), (SELECT DISTINCT video FROM sc) v)"""


def _barred(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(config, video, frame_id, pos, n_frames of the selections; config, video of all pairs)"""
    rows = scored(spark, sf_dir)
    i = F.expr(f"(pos * {K} + n - 1) div n")
    even = F.when((i < K) & (F.floor(i * F.col("n") / K) == F.col("pos")), F.lit("uniform"))
    configs = F.array_compact(F.array(even, *[F.when(F.col("score") > b, F.lit(f"over_{b}")) for b in BARS]))
    chosen = rows.select(F.explode(configs).alias("config"), "video", "frame_id", "pos", F.col("n").alias("n_frames"))
    every = F.array(F.lit("uniform"), *[F.lit(f"over_{b}") for b in BARS])
    return chosen, rows.select("video").distinct().select(F.explode(every).alias("config"), "video")


@register(
    "abl_overlap_spine",
    f"""WITH {_BARRED}, sh AS (SELECT a.config AS config_a, b.config AS config_b, video, count(*) / {K}.0::DOUBLE AS share FROM sel a JOIN sel b USING (video, frame_id) GROUP BY ALL), has AS (SELECT DISTINCT config, video FROM sel)
SELECT x.config AS config_a, y.config AS config_b, count(*)::BIGINT AS n_samples, round(avg(CASE WHEN hx.config IS NULL AND hy.config IS NULL THEN 1.0 ELSE coalesce(share, 0) END), 4)::DOUBLE AS mean_overlap
FROM sp x JOIN sp y USING (video) LEFT JOIN has hx ON hx.config = x.config AND hx.video = x.video LEFT JOIN has hy ON hy.config = y.config AND hy.video = x.video
LEFT JOIN sh ON sh.config_a = x.config AND sh.config_b = y.config AND sh.video = x.video GROUP BY ALL""",
)
def overlap_spine(spark, sf_dir):
    chosen, spine = _barred(spark, sf_dir)
    return scoring.overlap_matrix(chosen, K, spine=spine)


# ---- rasters and steps


_RASTER = f"""{_BARRED}, hit AS (SELECT DISTINCT config, video, round_even(coalesce(pos / nullif(n - 1, 0)::DOUBLE, 0) * {BINS - 1}, 0)::BIGINT AS bin FROM sel),
cells AS (SELECT g.config, g.video, b.bin, (h.bin IS NOT NULL)::INT AS bit FROM sp g CROSS JOIN range(0, {BINS}) b(bin) LEFT JOIN hit h ON h.config = g.config AND h.video = g.video AND h.bin = b.bin)"""


def _rasters(spark, sf_dir) -> DataFrame:
    chosen, spine = _barred(spark, sf_dir)
    return resample.rasters(chosen, spine, BINS, keys=["config", "video"])


@register("raster_rows", f"WITH {_RASTER} SELECT config, video, sum(bit)::BIGINT AS filled, string_agg(bit::VARCHAR, '' ORDER BY bin) AS row FROM cells GROUP BY config, video")
def raster_rows(spark, sf_dir):
    return _rasters(spark, sf_dir).select("config", "video", "filled", F.array_join(resample.dense(F.col("bits"), BINS).cast("array<string>"), "").alias("row"))


@register("raster_density", f"WITH {_RASTER} SELECT config, bin, round(avg(bit), 6)::DOUBLE AS density FROM cells GROUP BY config, bin")
def raster_density(spark, sf_dir):
    return resample.bin_densities(_rasters(spark, sf_dir), BINS, by=["config"])


@register(
    "step_edges",
    f"""WITH steps AS (SELECT l_returnflag AS model, l_quantity AS budget, min(l_partkey % 1000)::BIGINT AS edge FROM lineitem WHERE l_linenumber = {EDGE} GROUP BY ALL),
given AS (SELECT o_orderkey::BIGINT AS sample, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AS model, floor((8192 - 512) / greatest(1, o_custkey % 400))::BIGINT AS tokens FROM orders)
SELECT sample, g.model, tokens, coalesce(s.edge, l.edge) AS edge FROM given g ASOF LEFT JOIN steps s ON s.model = g.model AND g.tokens >= s.budget LEFT JOIN (SELECT model, arg_min(edge, budget) AS edge FROM steps GROUP BY model) l ON l.model = g.model""",
)
def edges(spark, sf_dir):
    """The edge of the greatest token budget that a count of frames leaves room for, by model; the smallest one where none fits."""
    steps = load(spark, sf_dir, "lineitem").where(F.col("l_linenumber") == EDGE).select(F.col("l_returnflag").alias("model"), F.col("l_quantity").alias("budget"), (F.col("l_partkey") % 1000).cast("bigint").alias("edge"))
    model = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "N").otherwise("R")
    tokens = resample.tokens_per_frame(F.col("o_custkey") % 400, context=8192, reserve=512)
    values = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("sample"), model.alias("model"), tokens.alias("tokens"))
    return lookups.step_lookup(values, steps, by=["model"], value="tokens", step="budget", out="edge")
