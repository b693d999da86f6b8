"""Similarity, ranks and budgeted selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesift.operators import ranking, resample, selection
from framesift.plans import register
from framesift.plans.views import FR, KW, SC, SIMS, frames, keywords, scored, sims

K = 16


@register("sim_matrix", f"WITH {SIMS} SELECT video, kw_id, frame_id, round(sim, 6) AS sim FROM sims")
def matrix(spark, sf_dir):
    return sims(spark, sf_dir).select("video", "kw_id", "frame_id", F.round("sim", 6).alias("sim"))


@register("sim_adjacent", f"WITH {FR} SELECT video, pos, round(round(list_dot_product(vec, before), 9), 6) AS cos_sim FROM (SELECT *, lag(vec) OVER (PARTITION BY video ORDER BY pos) AS before FROM fr) WHERE pos > 0")
def adjacent(spark, sf_dir):
    return ranking.adjacent_similarity(frames(spark, sf_dir)).select("video", "pos", F.round("cos_sim", 6).alias("cos_sim"))


_SELF = f"{KW}, selfsim AS (SELECT a.video, a.kw_id, max(round(list_dot_product(a.vec, b.vec), 9)) AS max_sim FROM kw a JOIN kw b ON a.video = b.video AND a.kw_id <> b.kw_id GROUP BY ALL)"


@register("sim_keyword_self_max", f"WITH {_SELF} SELECT video, kw_id, round(max_sim, 6) AS max_sim FROM selfsim")
def self_max(spark, sf_dir):
    return selection.keyword_self_similarity(keywords(spark, sf_dir)).select("video", "kw_id", F.round("max_sim", 6).alias("max_sim"))


@register("rank_frames", f"WITH {SC} SELECT video, frame_id, row_number() OVER (PARTITION BY video ORDER BY score DESC, frame_id) AS rank FROM sc")
def ranks(spark, sf_dir):
    return ranking.rank_frames(scored(spark, sf_dir)).select("video", "frame_id", "rank")


@register("win_softmax", f"WITH {SC}, m AS (SELECT *, score / 0.8::DOUBLE AS x, max(score / 0.8::DOUBLE) OVER (PARTITION BY video) AS top FROM sc) SELECT video, frame_id, round(x - top - ln(sum(exp(x - top)) OVER (PARTITION BY video)), 6) AS log_prob FROM m")
def softmax(spark, sf_dir):
    return ranking.log_softmax(scored(spark, sf_dir), temperature=0.8).select("video", "frame_id", F.round("log_prob", 6).alias("log_prob"))


@register("win_minmax", f"WITH {SC} SELECT video, frame_id, round(coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0), 6) AS scaled FROM sc WINDOW w AS (PARTITION BY video)")
def minmax(spark, sf_dir):
    return ranking.min_max(scored(spark, sf_dir)).select("video", "frame_id", F.round("scaled", 6).alias("scaled"))


@register("win_cdf", f"WITH {SC}, m AS (SELECT *, score - min(score) OVER (PARTITION BY video) AS mass FROM sc) SELECT video, frame_id, round(CASE WHEN sum(mass) OVER w > 0 THEN sum(mass) OVER (PARTITION BY video ORDER BY pos ROWS UNBOUNDED PRECEDING) / sum(mass) OVER w ELSE (pos + 1) / n END, 6) AS cdf FROM m WINDOW w AS (PARTITION BY video)")
def cdf(spark, sf_dir):
    return ranking.cumulative_share(scored(spark, sf_dir)).select("video", "frame_id", F.round("cdf", 6).alias("cdf"))


_TIME = "row_number() OVER (PARTITION BY video ORDER BY frame_id) - 1 AS ord"


@register("sel_uniform", f"WITH {SC} SELECT video, {_TIME}, frame_id FROM sc SEMI JOIN (SELECT DISTINCT video AS v, (i * n) // {K} AS p FROM sc, range(0, {K}) t(i)) u ON u.v = video AND u.p = pos")
def uniform(spark, sf_dir):
    return selection.pick_uniform(scored(spark, sf_dir), K)


@register("sel_random", f"WITH {SC}, r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY md5('11-' || video || '-' || frame_id)) AS r FROM sc) SELECT video, {_TIME}, frame_id FROM r WHERE r <= {K}")
def random(spark, sf_dir):
    return selection.pick_random(scored(spark, sf_dir), K, 11)


_TOP = f"r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY score DESC, frame_id) AS r FROM sc)"


@register("sel_clip_topk", f"WITH {SC}, {_TOP} SELECT video, {_TIME}, frame_id FROM r WHERE r <= {K}")
def topk(spark, sf_dir):
    return selection.select_frames(scored(spark, sf_dir), "clip-new", K)


@register("sel_segment_argmax", f"WITH {SC}, s AS (SELECT *, ((pos + 1) * least({K}, n) - 1) // n AS segment FROM sc), r AS (SELECT *, row_number() OVER (PARTITION BY video, segment ORDER BY score DESC, frame_id) AS r FROM s) SELECT video, {_TIME}, frame_id FROM r WHERE r = 1")
def segment_best(spark, sf_dir):
    return selection.select_frames(scored(spark, sf_dir), "clip", K)


@register(
    "sel_bolt",
    f"""WITH {SC}, z AS (SELECT *, round(pow(coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0), 2.0), 12) AS mass FROM sc WINDOW w AS (PARTITION BY video)),
y AS (SELECT *, mass - min(mass) OVER (PARTITION BY video) AS m FROM z),
c AS (SELECT *, round(CASE WHEN sum(m) OVER (PARTITION BY video) > 0 THEN sum(m) OVER (PARTITION BY video ORDER BY pos ROWS UNBOUNDED PRECEDING) / sum(m) OVER (PARTITION BY video) ELSE (pos + 1) / n END, 9) AS cdf FROM y),
p AS (SELECT video, i, least(count(*) FILTER (cdf < round((1.0/{K})::DOUBLE + i * ((1 - 1.0/{K}) - 1.0/{K})::DOUBLE / ({K} - 1), 9)), any_value(n) - 1) AS pos FROM c, range(0, {K}) t(i) GROUP BY video, i)
SELECT video, row_number() OVER (PARTITION BY video ORDER BY pos, i) - 1 AS ord, frame_id FROM p JOIN sc USING (video, pos)""",
)
def bolt(spark, sf_dir):
    return selection.pick_inverse_transform(scored(spark, sf_dir), K, power=2.0)


def _aks_sql(k: int, t1: float, t2: float, depth: int) -> str:
    ctes, last = [], "a0"
    for level in range(min(depth, k.bit_length() - 1)):
        ctes.append(
            f"""b{level} AS (SELECT *, row_number() OVER (PARTITION BY video, f, l ORDER BY z DESC, ap) AS br FROM {last}),
c{level} AS (SELECT *, done OR l - f < 2 OR (round(avg(z) FILTER (br <= {k}) OVER s - avg(z) OVER s, 9) > {t1} AND round(stddev_pop(z) OVER s, 9) > {t2}) AS d FROM b{level} WINDOW s AS (PARTITION BY video, f, l)),
a{level + 1} AS (SELECT video, frame_id, ap, m, z, CASE WHEN d OR ap < f + (l - f) // 2 THEN f ELSE f + (l - f) // 2 END AS f, CASE WHEN d OR ap >= f + (l - f) // 2 THEN l ELSE f + (l - f) // 2 END AS l, CASE WHEN d THEN depth ELSE depth + 1 END AS depth, d AS done FROM c{level})"""
        )
        last = f"a{level + 1}"
    chain = ",\n".join(ctes)
    return f"""WITH {SC}, a0 AS (SELECT video, frame_id, pos AS ap, n AS m, round(coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0), 9) AS z, 0::BIGINT AS f, n AS l, 0 AS depth, false AS done FROM sc WINDOW w AS (PARTITION BY video)),
{chain},
e AS (SELECT *, row_number() OVER (PARTITION BY video, f, l ORDER BY z DESC, ap) AS r FROM {last}),
g AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame_id) AS o FROM e WHERE m <= {k} OR r <= floor({k} / pow(2.0, depth)))
SELECT video, {_TIME}, frame_id FROM g WHERE o <= {k}"""


@register("sel_aks", _aks_sql(K, 0.3, 0.05, 5))
def aks(spark, sf_dir):
    return selection.pick_recursive_segments(scored(spark, sf_dir), K, t1=0.3, t2=0.05)


@register("sel_aks_not_power_of_two", _aks_sql(12, 0.8, -100, 5))
def aks_twelve(spark, sf_dir):
    """Default thresholds never stop early; a budget of 12 gives 8 segments of one frame."""
    return selection.select_frames(scored(spark, sf_dir), "aks", 12)


def _focus_sql(k: int, seed: int) -> str:
    return f"""WITH {SC}, first AS (SELECT DISTINCT video, least(floor(i * (n / 32.0::DOUBLE) + (n / 32.0::DOUBLE) / 2), n - 1)::BIGINT AS pos FROM (SELECT DISTINCT video, n FROM sc), range(0, 32) t(i)),
top AS (SELECT sc.*, row_number() OVER (PARTITION BY video ORDER BY score DESC, frame_id) AS r FROM sc JOIN first USING (video, pos)),
win AS (SELECT video, pos AS anchor, greatest(pos - greatest(4, n // 32), 0) AS low, least(pos + greatest(4, n // 32), n - 1) AS high FROM top WHERE r <= least(8, {k})),
near AS (SELECT DISTINCT video, (low + least(floor(i * ((high - low + 1) / 8.0::DOUBLE) + ((high - low + 1) / 8.0::DOUBLE) / 2), high - low))::BIGINT AS pos FROM win, range(0, 8) t(i)),
known AS (SELECT video, pos FROM first UNION SELECT video, pos FROM near),
free AS (SELECT w.video, w.anchor, w.pos FROM (SELECT video, anchor, unnest(range(low, high + 1)) AS pos FROM win) w ANTI JOIN known USING (video, pos)),
drawn AS (SELECT video, pos FROM free QUALIFY row_number() OVER (PARTITION BY video, anchor ORDER BY md5('{seed}-' || video || '-' || anchor || '-' || pos)) <= 3),
pool AS (SELECT video, pos FROM known UNION SELECT video, pos FROM drawn),
r AS (SELECT sc.*, row_number() OVER (PARTITION BY video ORDER BY score DESC, frame_id) AS r FROM sc JOIN pool USING (video, pos))
SELECT video, {_TIME}, frame_id FROM r WHERE r <= {k}"""


@register("sel_focus", _focus_sql(K, 0))
def focus(spark, sf_dir):
    return selection.select_frames(scored(spark, sf_dir), "focus", K)


@register("sel_sevila", _focus_sql(4, 5))
def sevila(spark, sf_dir):
    return selection.select_frames(scored(spark, sf_dir), "sevila", 4, seed=5)


@register(
    "sel_qframe",
    f"""WITH {SC}, pool AS (SELECT sc.* FROM sc JOIN (SELECT DISTINCT video, CASE WHEN c > 1 THEN (i * (n - 1)) // (c - 1) ELSE 0 END::BIGINT AS pos FROM (SELECT DISTINCT video, n, least(128, n) AS c FROM sc), range(0, 128) t(i) WHERE i < c) USING (video, pos)),
x AS (SELECT *, score / 0.8::DOUBLE AS x, max(score / 0.8::DOUBLE) OVER (PARTITION BY video) AS top, (('0x' || substr(md5('9-' || video || '-' || frame_id), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE AS u FROM pool),
k AS (SELECT *, round(x - top - ln(sum(exp(x - top)) OVER (PARTITION BY video)) - ln(-ln(u)), 9) AS key FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY key DESC, frame_id) AS r FROM k)
SELECT video, {_TIME}, frame_id, CASE WHEN r <= 4 THEN 1.0 WHEN r <= 12 THEN 0.5 ELSE 0.25 END::DOUBLE AS scale FROM r WHERE r <= 44""",
)
def qframe(spark, sf_dir):
    return selection.pick_gumbel_buckets(scored(spark, sf_dir), 44, seed=9)


@register("sel_linspace_pool", f"WITH {SC}, pool AS (SELECT sc.* FROM sc JOIN (SELECT DISTINCT video, round_even(i * (n - 1) / 63.0::DOUBLE, 0)::BIGINT AS pos FROM (SELECT DISTINCT video, n FROM sc), range(0, 64) t(i)) USING (video, pos)), r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY score DESC, frame_id) AS r FROM pool) SELECT video, {_TIME}, frame_id FROM r WHERE r <= 12")
def linspace_pool_top(spark, sf_dir):
    rows = scored(spark, sf_dir)
    lengths = rows.groupBy("video").agg(F.max("n").alias("n_frames"))
    pool = resample.linspace(lengths, max(64, 4 * 12), keys=["video"])
    return selection.pick_top(rows.join(pool, ["video", "pos"]), 12)


_PHI = f"""{SIMS}, cl AS (SELECT *, greatest(sim, 0) AS s FROM sims), me AS (SELECT video, kw_id, quantile_disc(s, 0.5) AS median FROM cl GROUP BY ALL),
zs AS (SELECT video, kw_id, sum(greatest(s - median, 0)) AS l1, sqrt(sum(greatest(s - median, 0) * greatest(s - median, 0))) AS l2, sqrt(count(*)::DOUBLE) AS root FROM cl JOIN me USING (video, kw_id) GROUP BY ALL),
phi AS (SELECT video, kw_id, round(greatest(0.0, least(1.0, coalesce((root - l1 / nullif(l2, 0)) / nullif(root - 1, 0), 0))), 9)::DOUBLE AS phi FROM zs)"""


@register("sel_local_evidence", f"WITH {_PHI} SELECT video, kw_id, round(phi, 6) AS phi FROM phi")
def evidence(spark, sf_dir):
    return selection.local_evidence(sims(spark, sf_dir)).select("video", "kw_id", F.round("phi", 6).alias("phi"))


def _power(strength: float) -> str:
    return f"{_PHI}, wt AS (SELECT *, round(CASE WHEN sum(pow(phi, {strength})) OVER w > 1e-12 THEN pow(phi, {strength}) / sum(pow(phi, {strength})) OVER w ELSE 1.0 / count(*) OVER w END, 9)::DOUBLE AS weight FROM phi WINDOW w AS (PARTITION BY video))"


@register("sel_weights_power", f"WITH {_power(2.0)} SELECT video, kw_id, round(weight, 6) AS weight FROM wt")
def weights_power(spark, sf_dir):
    return selection.power_weights(selection.local_evidence(sims(spark, sf_dir)), 2.0).select("video", "kw_id", F.round("weight", 6).alias("weight"))


@register("sel_weights_linear", f"WITH {_PHI} SELECT video, kw_id, round(0.5 / count(*) OVER w + 0.5 * coalesce(phi / nullif(sum(phi) OVER w, 0), 1.0 / count(*) OVER w), 6)::DOUBLE AS weight FROM phi WINDOW w AS (PARTITION BY video)")
def weights_linear(spark, sf_dir):
    return selection.linear_weights(selection.local_evidence(sims(spark, sf_dir)), 0.5).select("video", "kw_id", F.round("weight", 6).alias("weight"))


@register("sel_keyword_cap", f"WITH {_SELF} SELECT video, kw_id, round(max_sim, 6) AS max_sim FROM selfsim QUALIFY row_number() OVER (PARTITION BY video ORDER BY max_sim DESC, kw_id) > count(*) OVER (PARTITION BY video) - 3")
def capped(spark, sf_dir):
    return selection.cap_keywords(keywords(spark, sf_dir), 3).select("video", "kw_id", F.round("max_sim", 6).alias("max_sim"))


def _quota(strength: float, budget: int) -> str:
    return f"""{_power(strength)}, fl AS (SELECT *, floor(round(weight * {budget}, 9)) AS fl, round(round(weight * {budget}, 9) - floor(round(weight * {budget}, 9)), 9) AS fr FROM wt),
quota AS (SELECT video, kw_id, weight, (fl + CASE WHEN row_number() OVER (PARTITION BY video ORDER BY fr DESC, kw_id) <= {budget} - sum(fl) OVER (PARTITION BY video) THEN 1 ELSE 0 END)::BIGINT AS quota FROM fl)"""


@register("win_largest_remainder", f"WITH {_quota(1.0, 10)} SELECT video, sum(quota)::BIGINT AS total, max(quota)::BIGINT AS most FROM quota GROUP BY video")
def remainder(spark, sf_dir):
    found = selection.quotas(selection.power_weights(selection.local_evidence(sims(spark, sf_dir)), 1.0), 10)
    return found.groupBy("video").agg(F.sum("quota").alias("total"), F.max("quota").alias("most"))


@register("sel_quota_alloc", f"WITH {_quota(2.0, K)} SELECT video, kw_id, quota FROM quota")
def quota_alloc(spark, sf_dir):
    return selection.quotas(selection.power_weights(selection.local_evidence(sims(spark, sf_dir)), 2.0), K).select("video", "kw_id", "quota")


@register(
    "sel_quota_topk",
    f"""WITH RECURSIVE {_quota(2.0, K)},
lists AS (SELECT video, row_number() OVER (PARTITION BY video ORDER BY weight DESC, kw_id) AS turn, kw_id, quota, ranked FROM quota JOIN (SELECT video, kw_id, list(frame_id ORDER BY sim DESC, frame_id) AS ranked FROM sims GROUP BY ALL) USING (video, kw_id)),
fold AS (SELECT video, 0::BIGINT AS turn, []::BIGINT[] AS acc, []::BIGINT[] AS kws FROM (SELECT DISTINCT video FROM lists)
  UNION ALL SELECT f.video, l.turn, list_concat(f.acc, list_filter(l.ranked, lambda x: NOT list_contains(f.acc, x))[1:l.quota]), list_concat(f.kws, list_transform(range(0, l.quota), lambda x: l.kw_id)) FROM fold f JOIN lists l ON l.video = f.video AND l.turn = f.turn + 1),
done AS (SELECT video, unnest(acc) AS frame_id, unnest(kws) AS kw_id FROM fold QUALIFY turn = max(turn) OVER (PARTITION BY video))
SELECT video, {_TIME}, frame_id, kw_id FROM done""",
)
def quota_topk(spark, sf_dir):
    rows = sims(spark, sf_dir)
    return selection.pick_by_quota(rows, selection.quotas(selection.power_weights(selection.local_evidence(rows), 2.0), K), K)


@register(
    "sel_iterative_rounds",
    f"""WITH {SC}, {_TOP}, sch AS (SELECT video, (row_number() OVER (PARTITION BY video ORDER BY n_used) - 1)::BIGINT AS round_idx, n_used FROM (SELECT video, unnest(list_distinct(list_append(range(16, n, 16), n))) AS n_used FROM (SELECT DISTINCT video, n FROM sc)))
SELECT video, round_idx, row_number() OVER (PARTITION BY video, round_idx ORDER BY frame_id) - 1 AS ord, frame_id FROM sch JOIN r USING (video) WHERE r <= n_used""",
)
def iterative(spark, sf_dir):
    return selection.pick_iterative(scored(spark, sf_dir), K)
