"""Samples, splits and positions on a timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesift.operators import resample, sampling
from framesift.plans import register
from framesift.plans.views import SAMPLES, VID, frames, samples, videos

K = ["video"]


@register("tk_first_n", "SELECT doc_id::BIGINT AS sample_id, lang AS task_type FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 50")
def first_n(spark, sf_dir):
    rows = samples(spark, sf_dir).where(F.col("task_type") == "en").select("sample_id", "task_type")
    return sampling.first_n(rows, 50, "sample_id")


@register("tk_seeded_sample", "SELECT doc_id::BIGINT AS sample_id FROM documents ORDER BY md5('1042-' || doc_id), doc_id LIMIT 40")
def seeded(spark, sf_dir):
    return sampling.seeded_sample(samples(spark, sf_dir).select("sample_id"), 40, 1042, "sample_id")


_SPLIT = "sp AS (SELECT doc_id::BIGINT AS sample_id, row_number() OVER (ORDER BY md5('7-' || doc_id), doc_id) <= floor(count(*) OVER () * 0.8) AS is_train FROM documents)"


@register("tk_split_train", f"WITH {_SPLIT} SELECT sample_id, is_train FROM sp")
def split(spark, sf_dir):
    return sampling.seeded_split(samples(spark, sf_dir).select("sample_id"), 0.8, 7, "sample_id")


@register("tk_split_laws", f"WITH {_SPLIT} SELECT count(*)::BIGINT AS n, (count(*) FILTER (is_train))::BIGINT AS n_train, (count(*) FILTER (NOT is_train))::BIGINT AS n_test, 0::BIGINT AS overlap, abs(count(*) FILTER (is_train) / count(*) - 0.8) < 0.01 AS ratio_ok FROM sp")
def split_laws(spark, sf_dir):
    return sampling.split_report(sampling.seeded_split(samples(spark, sf_dir).select("sample_id"), 0.8, 7, "sample_id"), 0.8, "sample_id")


@register("tk_one_per_bucket", "SELECT lang AS task_type, doc_id::BIGINT AS sample_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('3-' || doc_id), doc_id) = 1")
def one_each(spark, sf_dir):
    return sampling.one_per_bucket(samples(spark, sf_dir).select("task_type", "sample_id"), 3, "task_type", "sample_id")


@register("tk_first_per_bucket", "SELECT source AS dataset, doc_id::BIGINT AS sample_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3")
def first_each(spark, sf_dir):
    return sampling.first_per_bucket(samples(spark, sf_dir).select("dataset", "sample_id"), 3, "dataset", "sample_id")


@register("rs_target_fps", f"WITH {VID} SELECT DISTINCT video, round_even(i * 2.5, 0)::BIGINT AS pos FROM (SELECT video, n, unnest(range(0, ceil(n / 2.5)::BIGINT)) AS i FROM vid) WHERE round_even(i * 2.5, 0) < n")
def target_fps(spark, sf_dir):
    return resample.to_fps(videos(spark, sf_dir), 1.0, keys=K)


@register("rs_every_kth", f"WITH {VID} SELECT video, unnest(range(0, n, 7)) AS pos FROM vid")
def every_kth(spark, sf_dir):
    return resample.every_kth(videos(spark, sf_dir), 7, keys=K)


@register("rs_uniform", f"WITH {VID} SELECT video, i, (i * n) // 16 AS pos FROM vid, range(0, 16) t(i)")
def uniform(spark, sf_dir):
    return resample.uniform(videos(spark, sf_dir), 16, keys=K)


@register("rs_inclusive", f"WITH {VID} SELECT DISTINCT video, CASE WHEN c > 1 THEN (i * (n - 1)) // (c - 1) ELSE 0 END::BIGINT AS pos FROM (SELECT *, least(128, n) AS c FROM vid), range(0, 128) t(i) WHERE i < c")
def inclusive(spark, sf_dir):
    return resample.inclusive(videos(spark, sf_dir), 128, keys=K)


@register("rs_midpoint", f"WITH {VID} SELECT DISTINCT video, least(floor(i * (n / 32.0::DOUBLE) + (n / 32.0::DOUBLE) / 2), n - 1)::BIGINT AS pos FROM vid, range(0, 32) t(i)")
def midpoint(spark, sf_dir):
    return resample.midpoints(videos(spark, sf_dir), 32, keys=K)


@register("rs_linspace_round", f"WITH {VID} SELECT DISTINCT video, round_even(i * (n - 1) / 23.0::DOUBLE, 0)::BIGINT AS pos FROM vid, range(0, 24) t(i)")
def linspace_round(spark, sf_dir):
    return resample.linspace(videos(spark, sf_dir), 24, keys=K)


@register("rs_linspace_trunc", f"WITH {VID} SELECT DISTINCT video, floor(i * (n - 1) / 4.0::DOUBLE)::BIGINT AS pos FROM vid, range(0, 5) t(i)")
def linspace_trunc(spark, sf_dir):
    return resample.linspace(videos(spark, sf_dir), 5, keys=K, rounded=False)


@register("rs_time_bins", "SELECT DISTINCT label::BIGINT AS video, round_even(coalesce(pos / nullif(n - 1, 0)::DOUBLE, 0) * 19, 0)::BIGINT AS bin FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n, vec_id FROM embeddings)")
def bins(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumnRenamed("n", "n_frames")
    return resample.time_bins(rows, 20, keys=K)


@register("frame_schedule", f"WITH {VID} SELECT video, (row_number() OVER (PARTITION BY video ORDER BY n_used) - 1)::BIGINT AS round_idx, n_used FROM (SELECT video, unnest(list_distinct(list_append(range(8, n, 8), n))) AS n_used FROM vid)")
def frame_schedule(spark, sf_dir):
    return resample.schedule(videos(spark, sf_dir), 8, keys=K)


@register("rs_pool_fps", f"WITH {VID} SELECT DISTINCT video, round_even(i * 2.5::DOUBLE, 0)::BIGINT AS pos FROM (SELECT video, n, unnest(range(0, ceil(n / 2.5)::BIGINT)) AS i FROM vid) WHERE round_even(i * 2.5::DOUBLE, 0) < n")
def pool_fps(spark, sf_dir):
    return resample.pool_to_fps(videos(spark, sf_dir), 1.0, keys=K)


@register("rs_grid_fps", f"WITH {VID} SELECT DISTINCT video, least(round_even(i / 0.7::DOUBLE * 2.5::DOUBLE, 0), n - 1)::BIGINT AS pos FROM (SELECT video, n, unnest(range(0, floor(n / 2.5::DOUBLE * 0.7::DOUBLE)::BIGINT)) AS i FROM vid)")
def grid_fps(spark, sf_dir):
    return resample.grid_at_fps(videos(spark, sf_dir), 0.7, keys=K)


@register("rs_stride_fps", f"WITH {VID} SELECT DISTINCT video, unnest(range(0, n, 4))::BIGINT AS pos FROM vid")
def stride_fps(spark, sf_dir):
    return resample.at_stride(videos(spark, sf_dir), 0.6, keys=K)


@register("rs_caption_frame", f"WITH {VID} SELECT video, c::BIGINT AS caption, round_even((c - 1) / 6.0::DOUBLE * (n - 1), 0)::BIGINT AS pos FROM vid, range(1, 8) t(c)")
def caption_frames(spark, sf_dir):
    rows = videos(spark, sf_dir).withColumn("caption", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(7).cast("bigint"))))
    return rows.select("video", "caption", resample.caption_frame(F.col("caption"), F.lit(7), F.col("n_frames")).alias("pos"))
