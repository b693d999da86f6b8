"""Result logs: CSV appends that keep their header, JSON lines, manifests, matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions import texts
from framesift.sources.logs import append_log

#: Fixed columns of the run log.
RUN_COLUMNS = [
    "timestamp", "dataset", "seed", "task_filter", "num_samples", "correct_count", "accuracy_percent", "num_frames", "avg_inference_time",
    "frame_sampling_method", "avg_frame_sampling_time", "avg_embedding_build_time", "avg_selected_frame_count", "avg_total_time_hours",
    "model_name", "visual_encoder_backend", "visual_encoder_model", "lora_path", "candidate_pool_fps", "max_keywords",
    "keyword_prompt_version", "keyword_extractor_model", "use_keyword_cache", "keyword_cache_number", "keyword_weight_strength",
    "use_preprocessed_clip_frames", "preprocessed_clip_fps", "use_subtitles",
]


def append_csv(rows: DataFrame, path: str) -> bool:
    """Appends to a log (sources.logs) as a whole; where its header has other columns nothing is written and False comes back."""
    return append_log(rows, path)


def run_log(rows: DataFrame) -> DataFrame:
    """The run log's columns in order; those that rows lack are null."""
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c)) for c in RUN_COLUMNS])


def append_json(rows: DataFrame, path: str) -> None:
    """JSON lines; nested columns stay nested."""
    rows.write.mode("append").json(path)


def selection_index(selected: DataFrame, config: dict[str, str], *, sample: str = "video") -> DataFrame:
    """One nested record per sample: selected_frames in order, and the configuration."""
    frames = F.array_sort(F.collect_list(F.struct(F.col("ord").alias("order"), F.col("frame_id"))))
    settings = F.create_map(*[F.lit(x) for kv in sorted(config.items()) for x in kv]) if config else F.create_map().cast("map<string,string>")
    return selected.groupBy(sample).agg(frames.alias("selected_frames")).withColumn("selection_config", settings)


#: Fixed settings that a selection's record keeps.
SELECTION_SETTINGS = [
    "num_frames_budget", "candidate_pool_fps", "quota_prescreen_alpha", "quota_gamma", "max_keywords", "keyword_prompt_version",
    "keyword_extractor_model", "keyword_weight_strength", "ensure_keyword_min_coverage",
]


def selection_records(samples: DataFrame, selected: DataFrame, settings: dict[str, str], *, mode: str | None = None, method: str | None = None) -> DataFrame:
    """The whole record of each sample's selection, for append_json().

    samples: sample_id, task_type, question, options, gt_answer, pred_answer, keywords, frame_ids (the pool, in order), prescreen_frame_ids, detail_path; selected:
    sample_id, ord, index_in_pool. Null lists are empty, null texts too; settings outside SELECTION_SETTINGS are left out. A sample without a selection has an empty one.
    """
    pool = samples.select("sample_id", "frame_ids")
    picked = selected.join(pool, "sample_id").select("sample_id", F.struct(F.col("ord").cast("bigint").alias("order"), F.col("index_in_pool").cast("bigint").alias("index_in_pool"), F.get("frame_ids", F.col("index_in_pool")).alias("frame_id")).alias("f"))
    picked = picked.groupBy("sample_id").agg(F.array_sort(F.collect_list("f")).alias("selected_frames"))
    none = F.array().cast("array<struct<order:bigint,index_in_pool:bigint,frame_id:bigint>>")
    frames = F.coalesce("selected_frames", none)
    kept = [F.lit(x) for k in SELECTION_SETTINGS if k in settings for x in (k, settings[k])]

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    def listed(name: str, kind: str) -> Column:
        return F.coalesce(F.col(name).cast(kind), F.array().cast(kind)).alias(name)

    return samples.join(picked, "sample_id", "left").select(
        "sample_id", text("task_type"), text("question"), listed("options", "array<string>"), text("gt_answer"), text("pred_answer"),
        (F.upper(F.trim(F.coalesce("pred_answer", F.lit("")))) == F.upper(F.trim(F.coalesce("gt_answer", F.lit(""))))).alias("is_correct"),
        listed("keywords", "array<string>"),
        F.coalesce(F.size(F.coalesce("frame_ids", F.array().cast("array<bigint>"))), F.lit(0)).alias("candidate_pool_size"),
        F.size(frames).alias("selected_count"),
        F.transform(frames, lambda f: f["index_in_pool"]).alias("selected_index_in_pool"),
        F.transform(frames, lambda f: f["frame_id"]).alias("selected_frame_ids"),
        frames.alias("selected_frames"),
        listed("prescreen_frame_ids", "array<bigint>"),
        F.size(F.coalesce("prescreen_frame_ids", F.array().cast("array<bigint>"))).alias("prescreen_candidate_count"),
        F.lit(mode).cast("string").alias("frame_selection_mode"),
        F.lit(method).cast("string").alias("frame_selection_method"),
        (F.create_map(*kept) if kept else F.create_map().cast("map<string,string>")).alias("selection_config"),
        text("detail_path").alias("verbose_detail_path"),
    )


def round_details(rounds: DataFrame, frames: DataFrame, keywords: DataFrame) -> DataFrame:
    """A nested record for each round: sample, prediction, keywords, frames with their five best keywords.

    rounds: sample_id, stage, round_id, question, options, gt_answer, answer, response, inference_time, option_probs (map), candidate_count; frames: sample_id, stage,
    round_id, ord, index_in_pool, frame_id, subtitle, keyword_scores (map); keywords: sample_id, text, local_evidence_score, info_score, weight, used_for_selection.
    """
    keys = ["sample_id", "stage", "round_id"]
    entries = F.transform(F.map_entries(F.coalesce("keyword_scores", F.create_map().cast("map<string,double>"))), lambda e: F.struct((-e["value"]).alias("low"), e["key"].alias("keyword")))
    best = F.transform(F.slice(F.array_sort(entries), 1, 5), lambda e: F.struct(e["keyword"].alias("keyword"), (-e["low"]).alias("clip_score")))
    name = F.format_string("%02d_frame_%d.jpg", F.col("ord").cast("int"), F.col("frame_id"))
    shown = F.struct(F.col("ord").alias("order"), "index_in_pool", "frame_id", name.alias("file"), F.coalesce("subtitle", F.lit("")).alias("subtitle"), best.alias("top_keywords"))
    images = frames.groupBy(*keys).agg(F.array_sort(F.collect_list(shown), lambda a, b: (a["order"] - b["order"]).cast("int")).alias("selected"))
    final = F.struct("text", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("local_evidence_score", "info_score", "weight")], F.coalesce("used_for_selection", F.lit(True)).alias("used_for_selection"))
    words = keywords.groupBy("sample_id").agg(F.sort_array(F.collect_list(final)).alias("final"))
    right = F.upper(F.trim(F.coalesce("answer", F.lit("")))) == F.upper(F.trim(F.coalesce("gt_answer", F.lit(""))))
    return rounds.join(images, keys, "left").join(words, "sample_id", "left").select(
        *keys,
        F.struct(F.col("sample_id").alias("id"), "question", F.coalesce("options", F.array().cast("array<string>")).alias("options"), F.col("gt_answer").alias("ground_truth")).alias("sample"),
        F.struct("answer", "response", right.alias("is_correct"), F.col("inference_time").alias("inference_time_sec"), "option_probs").alias("prediction"),
        F.struct("final").alias("keywords"),
        F.struct("candidate_count", F.coalesce(F.size("selected"), F.lit(0)).alias("selected_count"), "selected").alias("frames"),
        F.concat(texts.safe_name(F.col("sample_id")), F.lit("/"), F.format_string("%s_round_%02d/info.json", F.col("stage"), F.col("round_id").cast("int"))).alias("detail_path"),
    )


def top_keywords(sims: DataFrame, n: int = 5, *, sample: str = "video") -> DataFrame:
    """Per frame its n best keywords, best first."""
    ranked = F.sort_array(F.collect_list(F.struct("sim", F.col("kw_id"))), asc=False)
    return sims.groupBy(sample, "frame_id").agg(F.slice(ranked, 1, n).alias("top_keywords"))


def cache_path(dataset: str, extractor: str, prompt_version: int, target: int, number: int, duration: str | None = None) -> dict[str, str]:
    """Partition columns of a keyword cache."""
    import re

    def clean(x: str) -> str:
        return re.sub(r"[^A-Za-z0-9._-]+", "_", x).strip("_") or "unknown"

    name = f"{dataset}-{duration}" if duration else dataset
    return {"dataset_key": clean(name.lower()), "extractor": clean(extractor), "config": f"pv{prompt_version}_tk{target}", "cn": str(number)}


def write_cache(entries: DataFrame, root: str, key: dict[str, str]) -> None:
    """Appends entries under their partition; Spark's commit makes a write whole or absent."""
    for name, value in key.items():
        entries = entries.withColumn(name, F.lit(value))
    entries.write.mode("append").partitionBy(*key).parquet(root)


def read_cache(spark: SparkSession, root: str, key: dict[str, str]) -> DataFrame:
    """Entries with a keyword that isn't blank; keywords trimmed, without blank ones."""
    rows = spark.read.parquet(root)
    for name, value in key.items():
        rows = rows.where(F.col(name) == value)
    for lists in ("kws", "kws_raw"):
        if lists in rows.columns:
            rows = rows.withColumn(lists, F.filter(F.transform(lists, lambda k: F.trim(k)), lambda k: F.coalesce(k, F.lit("")) != ""))
    return rows.where(F.size("kws") > 0)


def cached_keywords(wanted: DataFrame, cache: DataFrame, *, file_id: str = "file_id") -> DataFrame:
    """wanted (sample_id) with kws and kws_raw of its cache entry, null without one.

    An entry is found by the id that its file is named after. It counts only if its own sample_id is blank or, as a file's name, the same: two ids can
    give one name.
    """
    rows = wanted.withColumn("_file", texts.safe_name(F.col("sample_id").cast("string")))
    own = F.coalesce(F.trim(F.col("sample_id").cast("string")), F.lit(""))
    entries = cache.select(F.col(file_id).alias("_file"), own.alias("_own"), "kws", "kws_raw")
    same = (entries["_file"] == rows["_file"]) & ((F.col("_own") == "") | (F.col("_own") == F.trim(rows["sample_id"].cast("string"))))
    found = rows.join(entries, same, "left").groupBy(*[rows[c] for c in wanted.columns]).agg(F.min(F.struct("kws", "kws_raw")).alias("entry"))
    return found.select(*wanted.columns, "entry.kws", "entry.kws_raw")


def curve_csv(rows: DataFrame, x: str, y: str, path: str) -> None:
    rows.select(F.format_string("%.6f", F.col(x).cast("double")).alias(x), F.format_string("%.6f", F.col(y).cast("double")).alias(y)).write.mode("overwrite").csv(path, header=True)


def matrix(rows: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Pivot with 4 decimals over the named columns."""
    return rows.groupBy(row).pivot(column, columns).agg(F.round(F.avg(value), 4)).orderBy(row)
