"""Accuracy, relative accuracy, counters, calibration and overlap of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions.answers import relative_accuracy


def filter_tasks(samples: DataFrame, wanted: str, *, options: str = "options", task: str = "task_type") -> DataFrame:
    """all; mcq (with options); generation or numeric (without); else the task's own name."""
    name = wanted.lower()
    if name == "all":
        return samples
    if name == "mcq":
        return samples.where(F.col(options).isNotNull())
    if name in ("generation", "numeric"):
        return samples.where(F.col(options).isNull())
    return samples.where(F.col(task) == wanted)


def allowed_tasks(samples: DataFrame, allowed: list[str], *, task: str = "task_type") -> DataFrame:
    """Samples of these task types, case ignored."""
    return samples.where(F.lower(task).isin([a.lower() for a in allowed]))


def judged_by_choices(wanted: str) -> bool:
    """Whether a filter's accuracy is that of choices."""
    return wanted.strip() not in ("all", "numeric", "generation")


def safe_mean(value) -> Column:
    """0 where there is nothing to average."""
    return F.coalesce(F.avg(value), F.lit(0.0))


def outcome_counts(rows: DataFrame, keys: list[str], *, status: str = "status", good: str = "success") -> DataFrame:
    """keys, n, success, failed; a null status has failed."""
    ok = F.coalesce(F.col(status) == good, F.lit(False))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"))


def tally(rows: DataFrame, keys: list[str], *, unparsed: str = "skip") -> DataFrame:
    """keys, correct, n_mcq, mra_sum, n_numeric of rows with is_mcq, truth, answer, truth_number, number.

    unparsed: `skip` leaves numeric answers without a number out of the count, `zero` counts them as 0.
    """
    mcq, numeric = F.col("is_mcq"), ~F.col("is_mcq")
    right = F.upper(F.trim("answer")) == F.upper(F.trim("truth"))
    mra = relative_accuracy(F.col("number"), F.col("truth_number"))
    counted = numeric & (F.col("number").isNotNull() if unparsed == "skip" else F.lit(True))
    return rows.groupBy(*keys).agg(
        F.count_if(mcq & right).alias("correct"),
        F.count_if(mcq).alias("n_mcq"),
        F.coalesce(F.sum(F.when(numeric, mra)), F.lit(0.0)).alias("mra_sum"),
        F.count_if(counted).alias("n_numeric"),
    )


def accuracy(tallied: DataFrame, kind: str) -> DataFrame:
    """Adds accuracy in percent: of numbers (`numeric`), of both (`all`), 0 for `generation`, and of choices for any other filter; 0 without a sample."""
    if kind == "generation":
        return tallied.withColumn("accuracy", F.lit(0.0))
    kind = kind if kind in ("numeric", "all") else "mcq"
    top, bottom = {
        "mcq": (F.col("correct"), F.col("n_mcq")),
        "numeric": (F.col("mra_sum"), F.col("n_numeric")),
        "all": (F.col("correct") + F.col("mra_sum"), F.col("n_mcq") + F.col("n_numeric")),
    }[kind]
    return tallied.withColumn("accuracy", F.round(F.coalesce(F.try_divide(100.0 * top, bottom), F.lit(0.0)), 6))


#: Filters that aren't a task's name.
FILTERS = ("all", "mcq", "generation", "numeric")


def filters_of(options: Column, task: Column) -> Column:
    """Array of the filters that a sample passes: all, by its options, and its task's name (unless that is a filter's name itself)."""
    has = options.isNotNull()
    kinds = F.when(has, F.array(F.lit("all"), F.lit("mcq"))).otherwise(F.array(F.lit("all"), F.lit("generation"), F.lit("numeric")))
    named = F.when(task.isNotNull() & ~F.lower(task).isin(*FILTERS), F.array(task)).otherwise(F.array().cast("array<string>"))
    return F.concat(kinds, named)


def accuracies(rows: DataFrame, *, unparsed: str = "skip", options: str = "options", task: str = "task_type") -> DataFrame:
    """wanted, correct, n_mcq, mra_sum, n_numeric, accuracy for every filter that a sample passes, in one pass over the samples.

    rows as for tally(), with the options and the task. The samples are read once and become a row for each filter inside the task that
    reads them; partial sums by filter are all that is exchanged.
    """
    spread = rows.withColumn("wanted", F.explode(filters_of(F.col(options), F.col(task))))
    tallied = tally(spread, ["wanted"], unparsed=unparsed)

    def share(top: Column, bottom: Column) -> Column:
        return F.round(F.coalesce(F.try_divide(100.0 * top, bottom), F.lit(0.0)), 6)

    both = share(F.col("correct") + F.col("mra_sum"), F.col("n_mcq") + F.col("n_numeric"))
    kind = F.when(F.col("wanted") == "generation", F.lit(0.0)).when(F.col("wanted") == "numeric", share(F.col("mra_sum"), F.col("n_numeric"))).when(F.col("wanted") == "all", both)
    return tallied.withColumn("accuracy", kind.otherwise(share(F.col("correct"), F.col("n_mcq"))))


def ablation_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each configuration: keys, num_samples, topk_alignment_percent, avg_jaccard, accuracies in percent and counts of both selections.

    rows: keys, same_frame_percent, jaccard, coverage_correct, topk_correct (0 or 1).
    """
    right = {c: F.coalesce(F.sum(f"{c}_correct"), F.lit(0)).cast("bigint") for c in ("coverage", "topk")}
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.round(safe_mean("same_frame_percent"), 6).alias("topk_alignment_percent"),
        F.round(safe_mean("jaccard"), 6).alias("avg_jaccard"),
        *[F.round(100.0 * n / F.count(F.lit(1)), 6).alias(f"{c}_accuracy_percent") for c, n in right.items()],
        *[n.alias(f"{c}_correct") for c, n in right.items()],
    )


def confidence_bins(rows: DataFrame, *, prob: str = "prob", correct: str = "correct", bins: int = 10, means: tuple[str, ...] = ()) -> DataFrame:
    """Right-closed equal bins, the first closed on both sides; empty bins stay: bin, n, accuracy, mean_prob, and mean_x for further columns x."""
    spark = rows.sparkSession
    binned = rows.withColumn("bin", F.greatest(F.lit(1), F.ceil(F.round(F.col(prob) * bins, 9))).cast("bigint"))
    per = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(correct).cast("double")), 6).alias("accuracy"), F.round(F.avg(prob), 6).alias("mean_prob"), *[F.round(F.avg(m), 6).alias(f"mean_{m}") for m in means])
    return spark.range(1, bins + 1).withColumnRenamed("id", "bin").join(per, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "accuracy", "mean_prob", *[f"mean_{m}" for m in means])


def correlation(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson; null where a column is constant."""
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(r, 6).alias("corr"))


def compare_sets(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds overlap, union_size, same_frame_percent (of the larger set), jaccard (0 for two empty sets), and how many are in one only."""
    overlap, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    larger = F.greatest(F.size(a), F.size(b), F.lit(1))
    return pairs.select(
        "*",
        overlap.cast("bigint").alias("overlap"),
        union.cast("bigint").alias("union_size"),
        F.round(100.0 * overlap / larger, 6).alias("same_frame_percent"),
        F.round(F.when(union > 0, overlap / F.greatest(union, F.lit(1))).otherwise(0.0), 6).alias("jaccard"),
        F.size(F.array_except(a, b)).cast("bigint").alias("only_a"),
        F.size(F.array_except(b, a)).cast("bigint").alias("only_b"),
    )


def overlap_matrix(selected: DataFrame, budget: int, *, config: str = "config", sample: str = "video", frame: str = "frame_id", spine: DataFrame | None = None) -> DataFrame:
    """Mean overlap (of the budget) of every two configurations over their samples. A join of frames, so no sample's sets are paired in memory.

    spine: the pairs of configuration and sample that there are. A pair without a frame is an empty selection; two of those overlap wholly (1).
    Without a spine only pairs with frames count.
    """
    sets = selected.select(config, sample, frame).distinct()
    a, b = sets.alias("a"), sets.alias("b")
    shared = a.join(b, [sample, frame]).groupBy(F.col(f"a.{config}").alias("config_a"), F.col(f"b.{config}").alias("config_b"), sample).agg((F.count(F.lit(1)) / float(budget)).alias("share"))
    names = sets.select(config, sample).distinct().withColumn("filled", F.lit(True))
    if spine is not None:
        names = spine.select(config, sample).distinct().join(names, [config, sample], "left")
    x, y = names.alias("x"), names.alias("y")
    neither = F.coalesce("x.filled", "y.filled").isNull()
    every = x.join(y, sample).select(F.col(f"x.{config}").alias("config_a"), F.col(f"y.{config}").alias("config_b"), sample, neither.alias("neither"))
    overlap = F.when(F.col("neither"), 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return every.join(shared, ["config_a", "config_b", sample], "left").groupBy("config_a", "config_b").agg(F.count(F.lit(1)).alias("n_samples"), F.round(F.avg(overlap), 4).alias("mean_overlap"))


def common_samples(rows: DataFrame, *, config: str, sample: str) -> DataFrame:
    """Rows of samples that every configuration has."""
    pairs = rows.select(config, sample).distinct()
    wanted = pairs.select(config).distinct().agg(F.count(F.lit(1)).alias("wanted"))
    full = pairs.groupBy(sample).agg(F.count(F.lit(1)).alias("have")).join(F.broadcast(wanted), F.col("have") == F.col("wanted")).select(sample)
    return rows.join(full, sample, "left_semi")


def score_stats(scored: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.min(score), 6).alias("min_score"), F.round(F.max(score), 6).alias("max_score"), F.round(F.avg(score), 6).alias("mean_score"))


def model_differences(timed: DataFrame, *, key: str, model: str, value: str, first: str, second: str) -> DataFrame:
    """key, first and second model's mean, delta, ratio (infinite where the first is 0; a model without a row has mean 0)."""
    means = timed.where(F.col(model).isin(first, second)).groupBy(key).agg(
        safe_mean(F.when(F.col(model) == first, F.col(value))).alias("a"), safe_mean(F.when(F.col(model) == second, F.col(value))).alias("b")
    )
    return means.select(key, F.round("a", 6).alias("mean_a"), F.round("b", 6).alias("mean_b"), F.round(F.col("b") - F.col("a"), 6).alias("delta"), F.when(F.col("a") > 0, F.round(F.try_divide("b", "a"), 6)).otherwise(float("inf")).alias("ratio"))


def allocation_by_rank(allotted: DataFrame, *, config: list[str]) -> DataFrame:
    """Mean quota by a keyword's rank of weight within its video."""
    w = Window.partitionBy(*config, "video").orderBy(F.col("weight").desc(), "kw_id")
    ranked = allotted.withColumn("kw_rank", F.row_number().over(w).cast("bigint"))
    return ranked.groupBy(*config, "kw_rank").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quota"), 6).alias("mean_quota"))
