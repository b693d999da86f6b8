"""Iterative answering with an early stop: a sample is asked round after round with more frames until its answer is stable.

A round is stable if its sample has options, its answer is one of LETTERS and that option's probability is above a threshold; as many stable
rounds in a row with one answer as the window asks for end the sample. Rounds after that are as if never asked. The answer
carried along is the last one that wasn't null. A frame's vectors are computed in the first round that uses it (a miss) and found in every later one (a hit).

fold_rounds() does that over a table; framesift.streaming.rounds gives equal rows over a stream, with a state for each sample.

Rows: sample, round (from 1), answer, prob (of the answer's option), has_options, frames (array). A sample's rounds count up to its first
gap; rows repeat no (sample, round). Defined results: null probabilities and null or other answers aren't stable; null frames are none; equal frames in one
round are used as often as they stand there; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.operators.ranking import LETTERS

WINDOW, THRESHOLD = 3, 0.9


def option_letter(answer: Column) -> Column:
    """The answer as an option's letter, or null."""
    said = F.upper(F.trim(answer))
    return F.when(said.isin(*LETTERS), said)


def stable_letter(answer: Column, prob: Column, has_options: Column, threshold: float) -> Column:
    """The answer's letter where the round is stable, else null."""
    return F.when(has_options & (prob > threshold), option_letter(answer))


def stop_rounds(rounds: DataFrame, *, streak: int = WINDOW, threshold: float = THRESHOLD) -> DataFrame:
    """rounds (sample, round, ...) with letter, streak (stable rounds in a row that end here with this answer) and stop (the sample's last round, or null)."""
    order = Window.partitionBy("sample").orderBy("round")
    letter = stable_letter(F.col("answer"), F.col("prob"), F.col("has_options"), threshold)
    rows = rounds.withColumn("letter", letter)
    starts = F.when(F.col("letter").isNull() | ~F.col("letter").eqNullSafe(F.lag("letter").over(order)), 1).otherwise(0)
    rows = rows.withColumn("starts", starts).withColumn("island", F.sum("starts").over(order))
    within = Window.partitionBy("sample", "island").orderBy("round")
    rows = rows.withColumn("streak", F.when(F.col("letter").isNull(), 0).otherwise(F.row_number().over(within)).cast("bigint"))
    ends = F.min(F.when(F.col("streak") >= streak, F.col("round"))).over(Window.partitionBy("sample"))
    return rows.withColumn("stop", ends).drop("starts", "island")


def extracted(rounds: DataFrame, extract: Callable[[Column, Column], Column]) -> DataFrame:
    """rounds with the answer that extract(response, has_options) reads; a blank one is null."""
    return rounds.withColumn("answer", F.nullif(extract(F.col("response"), F.coalesce("has_options", F.lit(False))), F.lit("")))


def fold_rounds(rounds: DataFrame, *, streak: int = WINDOW, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each round that is asked: sample, round, answer (carried), streak, stopped, hits, misses (both so far)."""
    order = Window.partitionBy("sample").orderBy("round")
    own = rounds.select("sample", F.col("round").cast("bigint").alias("round"), "answer", "prob", F.coalesce("has_options", F.lit(False)).alias("has_options"), F.coalesce("frames", F.array().cast("array<bigint>")).alias("frames"))
    own = own.withColumn("place", F.row_number().over(order)).where("place = round")
    kept = stop_rounds(own, streak=streak, threshold=threshold).where("stop IS NULL OR round <= stop")
    uses = kept.select("sample", "round", F.explode("frames").alias("frame")).groupBy("sample", "frame").agg(F.min("round").alias("round"))
    misses = uses.groupBy("sample", "round").agg(F.count(F.lit(1)).alias("new"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    counted = kept.join(misses, ["sample", "round"], "left")
    missed, used = F.sum(F.coalesce("new", F.lit(0))).over(so_far), F.sum(F.size("frames")).over(so_far)
    return counted.select(
        "sample",
        "round",
        F.last("answer", ignorenulls=True).over(so_far).alias("answer"),
        "streak",
        F.col("round").eqNullSafe(F.col("stop")).alias("stopped"),
        (used - missed).cast("bigint").alias("hits"),
        missed.cast("bigint").alias("misses"),
    )


def results(folded: DataFrame) -> DataFrame:
    """A row for each sample: sample, answer ('' where no round had one), rounds_used, stopped, hits, misses (as many as frames are cached)."""
    last = folded.groupBy("sample").agg(F.max(F.struct("round", "answer", "stopped", "hits", "misses")).alias("last"))
    return last.select("sample", F.coalesce("last.answer", F.lit("")).alias("answer"), F.col("last.round").alias("rounds_used"), "last.stopped", "last.hits", "last.misses")
