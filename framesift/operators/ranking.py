"""Windows over a sample's frames. A partition is one sample's pool, which its length bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions.vectors import dot

#: Letters of answers that can end a sample early.
LETTERS = ("A", "B", "C", "D")


def by_sample(*order, sample: str = "video"):
    w = Window.partitionBy(sample)
    return w.orderBy(*order) if order else w


def best_first(sample: str = "video", score: str = "score", tie: str = "frame_id"):
    return Window.partitionBy(sample).orderBy(F.col(score).desc(), F.col(tie))


def similarities(frames: DataFrame, keywords: DataFrame, *, sample: str = "video", digits: int = 9) -> DataFrame:
    """sample, kw_id, frame_id, pos, n, sim: every keyword of a sample with every frame of it. Joined on the sample, never across."""
    both = frames.alias("f").join(keywords.alias("k"), sample)
    return both.select(sample, "k.kw_id", "f.frame_id", "f.pos", "f.n", F.round(dot(F.col("f.vec"), F.col("k.vec")), digits).alias("sim"))


def rank_frames(scored: DataFrame, *, sample: str = "video") -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(best_first(sample)).cast("bigint"))


def min_max(scored: DataFrame, *, sample: str = "video", out: str = "scaled") -> DataFrame:
    """Scaled to 0..1 within the sample; 0 where all scores are equal."""
    w = by_sample(sample=sample)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scored.withColumn(out, F.coalesce(F.try_divide(F.col("score") - low, high - low), F.lit(0.0)))


def cumulative_share(scored: DataFrame, *, sample: str = "video") -> DataFrame:
    """cdf of scores shifted to a minimum of 0, by position; uniform where they are all equal."""
    w, along = by_sample(sample=sample), by_sample("pos", sample=sample).rowsBetween(Window.unboundedPreceding, 0)
    shifted = scored.withColumn("mass", F.col("score") - F.min("score").over(w))
    total = F.sum("mass").over(w)
    uniform = (F.col("pos") + 1) / F.count(F.lit(1)).over(w)
    return shifted.withColumn("cdf", F.when(total > 0, F.sum("mass").over(along) / total).otherwise(uniform))


def log_softmax(scored: DataFrame, *, temperature: float = 1.0, sample: str = "video") -> DataFrame:
    w = by_sample(sample=sample)
    x = F.col("score") / temperature
    top = F.max(x).over(w)
    return scored.withColumn("log_prob", x - top - F.ln(F.sum(F.exp(x - top)).over(w)))


def adjacent_similarity(frames: DataFrame, *, sample: str = "video") -> DataFrame:
    before = F.lag("vec").over(by_sample("pos", sample=sample))
    return frames.withColumn("cos_sim", F.round(dot(F.col("vec"), before), 9)).where(F.col("pos") > 0).select(sample, "pos", "cos_sim")


def largest_remainder(shares: DataFrame, budget: int | Column, *, group: list[str], key: str, weight: str = "weight", out: str = "quota") -> DataFrame:
    """Integers near budget x weight that sum to the budget: floors first, then one each by largest fraction, ties by key."""
    exact = F.round(F.col(weight) * budget, 9)
    w = Window.partitionBy(*group)
    shares = shares.withColumn("floored", F.floor(exact)).withColumn("fraction", F.round(exact - F.floor(exact), 9))
    left = budget - F.sum("floored").over(w)
    rank = F.row_number().over(w.orderBy(F.col("fraction").desc(), key))
    return shares.withColumn(out, (F.col("floored") + F.when(rank <= left, 1).otherwise(0)).cast("bigint")).drop("floored", "fraction")


def carry_forward(rows: DataFrame, value: str, *, group: str, order: str, out: str) -> DataFrame:
    """Last value that isn't null, so far."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(w))


def early_stop(rounds: DataFrame, *, sample: str, order: str, answer: str, prob: str, threshold: float, streak: int, has_options: str | None = None, letters: tuple[str, ...] = LETTERS) -> DataFrame:
    """sample, stop_round: the first round that ends `streak` rounds in a row with one answer above threshold; null if none.

    Only answers that are one of letters count, and only those of samples with options where a column says which have them.
    """
    w = Window.partitionBy(sample).orderBy(order)
    said = F.upper(F.trim(F.col(answer)))
    sure = F.coalesce((F.col(prob) > threshold) & said.isin(*letters) & (F.col(has_options) if has_options else F.lit(True)), F.lit(False))
    rows = rounds.select(sample, order, F.when(sure, said).alias("said"))
    goes_on = F.coalesce(F.lag("said").over(w) == F.col("said"), F.lit(False))
    islands = rows.withColumn("island", F.sum(F.when(goes_on, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.sum(F.when(F.col("said").isNotNull(), 1).otherwise(0)).over(Window.partitionBy(sample, "island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return islands.withColumn("length", length).groupBy(sample).agg(F.min(F.when(F.col("length") >= streak, F.col(order))).alias("stop_round"))


def first_use(uses: DataFrame, *, keys: list[str], order: str) -> DataFrame:
    """cache_miss is 1 at a key's first use, else 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    return uses.withColumn("cache_miss", (F.row_number().over(w) == 1).cast("bigint"))
