"""Positions on a timeline. Each operator takes rows with a length and gives `pos` rows; no sample meets another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _spread(videos: DataFrame, count: Column) -> DataFrame:
    """One row for each i from 0 to count - 1."""
    return videos.withColumn("i", F.explode(F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1))))


def _distinct(rows: DataFrame, pos: Column, keys: list[str]) -> DataFrame:
    return rows.select(*keys, pos.cast("bigint").alias("pos")).distinct()


def to_fps(videos: DataFrame, fps: float, *, keys: list[str], total: str = "n_frames", source_fps: str = "fps") -> DataFrame:
    """Frames nearest (half to even) to a cursor of fps steps a second; all frames where the source's rate is unknown."""
    if fps <= 0:
        raise ValueError("fps must be above 0")
    step = F.when(F.col(source_fps) > 0, F.greatest(F.col(source_fps) / fps, F.lit(1.0))).otherwise(1.0)
    rows = _spread(videos.withColumn("step", step), F.ceil(F.col(total) / F.col("step")))
    return _distinct(rows.where(F.rint(F.col("i") * F.col("step")) < F.col(total)), F.rint(F.col("i") * F.col("step")), keys)


def every_kth(videos: DataFrame, k: int, *, keys: list[str], total: str = "n_frames") -> DataFrame:
    return _distinct(_spread(videos, F.ceil(F.col(total) / k)), F.col("i") * k, keys)


def uniform(videos: DataFrame, k: int, *, keys: list[str], total: str = "n_frames") -> DataFrame:
    """floor(i n / k); duplicates stay if k > n."""
    rows = _spread(videos, F.lit(k)).where(F.col(total) > 0)
    return rows.select(*keys, "i", F.expr(f"(i * {total}) div {k}").alias("pos"))


def inclusive(videos: DataFrame, k: int, *, keys: list[str], total: str = "n_frames") -> DataFrame:
    """floor(i (n - 1) / (c - 1)) with c = min(k, n): both ends are in."""
    rows = _spread(videos.withColumn("c", F.least(F.lit(k).cast("bigint"), F.col(total))), F.col("c"))
    return _distinct(rows, F.expr(f"case when c > 1 then (i * ({total} - 1)) div (c - 1) else 0 end"), keys)


def midpoints(videos: DataFrame, k: int, *, keys: list[str], total: str = "n_frames") -> DataFrame:
    """floor(i s + s / 2) with s = n / k."""
    rows = _spread(videos.where(F.col(total) > 0), F.lit(k))
    s = F.col(total) / F.lit(float(k))
    return _distinct(rows, F.least(F.floor(F.col("i") * s + s / 2), F.col(total) - 1), keys)


def linspace(videos: DataFrame, k: int, *, keys: list[str], total: str = "n_frames", rounded: bool = True) -> DataFrame:
    """k points from 0 to n - 1, rounded half to even or truncated."""
    x = F.col("i") * (F.col(total) - 1) / F.lit(float(max(1, k - 1)))
    rows = _spread(videos.where(F.col(total) > 0), F.lit(k))
    return _distinct(rows, F.rint(x) if rounded else F.floor(x), keys)


def time_bins(frames: DataFrame, bins: int, *, keys: list[str], pos: str = "pos", total: str = "n_frames") -> DataFrame:
    """The bins (of `bins`) that hold a frame."""
    at = F.coalesce(F.try_divide(F.col(pos), F.col(total) - 1), F.lit(0.0)) * (bins - 1)
    return frames.select(*keys, F.rint(at).cast("bigint").alias("bin")).distinct()


#: Positions of one bitmap.
BITMAP_BINS = 32_768


def rasters(frames: DataFrame, spine: DataFrame, bins: int, *, keys: list[str], pos: str = "pos", total: str = "n_frames") -> DataFrame:
    """A row for each row of spine (keys): keys, bits (a bitmap of the bins that hold a frame), filled (how many do). Samples without a frame have none set.

    Bins are summed up as bitmaps, first per task: what is exchanged is at most 4 KB for each sample and task, however many frames there are.
    """
    if not 0 < bins <= BITMAP_BINS:
        raise ValueError(f"bins must be from 1 to {BITMAP_BINS}")
    at = F.coalesce(F.try_divide(F.col(pos), F.col(total) - 1), F.lit(0.0)) * (bins - 1)
    marked = frames.groupBy(*keys).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.rint(at).cast("bigint") + 1)).alias("bits"))
    found = spine.select(*keys).distinct().join(marked, keys, "left")
    return found.select(*keys, "bits", F.coalesce(F.bitmap_count("bits"), F.lit(0)).cast("bigint").alias("filled"))


def dense(bits: Column, bins: int) -> Column:
    """A bitmap as an array of 0 and 1, all 0 for null."""

    def bit(i: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bits, F.shiftright(i, 3) + 1, F.lit(1))), 16, 10).cast("int")
        return F.coalesce(F.getbit(byte, i % 8).cast("int"), F.lit(0))

    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), bit)


def bin_densities(rastered: DataFrame, bins: int, *, by: list[str]) -> DataFrame:
    """by, bin, density: the share of samples that have a frame in a bin."""
    spread = rastered.select(*by, F.posexplode(dense(F.col("bits"), bins)).alias("bin", "bit"))
    return spread.groupBy(*by, F.col("bin").cast("bigint").alias("bin")).agg(F.round(F.avg("bit"), 6).alias("density"))


def schedule(videos: DataFrame, step: int, *, keys: list[str], total: str = "n_frames") -> DataFrame:
    """Round sizes step, 2 step, ... with the total as the last."""
    rounds = F.when(F.col(total) > 0, F.concat(F.when(F.col(total) > step, F.sequence(F.lit(step).cast("bigint"), F.col(total) - 1, F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>")), F.array(F.col(total))))
    return videos.select(*keys, F.posexplode(rounds).alias("round_idx", "n_used")).select(*keys, F.col("round_idx").cast("bigint").alias("round_idx"), "n_used")


def pool_to_fps(pools: DataFrame, fps: float, *, keys: list[str], total: str = "n_frames", source_fps: str = "fps") -> DataFrame:
    """to_fps over the places of a pool that is sampled already; a pool of unknown rate is taken to have the wanted one."""
    known = F.coalesce(F.when(F.col(source_fps) > 0, F.col(source_fps)), F.lit(float(fps)))
    return to_fps(pools.withColumn(source_fps, known), fps, keys=keys, total=total, source_fps=source_fps)


def grid_at_fps(videos: DataFrame, fps: float, *, keys: list[str], total: str = "n_frames", source_fps: str = "fps") -> DataFrame:
    """floor(n / source x fps) points, each at its own time, rounded half to even and cut to the last frame."""
    rows = _spread(videos, F.floor(F.col(total) / F.col(source_fps) * fps))
    return _distinct(rows, F.least(F.rint(F.col("i") / fps * F.col(source_fps)), F.col(total) - 1), keys)


def at_stride(videos: DataFrame, fps: float, *, keys: list[str], total: str = "n_frames", source_fps: str = "fps", default_fps: float = 30.0) -> DataFrame:
    """Every k-th frame with k = round(source / fps), half to even, at least 1."""
    source = F.coalesce(F.when(F.col(source_fps) > 0, F.col(source_fps)), F.lit(default_fps))
    rows = videos.withColumn("stride", F.greatest(F.rint(source / fps), F.lit(1.0)).cast("bigint"))
    return _distinct(_spread(rows, F.ceil(F.col(total) / F.col("stride"))), F.col("i") * F.col("stride"), keys)


def caption_frame(caption: Column, n_captions: Column, n_frames: Column) -> Column:
    """Frame of a caption counted from 1: captions lie evenly from the first to the last frame; rounded half to even."""
    place = (caption - 1) / F.greatest(n_captions - 1, F.lit(1)) * F.greatest(n_frames - 1, F.lit(0))
    return F.when(n_captions <= 1, F.lit(0).cast("bigint")).otherwise(F.rint(place).cast("bigint"))


def scaled_size(width: Column, height: Column, scale: Column) -> Column:
    """struct(width, height) after scaling, at least 1 each."""
    return F.struct(*[F.greatest(F.rint(side * scale), F.lit(1.0)).cast("bigint").alias(name) for name, side in (("width", width), ("height", height))])


def bounded_size(width: Column, height: Column, edge: Column) -> Column:
    """struct(width, height) scaled down, truncated, so that the longer side is at most edge; as it is where there is no edge or it fits."""
    scale = edge / F.greatest(width, height).cast("double")
    small = F.struct(*[F.greatest(F.floor(side * scale), F.lit(1)).cast("bigint").alias(name) for name, side in (("width", width), ("height", height))])
    return F.when(edge < F.greatest(width, height), small).otherwise(F.struct(width.cast("bigint").alias("width"), height.cast("bigint").alias("height")))


def tokens_per_frame(n_frames: Column, *, context: int, reserve: int) -> Column:
    """Whole tokens of a context that are left for each frame."""
    return F.floor(F.lit(context - reserve) / F.greatest(n_frames, F.lit(1))).cast("bigint")
