"""Interval joins of moments to timed segments, without a nested loop.

Time is cut into slots, and slots into a binary hierarchy: a cell of level l spans 2^l slots. A segment of any length is the
disjoint union of at most two cells a level, so one that ends at the far end of time is some 100 rows. A moment looks up the one cell that
holds it on each level that any segment has; with segments of about a slot that is one or two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT = 60.0
#: Slots from here on (either way) count as one; what decides is the exact time.
FAR = float(1 << 52)


def _slot(at: Column, slot: float) -> Column:
    return F.floor(F.greatest(F.lit(-FAR), F.least(F.lit(FAR), at / slot))).cast("bigint")


def cells(first: Column, last: Column) -> Column:
    """The cells (level, cell) whose disjoint union is the slots first..last."""

    def of_level(level: Column) -> Column:
        width = F.pow(F.lit(2.0), level).cast("bigint")
        low, high = F.ceil((first / width)).cast("bigint"), F.floor((last + 1) / width).cast("bigint") - 1
        own = F.array(F.when(F.pmod(low, F.lit(2)) == 1, low), F.when(F.pmod(high, F.lit(2)) == 0, high))
        return F.transform(F.filter(own, lambda c: c.isNotNull() & (low <= high)), lambda c: F.struct(level.alias("level"), c.alias("cell")))

    top = F.ceil(F.log2((last - first + 2).cast("double"))).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), top), of_level))


def match_segments(moments: DataFrame, segments: DataFrame, *, group: str, at: str, start: str = "start_s", end: str = "end_s", seq: str = "seq", text: str = "text", slot: float = SLOT) -> DataFrame:
    """moments plus text of the first segment (by seq) with start <= at < end, '' where there is none.

    Segments without a start, an end or a length match nothing; ends may be infinite. Rows that repeat stay.
    """
    timed = segments.where((F.col(end) > F.col(start)) & ~F.isnan(F.col(start).cast("double")) & ~F.isnan(F.col(end).cast("double")))
    spread = timed.select(
        F.col(group).alias("seg_group"),
        F.col(start).alias("seg_start"),
        F.col(end).alias("seg_end"),
        F.struct(F.col(seq).alias("seq"), F.col(text).alias("text")).alias("seg"),
        F.explode(cells(_slot(F.col(start), slot), _slot(F.col(end), slot))).alias("seg_cell"),
    ).select("*", "seg_cell.level", "seg_cell.cell")
    levels = [r["level"] for r in spread.select("level").distinct().collect()]  # at most 54
    times = moments.select(group, at).distinct()  # equal moments are matched once, and each keeps its row
    own = _slot(F.col(at), slot)
    wide = F.array(*[F.struct(F.lit(n).cast("int").alias("moment_level"), F.shiftright(own, n).alias("moment_cell")) for n in sorted(levels)]) if levels else F.array().cast("array<struct<moment_level:int,moment_cell:bigint>>")
    keyed = times.select(group, at, F.inline(wide))
    on = (F.col(group) == F.col("seg_group")) & (F.col("moment_level") == F.col("level")) & (F.col("moment_cell") == F.col("cell")) & (F.col(at) >= F.col("seg_start")) & (F.col(at) < F.col("seg_end"))
    found = keyed.join(spread, on).groupBy(group, at).agg(F.min("seg").alias("seg"))
    return moments.join(found, [group, at], "left").select(*moments.columns, F.coalesce("seg.text", F.lit("")).alias("subtitle"))


def distinct_texts(matched: DataFrame, *, group: str, at: str) -> DataFrame:
    """group, subtitles: texts of a group in the order of their first moment, each once."""
    first = matched.where(F.col("subtitle") != "").groupBy(group, "subtitle").agg(F.min(at).alias("first_at"))
    return first.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("first_at", "subtitle"))).alias("s")).select(group, F.array_join("s.subtitle", " ").alias("subtitles"))
