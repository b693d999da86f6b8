"""Names without collisions: base, base_1, base_2, ... each row the first that no earlier row has taken, as if row by row.

Which rows collide isn't local: the second `a` becomes `a_1`, unless a row earlier still is called `a_1` itself, and so on. The rule is a serial
dictatorship, so its result is the only stable matching of rows and names in which every name prefers the earliest row. It is found by
proposals of all rows at once: each proposes the first name it may still get, each name keeps its earliest proposer, and the others go one name on,
with the later rows of their base behind them. The rounds are as many as the longest chain of names that stand in each other's way, few
however large the table; each round is stored.

Defined results: a null base is `unknown`; rows that repeat both order and base get one name; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framesift.session import stored


def unique_names(rows: DataFrame, base: str, order: list[str], *, out: str = "name", suffix: str = "") -> DataFrame:
    """rows plus `out`, base with a number where that is taken, and suffix. order: columns that say which row comes first."""
    place = F.struct(*[F.col(c) for c in order], F.coalesce(F.col(base), F.lit("unknown")).alias("_base")).alias("place")
    state = rows.select(place, F.coalesce(F.col(base), F.lit("unknown")).alias("base")).distinct()
    among = Window.partitionBy("base").orderBy("place")
    # A row's number is above those of the earlier rows of its base, so that its place among them is a lower bound.
    state = stored(state.withColumn("r", F.row_number().over(among) - 1).withColumn("k", F.col("r")))
    while True:
        named = state.withColumn("name", F.when(F.col("k") == 0, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("k").cast("string"))))
        held = named.withColumn("lost", (F.row_number().over(Window.partitionBy("name").orderBy("place")) > 1).cast("int"))
        if held.where("lost = 1").isEmpty():
            break
        # The losers go on, and push those behind them.
        moved = F.max(F.col("k") + F.col("lost") - F.col("r")).over(among) + F.col("r")
        state = stored(held.withColumn("k", moved).select("place", "base", "r", "k"))
    found = named.select("place", F.concat("name", F.lit(suffix)).alias(out))
    return rows.withColumn("place", place).join(found, "place").drop("place")
