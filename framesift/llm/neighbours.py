"""The next row by id, for tables of any size: one exchange, no global window.

Boundaries between buckets are ids that occur in the table (approximate quantiles). A row
whose id opens a bucket is also sent to the bucket before it, as the successor of that bucket's last
row; the first row of all goes to the last bucket, so that the order is circular. Within a bucket the
order is a window. Buckets hold near-equal counts whatever the ids look like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOWEST = -(2**63)


def boundaries(keys: DataFrame, key: str, buckets: int) -> list[int]:
    """Up to `buckets` ids that occur, ascending, the smallest one first. Reads one column."""
    shares = [i / buckets for i in range(1, buckets)]
    found = keys.agg(F.min(key).alias("least"), F.percentile_approx(key, shares or [0.5], 20 * buckets + 1000).alias("cuts")).head()
    if found["least"] is None:
        return []
    return sorted({found["least"], *(found["cuts"] if shares else [])})


def bucket_of(key: Column, cuts: list[int]) -> Column:
    """Index of the last boundary at or below key: binary search over a literal array."""
    if len(cuts) == 1:
        return F.lit(0)
    array = F.array(*[F.lit(c).cast("long") for c in cuts])
    steps = F.sequence(F.lit(1), F.lit(max(1, len(cuts).bit_length())))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def step(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        return F.when(at["hi"] - at["lo"] <= 1, at).when(F.get(array, mid) <= key, F.struct(mid.alias("lo"), at["hi"].alias("hi"))).otherwise(F.struct(at["lo"].alias("lo"), mid.alias("hi")))

    return F.aggregate(steps, start, step)["lo"]


def with_successors(rows: DataFrame, key: str, tie: list[str], buckets: int | None = None) -> DataFrame:
    """rows plus bucket, at (its place in the bucket, from 1) and guest.

    Guests are the copies that stand for the next bucket's first row; they follow all others of
    their bucket. A null key sorts first. Ties follow `tie`.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("order_key", F.coalesce(F.col(key).cast("long"), F.lit(LOWEST)))
    cuts = boundaries(rows.select("order_key"), "order_key", buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not cuts:
        cuts = [0]
    rows = rows.withColumn("bucket", bucket_of(F.col("order_key"), cuts))
    opens = F.get(F.array(*[F.lit(c).cast("long") for c in cuts]), F.col("bucket")) == F.col("order_key")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    before = F.struct(F.pmod(F.col("bucket") - 1, F.lit(len(cuts))).alias("bucket"), F.lit(True).alias("guest"))
    placed = F.explode(F.when(opens, F.array(own, before)).otherwise(F.array(own))).alias("place")
    rows = rows.select(*[c for c in rows.columns if c != "bucket"], placed).select("*", "place.bucket", "place.guest").drop("place")
    order = Window.partitionBy("bucket").orderBy("guest", "order_key", *tie)
    return rows.withColumn("at", F.row_number().over(order))
