"""Lookups: first by key, first existing of candidates, cache state, parameter grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def first_by_key(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key with its smallest value: the first root wins where values are ordered."""
    return rows.groupBy(key).agg(F.min(value).alias(value))


def first_existing(wanted: DataFrame, there: DataFrame, *, key: str, candidates: str, path: str) -> DataFrame:
    """key and the first of its candidates that exists; keys without one are left out."""
    spread = wanted.select(key, F.posexplode(candidates).alias("place", path))
    return spread.join(there.select(path).distinct(), path, "left_semi").groupBy(key).agg(F.min_by(path, "place").alias(path))


def missing(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Rows still to do: what a resumed run leaves after those that are done."""
    return wanted.join(cached.select(key), key, "left_anti")


def cache_state(wanted: DataFrame, cached: DataFrame, key: str, value: str) -> DataFrame:
    """state: hit, empty (an entry without content) or miss. Of several entries with a key one with content counts, the least of them."""
    entries = cached.groupBy(key).agg(F.min(F.struct((~F.coalesce(F.size(value) > 0, F.lit(False))).alias("bare"), *[c for c in cached.columns if c != key])).alias("entry"))
    joined = wanted.join(entries, key, "left")
    state = F.when(F.col("entry").isNull(), "miss").when(F.col("entry.bare"), "empty").otherwise("hit")
    return joined.select(*wanted.columns, *[F.col(f"entry.{c}").alias(c) for c in cached.columns if c != key], state.alias("state"))


def step_lookup(values: DataFrame, steps: DataFrame, *, by: list[str], value: str, step: str, out: str, last: bool = True) -> DataFrame:
    """values plus `out` of the greatest step not above their value; where none fits that of the least step (last), or null.

    An as-of join: steps (by, step, out) and values stand in one order, and each value takes the step before it. No value meets every step. Null values
    have no step; of equal steps the least `out` counts.
    """
    w = Window.partitionBy(*by).orderBy("_at", "_kind")
    both = steps.groupBy(*by, F.col(step).alias("_at")).agg(F.min(out).alias("_step")).withColumn("_kind", F.lit(0))
    rows = values.withColumn("_at", F.col(value)).withColumn("_kind", F.lit(1))
    together = both.unionByName(rows, allowMissingColumns=True)
    before = F.last("_step", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    least = F.first("_step", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = together.withColumn(out, F.when(F.col("_at").isNotNull(), F.coalesce(before, least) if last else before))
    return found.where("_kind = 1").select(*values.columns, out)


def require_cached(state: DataFrame, key: str, examples: int = 5) -> DataFrame:
    """For read-only caches: raises where a row isn't a hit."""
    lacking = [r[key] for r in state.where(F.col("state") != "hit").select(key).limit(examples).collect()]
    if lacking:
        raise LookupError(f"no cache entry for {key} {lacking} (first {examples} at most)")
    return state


def parameter_grid(spark: SparkSession, **values: list) -> DataFrame:
    """Every combination of the given values."""
    columns = [spark.createDataFrame([(v,) for v in found], [name]) for name, found in values.items()]
    return reduce(lambda a, b: a.crossJoin(b), columns)


def value_grid(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Every combination of the values that the columns take in rows (nulls are none). The values are few: each column's are gathered, and spread out."""
    sets = rows.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in columns])
    for c in columns:
        sets = sets.withColumn(c, F.explode(c))
    return sets


def missing_configurations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The combinations of value_grid that no row has."""
    return value_grid(rows, columns).join(rows.select(*columns).distinct(), columns, "left_anti")


def pick_by_index(rows: DataFrame, values: str, at: str) -> DataFrame:
    """Adds picked: the value at a place counted from one; rows with a place outside are dropped."""
    return rows.where((F.col(at) >= 1) & (F.col(at) <= F.size(values))).withColumn("picked", F.get(F.col(values), (F.col(at) - 1).cast("int")))


def dimension(rows: DataFrame, table: DataFrame, key: str, *, examples: int = 5) -> DataFrame:
    """Exact lookup that raises for unknown keys."""
    unknown = [r[key] for r in rows.select(key).distinct().join(table, key, "left_anti").limit(examples).collect()]
    if unknown:
        raise LookupError(f"unknown {key}: {unknown}")
    return rows.join(table, key)


def verify(wanted: DataFrame, there: DataFrame, keys: list[str], *, by: list[str], examples: int = 5) -> DataFrame:
    """by, found, missing, missing_examples (the first by key, as text): which rows of wanted have their keys in there."""
    marked = wanted.join(there.select(*keys).distinct().withColumn("is_there", F.lit(True)), keys, "left")
    shown = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    counted = marked.groupBy(*by).agg(F.count("is_there").alias("found"), F.count_if(F.col("is_there").isNull()).alias("missing"))
    gone = marked.where("is_there IS NULL").select(*by, shown.alias("shown")).distinct()
    place = F.row_number().over(Window.partitionBy(*[F.col(b) for b in by]).orderBy("shown"))
    first = gone.withColumn("place", place).where(F.col("place") <= examples).groupBy(*[F.col(b).alias(f"of_{b}") for b in by]).agg(F.array_sort(F.collect_list("shown")).alias("missing_examples"))
    same = [F.col(b).eqNullSafe(F.col(f"of_{b}")) for b in by]
    none = F.array().cast("array<string>")
    return counted.join(first, same, "left").select(*by, "found", "missing", F.coalesce("missing_examples", none).alias("missing_examples"))
