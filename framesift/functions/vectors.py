"""Vectors as arrays. Cast to double before arithmetic, so that sums don't depend on the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    size = F.greatest(norm(a), F.lit(EPS))
    return F.transform(a, lambda x: x.cast("double") / size)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(EPS))


def scaled_cosine(a: Column, b: Column, log_scale: float) -> Column:
    """exp(log_scale) x dot of unit vectors."""
    return F.exp(F.lit(float(log_scale))) * dot(a, b)


def first_run(values: Column, wanted: Column, *, last: bool = False) -> Column:
    """struct(start, end) of the first (or last) place where `wanted` stands in `values`; null where it doesn't or is empty."""
    n, m = F.size(values), F.size(wanted)
    starts = F.when((m > 0) & (n >= m), F.filter(F.sequence(F.lit(0), n - m), lambda i: F.slice(values, i + 1, m) == wanted))
    at = F.get(starts, F.size(starts) - 1) if last else F.get(starts, F.lit(0))
    return F.when(at.isNotNull(), F.struct(at.alias("start"), (at + m).alias("end")))


def mean_probability(log_probs: Column) -> Column:
    """exp of the mean; null for none, 0 where one is -infinity."""
    return F.exp(F.aggregate(log_probs, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(log_probs), F.lit(0)))


def score_map(names: Column, scores: Column) -> Column:
    return F.map_from_arrays(names, scores)
