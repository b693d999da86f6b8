"""Seeded draws without state: hashes of the seed and the row's id, alike in every run, engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int | str, *keys: Column) -> Column:
    """Order by this for a seeded shuffle."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def uniform(seed: int | str, *keys: Column) -> Column:
    """In (0, 1), of 32 bits."""
    return (F.conv(F.substring(digest(seed, *keys), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
