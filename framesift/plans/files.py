"""Names and indexes of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesift.operators import naming
from framesift.plans import register
from framesift.plans.views import load


@register(
    "unique_file_names",
    """WITH RECURSIVE given AS (
  SELECT s_suppkey::BIGINT AS sample, 'v' || (s_nationkey % 4) || CASE WHEN s_suppkey % 3 = 0 THEN '_' || (s_suppkey % 5) ELSE '' END AS base, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier
),
size AS (SELECT count(*) AS n FROM supplier),
step AS (
  SELECT i, sample, base AS name, [base] AS taken FROM given WHERE i = 1
  UNION ALL
  SELECT g.i, g.sample, x.name, list_append(s.taken, x.name) FROM step s JOIN given g ON g.i = s.i + 1, size,
    LATERAL (SELECT [c FOR c IN list_concat([g.base], [g.base || '_' || k FOR k IN range(1, size.n + 1)]) IF NOT list_contains(s.taken, c)][1] AS name) x
)
SELECT sample, name || '.pt' AS file FROM step""",
)
def unique_names(spark, sf_dir):
    """Suppliers as videos, in order; their names repeat, and some look like numbered ones."""
    key = F.col("s_suppkey").cast("bigint")
    base = F.concat(F.lit("v"), (F.col("s_nationkey") % 4).cast("string"), F.when(key % 3 == 0, F.concat(F.lit("_"), (key % 5).cast("string"))).otherwise(""))
    rows = load(spark, sf_dir, "supplier").select(key.alias("sample"), base.alias("base"))
    return naming.unique_names(rows, "base", ["sample"], out="file", suffix=".pt").select("sample", "file")
