"""Mixing sources to target weights.

Words are counted per source, targets come from the weights by water filling, and each
source's repetition rate is its target over its size. A document is emitted floor(rate)
times, and once more where a hash of its id and the seed falls below the fraction.

Defined results: a null text has size 0; a null source is a source of its own, after all
others; sources whose size is 0 have target 0 and emit nothing; a null id hashes as the empty string,
and rows that repeat an id draw alike. An empty table gives an empty result. Extra
columns are carried along by emit_copies() only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm.common import intake, n_words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEAT = 2.0
#: Up to so many sources the plan is collected and broadcast (a few dozen bytes each); beyond it, joined.
BROADCAST_SOURCES = 50_000


def source_plan(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """One row per source: source, source_size, target, rate.

    Water filling in closed form. With sources by cap/weight, level_i is what would be left
    per unit of weight if those before i stopped at their caps; the level is the largest one.
    The windows run over one row per source, after the aggregation.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(max_repeat)).alias("cap"))
    everything = Window.partitionBy(F.lit(1))
    by_need = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - before) / rest)
    per = per.withColumn("target", F.least("cap", F.max("level").over(everything) * F.col("weight")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return per.select("source", "source_size", "target", rate.alias("rate"))


def draw(key: Column, seed: str) -> Column:
    """Uniform in [0, 1) from 52 bits of a hash of the seed and the key; the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_repeat: float = MAX_REPEAT,
    seed: str = "mix",
    broadcast_sources: int = BROADCAST_SOURCES,
) -> DataFrame:
    """Every document with its copies: id, size, source, source_size, target, rate, copies, taken.

    Two passes over the documents and no shuffle of them: word counts are summed per source
    (partial sums first), and the plan, one row per source, is broadcast after its size is checked.
    More sources than that are joined, and Spark splits a hot source's rows.
    """
    plan, dealt = _dealt(docs, id_col, text_col, source_col, weights, share, max_repeat, seed, broadcast_sources, keep=False)
    return dealt.select("id", "size", "source", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def emit_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT, seed: str = "mix", broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it has copies, with all their columns."""
    _, dealt = _dealt(docs, id_col, text_col, source_col, weights, share, max_repeat, seed, broadcast_sources, keep=True)
    copied = dealt.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return copied.select(*[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _dealt(docs, id_col, text_col, source_col, weights, share, max_repeat, seed, broadcast_sources, keep):
    rows = intake(docs, id=(id_col, "string"), source=(source_col, "string"), text=(text_col, "string"))
    if keep:
        whole = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")
        rows = docs.select(docs[id_col].cast("string").alias("id"), docs[source_col].cast("string").alias("source"), docs[text_col].cast("string").alias("text"), whole)
    sized = rows.withColumn("size", n_words(F.col("text"))).drop("text")
    plan = source_plan(sized.select("source", "size"), weights, share, max_repeat)
    found = plan.limit(broadcast_sources + 1).collect()
    if len(found) <= broadcast_sources:
        plan = F.broadcast(docs.sparkSession.createDataFrame(found, plan.schema))
    plan = plan.withColumnRenamed("source", "plan_source")
    joined = sized.join(plan, sized["source"].eqNullSafe(plan["plan_source"]), "left")
    whole_copies = F.floor("rate")
    extra = F.when(draw(F.col("id"), seed) < F.col("rate") - whole_copies, 1).otherwise(0)
    return plan, joined.withColumn("copies", (whole_copies + extra).cast("long"))


def query(spark, sf_dir):
    from framesift.llm.common import table

    docs = table(spark, sf_dir, "documents")
    mixed = mix_sources(docs)
    return mixed.select(F.col("id").cast("long").alias("doc_id"), "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT] AS weight FROM per
), levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
      / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), plan AS (
  SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM levels
), rated AS (
  SELECT d.doc_id, d.size, p.source_size, p.target,
         CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('mix|' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""
