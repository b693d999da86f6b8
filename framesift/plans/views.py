"""The test tables as the domain's tables: frames, keywords, samples, responses, moments, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framesift.operators import ranking


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video, frame_id, pos, n, vec: a video for each label."""
    rows = load(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("video"), F.col("vec_id").cast("bigint").alias("frame_id"), F.col("embedding").cast("array<double>").alias("vec"))
    w = Window.partitionBy("video")
    return rows.select("video", "frame_id", (F.row_number().over(w.orderBy("frame_id")) - 1).cast("bigint").alias("pos"), F.count(F.lit(1)).over(w).alias("n"), "vec")


def keywords(spark: SparkSession, sf_dir: str, n: int = 5) -> DataFrame:
    """video, kw_id, vec: the first n vectors of each video."""
    return frames(spark, sf_dir).where(F.col("pos") < n).select("video", F.col("frame_id").alias("kw_id"), "vec")


def sims(spark: SparkSession, sf_dir: str, n: int = 5) -> DataFrame:
    return ranking.similarities(frames(spark, sf_dir), keywords(spark, sf_dir, n))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video, frame_id, pos, n, score: similarity to the first keyword."""
    return sims(spark, sf_dir, 1).select("video", "frame_id", "pos", "n", F.col("sim").alias("score"))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video, n_frames, fps: a video for each user of events."""
    return load(spark, sf_dir, "events").groupBy(F.col("user_id").cast("bigint").alias("video")).agg(F.count(F.lit(1)).alias("n_frames")).withColumn("fps", F.lit(2.5))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, dataset, task_type, options, truth, answer: choices where labels cover a document, else none."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    joined = docs.select("doc_id", "lang", "source").join(labels, "doc_id", "left")
    choice = F.col("quality").isNotNull()
    return joined.select(
        F.col("doc_id").cast("bigint").alias("sample_id"),
        F.col("source").alias("dataset"),
        F.col("lang").alias("task_type"),
        F.when(choice, F.array(F.lit("no"), F.lit("yes"))).alias("options"),
        F.when(choice, F.char(F.col("quality") + 65)).alias("truth"),
        F.when(choice, F.concat(F.lit(" "), F.lower(F.char(F.col("toxic") + 65)))).alias("answer"),
    )


def numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task, truth_number, number: line prices, discounted; line 7 has no number, line 6 a truth of 0."""
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("task"),
        F.when(F.col("l_linenumber") == 6, 0.0).otherwise(F.col("l_extendedprice")).alias("truth_number"),
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("number"),
        F.lit(False).alias("is_mcq"),
        F.lit(None).cast("string").alias("truth"),
        F.lit(None).cast("string").alias("answer"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", F.col("text").alias("response"))


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, video, at_s: events in seconds since 1970."""
    return load(spark, sf_dir, "events").select(F.col("event_id").cast("bigint").alias("event_id"), F.col("user_id").cast("bigint").alias("video"), _seconds().alias("at_s"), "event_type", "props")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video, seq, start_s, end_s, text: from each error event to 20 hours later, at most to the one after the next."""
    errors = moments(spark, sf_dir).where(F.col("event_type") == "error")
    w = Window.partitionBy("video").orderBy("at_s", "event_id")
    last = F.lead("at_s", 2).over(w)
    return errors.select("video", F.row_number().over(w).cast("bigint").alias("seq"), F.col("at_s").alias("start_s"), F.least(F.coalesce(last, F.col("at_s") + 72000), F.col("at_s") + 72000).alias("end_s"), F.col("props").alias("text"))


def _seconds():
    return F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6


#: The same views in SQL, for WITH clauses.
FR = "fr AS (SELECT label::BIGINT AS video, vec_id::BIGINT AS frame_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n, embedding::DOUBLE[] AS vec FROM embeddings)"
KW = "kw AS (SELECT label::BIGINT AS video, vec_id::BIGINT AS kw_id, embedding::DOUBLE[] AS vec FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 5)"
SIMS = f"{FR}, {KW}, sims AS (SELECT fr.video, kw_id, frame_id, pos, n, round(list_dot_product(fr.vec, kw.vec), 9) AS sim FROM fr JOIN kw USING (video))"
SC = f"{SIMS}, sc AS (SELECT video, frame_id, pos, n, sim AS score FROM sims QUALIFY kw_id = min(kw_id) OVER (PARTITION BY video))"
VID = "vid AS (SELECT user_id::BIGINT AS video, count(*) AS n, 2.5::DOUBLE AS fps FROM events GROUP BY 1)"
SAMPLES = "samples AS (SELECT doc_id::BIGINT AS sample_id, source AS dataset, lang AS task_type, quality IS NOT NULL AS is_mcq, chr((quality + 65)::INT) AS truth, chr((toxic + 65)::INT) AS answer FROM documents LEFT JOIN labels USING (doc_id))"
NUMERIC = "numbers AS (SELECT l_returnflag AS task, CASE WHEN l_linenumber = 6 THEN 0.0 ELSE l_extendedprice END::DOUBLE AS g, CASE WHEN l_linenumber <> 7 THEN l_extendedprice * (1 - l_discount) END::DOUBLE AS p FROM lineitem)"
MRA = "CASE WHEN p IS NULL THEN NULL WHEN g = 0 THEN CASE WHEN p = 0 THEN 1.0 ELSE 0.0 END ELSE greatest(0.0, 1 - abs(p - g) / abs(g)) END::DOUBLE"
MOM = "mom AS (SELECT event_id::BIGINT AS event_id, user_id::BIGINT AS video, epoch_us(ts)::DOUBLE / 1000000.0 AS at_s, event_type, props FROM events)"
SEG = f"{MOM}, seg AS (SELECT video, row_number() OVER w AS seq, at_s AS start_s, least(coalesce(lead(at_s, 2) OVER w, at_s + 72000), at_s + 72000) AS end_s, props AS text FROM mom WHERE event_type = 'error' WINDOW w AS (PARTITION BY video ORDER BY at_s, event_id))"
