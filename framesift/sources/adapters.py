"""Benchmark annotation tables to samples.

A sample is (sample_id, video_path, question, answer, options, task_type, metadata, preprocess_key). Each
adapter is columns over the raw table; rows without a question, an answer or what else they need are dropped.
Raw rows may lack optional columns.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.functions import answers, texts

SAMPLE = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("video_path", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("options", T.ArrayType(T.StringType())),
        T.StructField("task_type", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("preprocess_key", T.StringType()),
    ]
)
BUCKETS = ("short", "medium", "long")


def _col(raw: DataFrame, *names: str) -> Column:
    """First of the columns that isn't blank; null where none is there."""
    there = [F.nullif(F.trim(raw[n].cast("string")), F.lit("")) for n in names if n in raw.columns]
    return F.coalesce(*there, F.lit(None).cast("string"))


def _options(raw: DataFrame, *names: str) -> Column:
    there = [raw[n].cast("array<string>") for n in names if n in raw.columns]
    return F.coalesce(*there, F.lit(None).cast("array<string>"))


def _trimmed(options: Column) -> Column:
    """Trimmed, without blank ones."""
    return F.filter(F.transform(options, lambda o: F.trim(o)), lambda o: F.coalesce(o, F.lit("")) != "")


def _numbered(raw: DataFrame, prefix: str, n: int) -> Column:
    """option0.. as an array, without blanks and N/A."""
    own = [F.trim(raw[f"{prefix}{i}"].cast("string")) for i in range(n) if f"{prefix}{i}" in raw.columns]
    kept = F.filter(F.array(*own) if own else F.array().cast("array<string>"), lambda o: o.isNotNull() & (o != "") & (F.upper(o) != "N/A"))
    return F.nullif(kept, F.array().cast("array<string>"))


def _sample(raw: DataFrame, *, id_: Column, path: Column, question: Column, answer: Column, options: Column, task: Column, key: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    extra = [F.lit(x) if i % 2 == 0 else raw[x].cast("string") for n in keep if n in raw.columns for i, x in enumerate((n, n))]
    metadata = F.create_map(*extra) if extra else F.create_map().cast("map<string,string>")
    rows = raw.select(
        id_.alias("sample_id"),
        path.alias("video_path"),
        question.alias("question"),
        answer.alias("answer"),
        options.alias("options"),
        task.alias("task_type"),
        metadata.alias("metadata"),
        F.coalesce(key if key is not None else F.lit(None).cast("string"), id_).alias("preprocess_key"),
    )
    return rows.where(F.col("question").isNotNull() & F.col("answer").isNotNull() & F.col("video_path").isNotNull())


def _id(raw: DataFrame, prefix: str, *names: str, prefixed: bool = False) -> Column:
    """The first of the columns that isn't blank, else `{prefix}_{place}`: the row's source_index, or a hash of its question where there is no such column.

    prefixed: the prefix stands before the column's value too.
    """
    own, place = _col(raw, *names), F.coalesce(_col(raw, "source_index"), F.md5(_col(raw, "question")))
    return F.concat(F.lit(f"{prefix}_"), F.coalesce(own, place)) if prefixed else F.coalesce(own, F.concat(F.lit(f"{prefix}_"), place))


def vsibench(raw: DataFrame) -> DataFrame:
    options = _options(raw, "options")
    task = F.when(F.size(options) > 0, "mcq").otherwise("numeric")
    return _sample(raw, id_=_id(raw, "vsibench"), path=F.concat(_col(raw, "scene_name"), F.lit(".mp4")), question=_col(raw, "question"), answer=_col(raw, "ground_truth"), options=F.when(F.size(options) > 0, options), task=task, keep=("dataset", "task_type", "question_type"))


def videomme(raw: DataFrame) -> DataFrame:
    bucket = F.lower(_col(raw, "duration"))
    bucket = F.when(bucket.isin(*BUCKETS), bucket).otherwise(BUCKETS[0])
    said = F.upper(_col(raw, "answer"))
    answer = F.coalesce(answers.letter(said, "A-E"), said)
    raw = raw.where(F.size(_trimmed(_options(raw, "options"))) > 0)
    return _sample(raw, id_=_id(raw, "videomme", "question_id"), path=_col(raw, "videoID", "video_id", "video"), question=_col(raw, "question"), answer=answer, options=_trimmed(_options(raw, "options")), task=bucket, keep=("domain", "sub_category", "task_type"))


def longvideobench(raw: DataFrame) -> DataFrame:
    index = _col(raw, "correct_choice").try_cast("int")
    said = F.upper(_col(raw, "correct_choice"))
    letter = F.coalesce(F.when(index.between(0, 25), F.char(index + 65)), F.when(index.isNull(), answers.letter(said, "A-E")), said)
    raw = raw.where(_numbered(raw, "option", 5).isNotNull())
    task = F.coalesce(_col(raw, "duration_group", "question_category"), F.lit("mcq"))
    return _sample(raw, id_=_id(raw, "lvb", "id"), path=_col(raw, "video_path"), question=_col(raw, "question"), answer=letter, options=_numbered(raw, "option", 5), task=task, key=_col(raw, "video_id"), keep=("question_category", "topic_category", "subtitle_path", "starting_timestamp_for_subtitles", "duration"))


def longvideobench_filter(rows: DataFrame, wanted: str, *, strict: bool = False) -> DataFrame:
    """By duration group or category. strict: a category matches only where it is the task type itself."""
    if wanted.lower() == "all":
        return rows
    by_category = F.col("metadata")["question_category"] == wanted
    return rows.where(F.col("task_type") == wanted) if strict else rows.where((F.col("task_type") == wanted) | F.coalesce(by_category, F.lit(False)))


def mlvu(raw: DataFrame) -> DataFrame:
    options = _trimmed(_options(raw, "candidates", "options"))
    has = F.size(options) > 0
    answer = F.when(has, F.coalesce(answers.choice_letter(_col(raw, "answer"), options), _col(raw, "answer"))).otherwise(_col(raw, "answer"))
    task = F.coalesce(_col(raw, "question_type", "task_type"), F.when(has, "mcq").otherwise("generation"))
    return _sample(raw, id_=_id(raw, "mlvu", "question_id"), path=_col(raw, "video"), question=_col(raw, "question"), answer=answer, options=F.when(has, options), task=task, keep=("duration", "_split", "_format"))


def nextqa(raw: DataFrame) -> DataFrame:
    own = F.array(*[F.trim(raw[f"a{i}"].cast("string")) for i in range(5)])
    complete = F.forall(own, lambda o: o.isNotNull() & (o != ""))
    video = texts.whole_number_text(_col(raw, "video"))
    rows = raw.where(complete)
    return _sample(rows, id_=_id(rows, "nextqa", "qid", prefixed=True), path=F.concat(video, F.lit(".mp4")), question=_col(rows, "question"), answer=answers.normalize_choice(_col(rows, "answer")), options=own, task=F.lit("mcq"), key=F.concat(F.lit("nextqa_video_"), video), keep=("type",))


def egoschema(raw: DataFrame) -> DataFrame:
    """Ids are egoschema_{source_index}, or of the question's own index where the rows carry no place."""
    lists = [F.when(F.size(o) > 0, F.transform(o, lambda x: F.trim(x))) for o in (_options(raw, "options"), _options(raw, "option"))]
    own = [F.trim(raw[f"option{i}"].cast("string")) for i in range(5) if f"option{i}" in raw.columns]
    single = F.filter(F.array(*own), lambda o: F.coalesce(o, F.lit("")) != "") if own else F.array().cast("array<string>")
    options = F.coalesce(*lists, F.nullif(single, F.array().cast("array<string>")))
    id_ = _id(raw, "egoschema", "source_index", "question_idx", prefixed=True)
    return _sample(raw, id_=id_, path=F.concat(_col(raw, "video_id", "video_uid", "video_idx", "q_uid", "uid", "id"), F.lit(".mp4")), question=_col(raw, "question"), answer=answers.normalize_choice(_col(raw, "answer", "ground_truth")), options=options, task=F.when(F.size(options) > 0, "mcq").otherwise("numeric"))


REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {
    "egoschema": egoschema,
    "longvideobench": longvideobench,
    "mlvu": mlvu,
    "nextqa": nextqa,
    "videomme": videomme,
    "vsibench": vsibench,
}


def supported() -> list[str]:
    return sorted(REGISTRY)


def adapter(dataset: str) -> Callable[[DataFrame], DataFrame]:
    """By name, case ignored."""
    if dataset.lower() not in REGISTRY:
        raise ValueError(f"unknown dataset {dataset!r}; known: {', '.join(supported())}")
    return REGISTRY[dataset.lower()]


#: Fixed names of a data set's splits, by the name under which each is stored.
SPLITS = {
    "longvideobench": {"validation": ["validation", "val"]},
    "mlvu": {"dev": ["dev", "train", "validation", "val"], "test": ["test", "testset"]},
}


def split_name(dataset: str, split: str) -> str:
    """The stored split that a name means (case and blanks around it ignored); ValueError for names that the data set doesn't know.

    A data set without listed splits takes any name.
    """
    wanted, known = split.strip().lower(), SPLITS.get(dataset.strip().lower())
    if known is None:
        return wanted
    for stored, names in known.items():
        if wanted in names:
            return stored
    raise ValueError(f"{dataset} has no split {split!r}; it has: {', '.join(sorted(known))}")


def dataset_root(dataset: str, roots: dict[str, str], settings: Mapping[str, str], setting: str) -> str:
    """The folder of a data set, by name (case ignored). Where settings (such as os.environ) hold the named one, roots are below it."""
    key = dataset.strip().lower()
    if key not in roots:
        raise ValueError(f"no root is known for {dataset!r}; known: {', '.join(sorted(roots))}")
    base = settings.get(setting)
    return f"{base.rstrip('/')}/{roots[key].lstrip('/')}" if base and "://" not in roots[key] else roots[key]


def read_samples(spark: SparkSession, dataset: str, path: str, format_: str = "parquet") -> DataFrame:
    """A table of annotations as samples. Formats: parquet, csv, json (one array or a file each) or jsonl."""
    if format_ == "parquet":
        raw = spark.read.parquet(path)
    elif format_ == "csv":
        raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    else:
        raw = spark.read.json(path, multiLine=format_ == "json")
    return adapter(dataset)(raw)


def read_either(spark: SparkSession, dataset: str, json_path: str, parquet_path: str) -> DataFrame:
    """Samples of the JSON array where it exists, else of the Parquet table."""
    chosen = first_readable(spark, [json_path, parquet_path])
    return read_samples(spark, dataset, chosen, "json" if chosen == json_path else "parquet")


def read_directory_of_arrays(spark: SparkSession, pattern: str, prefix: str = "dev") -> DataFrame:
    """JSON arrays, one a file, with question_id `{prefix}_{file}_{place}` where a row has none.

    A file's array is one value until its places are numbered, so that they don't depend on how a scan is run again.
    """
    files = spark.read.text(pattern, wholetext=True).select("value", F.col("_metadata.file_name").alias("file_name"))
    fields = spark.read.json(pattern, multiLine=True).schema
    rows = files.select("file_name", F.posexplode(F.from_json("value", T.ArrayType(fields))).alias("place", "row")).select("file_name", "place", "row.*")
    made = F.concat_ws("_", F.lit(prefix), texts.stem(F.col("file_name")), F.col("place").cast("string"))
    own = F.col("question_id").cast("string") if "question_id" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("question_id", F.coalesce(own, made)).drop("file_name", "place")


def union_sources(*parts: tuple[DataFrame, str]) -> DataFrame:
    """Bag union of tables with a tag each; missing columns are null."""
    found = None
    for rows, tag in parts:
        one = rows.withColumn("_format", F.lit(tag))
        found = one if found is None else found.unionByName(one, allowMissingColumns=True)
    return found


def first_readable(spark: SparkSession, paths: list[str]) -> str:
    """The first path that exists in its own file system."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            return path
    raise FileNotFoundError(f"none of {paths}")
