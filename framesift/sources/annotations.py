"""A Spark data source for annotation sets: a partition for each file, files chosen by split, task filter and pushed filters.

    register(spark)
    spark.read.format("annotations").options(dataset="mlvu", root="/data/mlvu", split="test", task_filter="mcq").load()

Rows have the set's own columns (lists of texts and texts), and

    _split, _format   the split and the kind of tasks that the file holds
    _file, _file_no   the file's name, and its place among the files of the split (before any filter)
    _place            the row's place in its file
    _malformed        null, or what was wrong: a record that is no object (as JSON), a file that is no array or can't be parsed

An equality or membership filter on _split or _format is pushed into the choice of files, which then aren't opened. Malformed rows have null in the set's
columns, so that a damaged file loses nothing but itself; reading goes on.

Paths go through pyarrow's file systems (local, s3://, gs://, hdfs://), which tasks open on their own. A file is read by one task; a JSON array is
parsed whole there, Parquet in batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from framesift.sources.adapters import adapter, split_name, supported

#: Fixed columns of the sets' records: lists of texts by name, all others texts.
LISTS = {"options", "option", "candidates", "scoring_points"}
COLUMNS = {
    "egoschema": ["question_idx", "question", "video_id", "video_uid", "video_idx", "q_uid", "uid", "id", "options", "option", "option0", "option1", "option2", "option3", "option4", "answer", "ground_truth"],
    "longvideobench": ["id", "video_id", "video_path", "subtitle_path", "question", "option0", "option1", "option2", "option3", "option4", "correct_choice", "duration", "duration_group", "question_category", "topic_category", "starting_timestamp_for_subtitles"],
    "mlvu": ["question_id", "video", "question", "candidates", "options", "answer", "question_type", "task_type", "duration", "scoring_points"],
    "nextqa": ["qid", "video", "question", "a0", "a1", "a2", "a3", "a4", "answer", "type"],
    "videomme": ["question_id", "videoID", "video_id", "video", "question", "options", "answer", "duration", "domain", "sub_category", "task_type"],
    "vsibench": ["id", "scene_name", "question", "options", "ground_truth", "dataset", "task_type", "question_type"],
}
#: Task filters that also want the open-ended files of a split, and where each set's splits lie (fixed names).
WITH_GENERATION = {"all", "generation", "numeric"}
MLVU_DEV = "MLVU/json"
MLVU_TEST = [("test-ground-truth/test_mcq_gt.json", "mcq"), ("test-ground-truth/test_ssc_gt.json", "generation"), ("test-ground-truth/test_vs_gt.json", "generation")]
LVB = ["lvb_val.json", "validation-00000-of-00001.parquet"]
SUFFIXES = (".json", ".jsonl", ".parquet")
OWN = "_split string, _format string, _file string, _file_no int, _place bigint, _malformed string"


def schema_of(dataset: str) -> str:
    return ", ".join(f"`{c}` {'array<string>' if c in LISTS else 'string'}" for c in COLUMNS[dataset]) + f", {OWN}"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(root: str, folder: str = "") -> list[str]:
    """Names of the files of a folder below root, sorted; none where it isn't there."""
    from pyarrow import fs

    store, path = _store(root)
    found = store.get_file_info(fs.FileSelector(f"{path}/{folder}".rstrip("/"), allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File)


def files_of(dataset: str, root: str, split: str, task_filter: str = "all") -> list[tuple[str, str, int]]:
    """(path below root, kind, place) of the files that a split and a task filter need; FileNotFoundError where there are none.

    A set without a layout of its own has files named {split}*.json, .jsonl or .parquet.
    """
    if dataset == "mlvu" and split == "dev":
        found = [(f"{MLVU_DEV}/{f}", "", i) for i, f in enumerate(f for f in _files(root, MLVU_DEV) if f.endswith(".json"))]
    elif dataset == "mlvu":
        there = set(_files(root, "test-ground-truth"))
        found = [(f, kind, i) for i, (f, kind) in enumerate(MLVU_TEST) if f.split("/")[-1] in there and (kind == "mcq" or task_filter in WITH_GENERATION)]
    elif dataset == "longvideobench":
        there = set(_files(root))
        found = [(f, "", 0) for f in LVB if f in there][:1]
    else:
        found = [(f, "", i) for i, f in enumerate(f for f in _files(root) if f.lower().startswith(split) and f.endswith(SUFFIXES))]
    if not found:
        raise FileNotFoundError(f"no annotations of {dataset}, split {split}, below {root}")
    return found


class _File(InputPartition):
    def __init__(self, path: str, kind: str, number: int):
        self.path, self.kind, self.number = path, kind, number


class AnnotationReader(DataSourceReader):
    def __init__(self, options: dict):
        self.dataset = options["dataset"].strip().lower()
        if self.dataset not in COLUMNS:
            raise ValueError(f"unknown dataset {self.dataset!r}; known: {', '.join(supported())}")
        self.root = options["root"].rstrip("/")
        self.split = split_name(self.dataset, options.get("split", "validation"))
        self.task_filter = options.get("task_filter", "all").strip()
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on what all of a file's rows have in common decide by file; the rest stays with Spark."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in ("_split", "_format"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[_File]:
        if self.split not in self.wanted.get("_split", {self.split}):
            return []
        kinds = self.wanted.get("_format")
        return [_File(*f) for f in files_of(self.dataset, self.root, self.split, self.task_filter) if kinds is None or f[1] in kinds]

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition is None:
            return
        names, tail = COLUMNS[self.dataset], (self.split, partition.kind, partition.path.split("/")[-1], partition.number)
        for place, (record, wrong) in enumerate(records(self.root, partition.path)):
            values = [None] * len(names) if wrong is not None else [_cell(record.get(c), c in LISTS) for c in names]
            yield (*values, *tail, place, wrong)


def records(root: str, path: str) -> Iterator[tuple[dict | None, str | None]]:
    """(record, None) or (None, what is wrong) for each record of a file."""
    store, base = _store(root)
    with store.open_input_file(f"{base}/{path}") as source:
        if path.endswith(".parquet"):
            import pyarrow.parquet as pq

            for batch in pq.ParquetFile(source).iter_batches():
                yield from ((r, None) for r in batch.to_pylist())
            return
        text = source.read().decode("utf-8", errors="replace")
    if path.endswith(".jsonl"):
        for line in filter(str.strip, text.splitlines()):
            try:
                yield _checked(json.loads(line))
            except ValueError:
                yield None, line
        return
    try:
        held = json.loads(text)
    except ValueError as e:
        yield None, f"{path}: {e}"
        return
    if not isinstance(held, list):
        yield None, f"{path}: no array"
        return
    yield from map(_checked, held)


def _checked(record) -> tuple[dict | None, str | None]:
    return (record, None) if isinstance(record, dict) else (None, json.dumps(record))


def _cell(value, is_list: bool):
    """A text, or a list of texts; what should be a list and isn't is null."""
    if value is None:
        return None
    if is_list:
        return [None if x is None else _cell(x, False) for x in value] if isinstance(value, (list, tuple)) else None
    if isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False) if isinstance(value, (dict, list, bool)) else str(value)


class AnnotationSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "annotations"

    def schema(self) -> str:
        dataset = self.options["dataset"].strip().lower()
        if dataset not in COLUMNS:
            raise ValueError(f"unknown dataset {dataset!r}; known: {', '.join(supported())}")
        return schema_of(dataset)

    def reader(self, schema) -> AnnotationReader:
        return AnnotationReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes format("annotations") known, and turns filter pushdown of Python sources on."""
    spark.dataSource.register(AnnotationSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def with_source_index(raw: DataFrame) -> DataFrame:
    """raw plus source_index: the place of a row in all files of the split together, read in their order."""
    sizes = raw.groupBy("_file_no").agg(F.count(F.lit(1)).alias("n"))  # a row for each file
    before = sizes.select("_file_no", F.coalesce(F.sum("n").over(Window.orderBy("_file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return raw.join(F.broadcast(before), "_file_no").withColumn("source_index", F.col("base") + F.col("_place")).drop("base")


def read_set(spark: SparkSession, dataset: str, root: str, split: str, task_filter: str = "all") -> DataFrame:
    """Samples of a split, malformed records left out; a record of a development file without an id is named by file and place."""
    register(spark)
    raw = spark.read.format("annotations").options(dataset=dataset, root=root, split=split, task_filter=task_filter).load()
    raw = with_source_index(raw).where("_malformed IS NULL")
    if dataset.strip().lower() == "mlvu" and split_name(dataset, split) == "dev":
        made = F.concat(F.lit("dev_"), F.regexp_replace("_file", r"\.[^.]*$", ""), F.lit("_"), F.col("_place").cast("string"))
        raw = raw.withColumn("question_id", F.coalesce("question_id", made))
    return adapter(dataset)(raw)
