"""A Spark data source that lists files: names, sizes and times, without opening one.

    register(spark)
    spark.read.format("listing").options(roots="/a,/b", suffixes=".mp4,.mkv").load()

Rows: root, root_no (its place among roots), path, size, modified. Folders are listed by tasks: the planner only goes down from each root until it has
enough folders to deal out (`folders`, 64), and each partition lists whole subtrees. A root that isn't there has no files. File systems are pyarrow's.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "root string, root_no int, path string, size bigint, modified timestamp"
#: Fixed suffixes of video files.
VIDEOS = (".mp4", ".webm", ".mkv", ".avi")
FOLDERS = 64


def _listed(root: str, folder: str, deep: bool) -> list:
    from pyarrow import fs

    store = fs.FileSystem.from_uri(root)[0] if "://" in root else fs.LocalFileSystem()
    return store.get_file_info(fs.FileSelector(folder, recursive=deep, allow_not_found=True))


class _Folder(InputPartition):
    def __init__(self, root: str, number: int, folder: str, deep: bool):
        self.root, self.number, self.folder, self.deep = root, number, folder, deep


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [r.strip().rstrip("/") for r in options["roots"].split(",") if r.strip()]
        self.suffixes = tuple(s.strip().lower() for s in options.get("suffixes", "").split(",") if s.strip())
        self.enough = int(options.get("folders", FOLDERS))

    def partitions(self) -> list[_Folder]:
        from pyarrow import fs

        # (root, its number, folder); a folder that is opened here keeps its own files as a shallow partition.
        deep = [(r, i, fs.FileSystem.from_uri(r)[1] if "://" in r else r) for i, r in enumerate(self.roots)]
        shallow: list[tuple] = []
        while deep and len(deep) < self.enough:
            opened = [(r, i, f, [x.path for x in _listed(r, f, False) if x.type == fs.FileType.Directory]) for r, i, f in deep]
            shallow += [(r, i, f) for r, i, f, _ in opened]
            deep = [(r, i, x) for r, i, _, below in opened for x in below]
        return [_Folder(*x, False) for x in shallow] + [_Folder(*x, True) for x in deep]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        from pyarrow import fs

        scheme = partition.root.split("://")[0] + "://" if "://" in partition.root else ""
        for f in _listed(partition.root, partition.folder, partition.deep):
            if f.type == fs.FileType.File and (not self.suffixes or f.base_name.lower().endswith(self.suffixes)):
                yield partition.root, partition.number, scheme + f.path, f.size, f.mtime


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ListingSource)


def list_files(spark: SparkSession, roots: list[str], suffixes: tuple[str, ...] = (), folders: int = FOLDERS) -> DataFrame:
    register(spark)
    return spark.read.format("listing").options(roots=",".join(roots), suffixes=",".join(suffixes), folders=folders).load()


def index_videos(spark: SparkSession, roots: list[str]) -> DataFrame:
    """stem, path of all video files below the roots; of equal stems the first root's counts, in it the first path."""
    from framesift.sources.frames import video_index

    return video_index(list_files(spark, roots, VIDEOS), root="root_no")


def list_frames(spark: SparkSession, roots: list[str]) -> DataFrame:
    """sample_id (the folder's name), file: frame images, for frames_of."""
    from pyspark.sql import functions as F

    files = list_files(spark, roots, (".jpg",))
    return files.select(F.element_at(F.split("path", "/"), -2).alias("sample_id"), F.element_at(F.split("path", "/"), -1).alias("file"))
