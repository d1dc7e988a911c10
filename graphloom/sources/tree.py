"""Source trees as a data source of Spark: listings by folder, in parallel, and a stream of what appears, changes and goes.

    spark.dataSource.register(TreeSource)
    spark.read.format("tree").option("exclude", json.dumps([...])).load("/path")
    spark.readStream.format("tree").option("state", "/shared/folder").load("/path")

A listing is (path, length, modified) and opens no file; ``read_texts`` opens those that a caller names.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from graphloom.functions import paths
from graphloom.schemas import EXCLUDE, MAX_FILE_SIZE

LISTING = "path string, length long, modified timestamp"
EVENTS = "path string, event string, ts timestamp"


def file_system(root: str) -> tuple[fs.FileSystem, str]:
    """Any file system that Arrow knows, and the path within it."""
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def entries(root: str, folder: str, excluded_folders: tuple[str, ...]) -> tuple[list[tuple], list[str]]:
    """The files of one folder, (path, length, modified) below the root, and its folders that are not excluded whole."""
    system, base = file_system(root)
    files, folders = [], []
    for x in system.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base, allow_not_found=True)):
        path = x.path[len(base) :].lstrip("/")
        if x.type == fs.FileType.Directory and f"{path}/" not in excluded_folders and x.base_name not in excluded_folders:
            folders.append(path)
        elif x.type == fs.FileType.File:
            files.append((path, x.size, datetime.fromtimestamp(x.mtime_ns / 1e9, UTC) if x.mtime_ns is not None else None))
    return files, folders


def walk(root: str, folder: str, excluded_folders: tuple[str, ...]) -> Iterator[tuple]:
    """All files below a folder; folders that vanish meanwhile are empty."""
    todo = [folder]
    while todo:
        files, more = entries(root, todo.pop(), excluded_folders)
        yield from files
        todo += more


def whole_folders(exclude: tuple[str, ...]) -> tuple[str, ...]:
    """Folders below the root that a pattern excludes with all they hold, so that they need no listing."""
    return tuple(f"{p.removesuffix('/**')}/" for p in exclude if p.endswith("/**") and not set(p.removesuffix("/**")) & set("*?["))


class _Folder(InputPartition):
    def __init__(self, folder: str, deep: bool):
        super().__init__(None)
        self.folder, self.deep = folder, deep


class _Plan:
    """What both readers share: options, and the folders that become tasks."""

    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.excluded = whole_folders(tuple(json.loads(options.get("exclude", json.dumps(EXCLUDE)))))
        self.tasks = int(options.get("tasks", "64"))

    def folders(self) -> list[_Folder]:
        """The tree is opened level by level until there are enough folders to deal out; those opened give a task of their own
        files each."""
        opened: list[str] = []
        level = [""]
        with ThreadPoolExecutor(16) as pool:
            while level and len(opened) + len(level) < self.tasks:
                listed = list(pool.map(lambda f: entries(self.root, f, self.excluded)[1], level))
                opened += level
                level = [x for some in listed for x in some]
        return [_Folder(f, False) for f in opened] + [_Folder(f, True) for f in level]

    def read(self, part: _Folder) -> Iterator[tuple]:
        return walk(self.root, part.folder, self.excluded) if part.deep else iter(entries(self.root, part.folder, self.excluded)[0])


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.plan = _Plan(options)

    def partitions(self) -> list[InputPartition]:
        return self.plan.folders()

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.plan.read(partition)


class _Events(InputPartition):
    def __init__(self, rows: list[tuple]):
        super().__init__(None)
        self.rows = rows


class _TreeStream(DataSourceStreamReader):
    """An offset names a listing in the ``state`` folder; a batch is the difference of two listings, so deletions show and a
    batch that is run again is the same.  Listings that no batch needs any more are removed."""

    def __init__(self, options: dict):
        self.plan, self.batch_rows = _Plan(options), int(options.get("batchRows", "10000"))
        self.system, self.state = file_system(options["state"].rstrip("/"))
        self.system.create_dir(self.state, recursive=True)
        self.last: tuple[dict, str] | None = None

    def _listing(self, offset: dict) -> dict[str, list]:
        if not offset.get("listing"):
            return {}
        with self.system.open_input_stream(f"{self.state}/{offset['listing']}") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"listing": ""}

    def latestOffset(self) -> dict:
        with ThreadPoolExecutor(16) as pool:
            rows = [r for some in pool.map(lambda p: list(self.plan.read(p)), self.plan.folders()) for r in some]
        now = {p: [n, m.isoformat() if m else None] for p, n, m in rows if not p.startswith(".graphloom/")}
        if self.last and self.last[0] == now:
            return {"listing": self.last[1]}
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}.json"
        with self.system.open_output_stream(f"{self.state}/{name}") as f:
            f.write(json.dumps(now).encode())
        self.last = (now, name)
        return {"listing": name}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = self._listing(start), self._listing(end)
        rows = [(p, "added" if p not in old else "modified", s[1]) for p, s in new.items() if old.get(p) != s]
        rows += [(p, "removed", None) for p in old if p not in new]
        return [_Events(rows[i : i + self.batch_rows]) for i in range(0, len(rows), self.batch_rows)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        now = datetime.now(UTC)
        for path, event, at in partition.rows:
            yield path, event, datetime.fromisoformat(at) if at else now

    def commit(self, end: dict) -> None:
        for x in self.system.get_file_info(fs.FileSelector(self.state)):
            if x.base_name.endswith(".json") and x.base_name < (end.get("listing") or ""):
                self.system.delete_file(x.path)


class TreeSource(DataSource):
    """``path``: the root; ``exclude``: patterns as JSON, of which those of whole folders save their listing; ``tasks``: about
    how many folders to deal out; for streams ``state``: a shared folder of the stream's own."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return EVENTS if "state" in self.options else LISTING

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TreeReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _TreeStream(self.options)


def listing(spark: SparkSession, root: str, exclude: tuple[str, ...] = EXCLUDE, max_size: int = MAX_FILE_SIZE, languages: tuple[str, ...] = ()) -> DataFrame:
    """(path, language, length, modified) of the files of a tree that are not excluded, not larger than ``max_size`` and in a
    known language.  No file is opened."""
    out = all_files(spark, root, exclude).withColumn("language", paths.language_of(F.col("path")))
    out = out.where((F.col("length") <= max_size) & F.col("language").isNotNull() & ~paths.excluded(F.col("path"), exclude))
    out = out.where(F.col("language").isin(*languages)) if languages else out
    return out.select("path", "language", "length", "modified")


def all_files(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").option("exclude", json.dumps(list(exclude))).load(root)


def changes(spark: SparkSession, root: str, state: str, exclude: tuple[str, ...] = EXCLUDE) -> DataFrame:
    """(path, event, ts), as a stream, of files in a known language that are added, modified or removed."""
    spark.dataSource.register(TreeSource)
    out = spark.readStream.format("tree").option("state", state).option("exclude", json.dumps(list(exclude))).load(root)
    return out.where(paths.language_of(F.col("path")).isNotNull() & ~paths.excluded(F.col("path"), exclude))


def read_texts(listed: DataFrame, root: str, task_bytes: int = 32 << 20) -> DataFrame:
    """(path, language, length, modified, content_hash, text) of listed files; binaries have no text, and files that are gone
    or can't be read are left out.  Files are dealt out by path, about ``task_bytes`` to a task."""
    total = listed.agg(F.sum("length")).first()[0] or 0

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(root)
        for batch in batches:
            for i, path in enumerate(batch.column(0).to_pylist()):  # a file at a time is held
                try:
                    with system.open_input_stream(f"{base}/{path}", compression=None) as f:
                        content = f.read()
                except OSError:
                    continue
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([content], pa.binary())], [*batch.schema.names, "_content"])

    dealt = listed.select("path", "language", "length", "modified").repartition(1 + total // task_bytes, "path")
    out = dealt.mapInArrow(read, "path string, language string, length long, modified timestamp, _content binary")
    binary = F.col("path").rlike(r"\.(node|wasm)$")
    # Texts that are not valid are read with replacement characters.
    text = F.when(~binary, F.decode("_content", "UTF-8"))
    return out.select("path", "language", "length", "modified", F.sha2("_content", 256).alias("content_hash"), text.alias("text"))
