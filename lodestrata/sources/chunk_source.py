"""Chunk files as a Spark data source: ``spark.read.format("chunk_files")`` and ``readStream`` over one folder.

A folder holds ``*_chunks.json`` files, each an array of chunks. Files are dealt to partitions by
size; conditions on the file name leave files unread and conditions on ``chunk_index`` are met
while reading. The stream takes files in the order of their time and name. The folder is a
path or URI that pyarrow can open on every executor; for other stores ``read_chunks_json`` reads by Spark.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

from lodestrata import schemas

PARTITION_BYTES = 64 << 20
_ENDING = "_chunks.json"
_TESTS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with its conditions pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkFiles)


def _listed(folder: str) -> list[tuple[int, str, int]]:
    """(time in nanoseconds, path, size) of the chunk files of a folder, in that order."""
    import pyarrow.fs

    filesystem, base = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder else (pyarrow.fs.LocalFileSystem(), folder)
    found = filesystem.get_file_info(pyarrow.fs.FileSelector(base))
    return sorted((f.mtime_ns, f.path, f.size) for f in found if f.is_file and f.path.endswith(_ENDING))


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


def _dealt(files: list[tuple[int, str, int]]) -> list[Files]:
    made, size = [], PARTITION_BYTES
    for _, path, n in sorted(files, key=lambda f: f[1]):
        if size >= PARTITION_BYTES:
            made.append(Files([]))
            size = 0
        made[-1].paths.append(path)
        size += n
    return made


def _rows(folder: str, partition: Files, tests: list) -> Iterator[tuple]:
    import pyarrow.fs

    filesystem = pyarrow.fs.FileSystem.from_uri(folder)[0] if "://" in folder else pyarrow.fs.LocalFileSystem()
    names = schemas.CHUNK.fieldNames()
    for path in partition.paths:
        with filesystem.open_input_stream(path) as source:
            chunks = json.loads(source.read())
        for chunk in chunks:
            at = chunk.get("chunk_index")
            if all(at is not None and test(at, value) for test, value in tests):
                yield (*(chunk.get(n) for n in names), path.rsplit("/", 1)[-1])


class ChunkFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunk_files"

    def schema(self) -> T.StructType:
        return T.StructType([*schemas.CHUNK.fields, T.StructField("file", T.StringType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ChunkReader(self.options["path"])

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return ChunkStream(self.options["path"])


class ChunkReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.names, self.tests = folder, None, []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("file",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = names if self.names is None else self.names & names
            elif type(f) in _TESTS and f.attribute == ("chunk_index",):
                self.tests.append((_TESTS[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        return _dealt([f for f in _listed(self.folder) if self.names is None or f[1].rsplit("/", 1)[-1] in self.names])

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.folder, partition, self.tests)


class ChunkStream(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        files = _listed(self.folder)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return _dealt([f for f in _listed(self.folder) if low < f[:2] <= high])

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.folder, partition, [])
