"""Folders of documents as a data source of Spark, to read and to stream, and run logs as one to write.

``spark.dataSource.register(FileDocuments)``, then ``spark.read.format("docweft_files").load(folder)`` or
``spark.readStream.format("docweft_files")``. Partitions are planned by bytes, so that a folder of
many small files makes few tasks and a large file its own. Files are reached by pyarrow file
systems: a local folder that all machines share, or a URI that pyarrow knows.

``docweft_log`` writes JSON lines. Tasks write under hidden names, and the driver gives the files their
names when all of them are whole; what a stream's batch has written gets the batch's number, so a
batch that is repeated replaces itself.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from . import scan

PART_BYTES = 64 << 20


def _system(path: str):
    """(file system, path on it)."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


@dataclass
class Files(InputPartition):
    """Files of one task: path and size."""

    files: list[tuple[str, int]]


def listed(folder: str) -> list[tuple[int, str, int]]:
    """(modified in nanoseconds, path, size) of the files of a folder, not of its folders."""
    from pyarrow import fs

    system, at = _system(folder)
    found = system.get_file_info(fs.FileSelector(at))
    return sorted((f.mtime_ns or 0, f.path, f.size or 0) for f in found if f.is_file and not f.base_name.startswith((".", "_")))


def planned(files: list[tuple[str, int]], most: int) -> list[Files]:
    """Neighbouring files in parts of at most ``most`` bytes; a larger file is a part of its own."""
    out, size = [], 0
    for path, n in files:
        if not out or size + n > most:
            out.append(Files([]))
            size = 0
        out[-1].files.append((path, n))
        size += n
    return out


class _Reading:
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.extensions = [e.strip() for e in options.get("extensions", ",".join(scan.SOURCES)).split(",")]
        self.most = int(options.get("bytesPerPartition", PART_BYTES))

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _system(self.folder)
        for path, size in partition.files:
            extension = os.path.splitext(path)[1].lower()
            try:
                with system.open_input_stream(path) as f:
                    data = f.read()
            except OSError as e:
                yield path, extension, size, "", f"{type(e).__name__}: {e}", 0, 0
                continue
            yield scan.decoded(path, extension, size, data, self.extensions)


class _Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        return planned([(p, n) for _, p, n in listed(self.folder)], self.most) or [Files([])]


class _Stream(_Reading, DataSourceStreamReader):
    """The offset is the last file by time of change, then path."""

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = listed(self.folder)
        return {"modified": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["modified"], start["path"]), (end["modified"], end["path"])
        return planned([(p, n) for t, p, n in listed(self.folder) if low < (t, p) <= high], self.most)

    def commit(self, end: dict) -> None:
        pass


class FileDocuments(DataSource):
    """Text, Word and PDF files as rows; what can't be read is a row with an error. Options: path, extensions, bytesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "docweft_files"

    def schema(self) -> str:
        return scan.READ

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class _Log:
    def __init__(self, options: dict):
        self.folder = options["path"]

    def write(self, rows: Iterator[Row]) -> Written:
        system, at = _system(self.folder)
        lines = (json.dumps(r.asDict(True), ensure_ascii=False, default=str) for r in rows)
        first = next(lines, None)
        if first is None:
            return Written(None)
        system.create_dir(at, recursive=True)
        path = f"{at}/_{uuid.uuid4().hex}"
        with system.open_output_stream(path) as f:
            f.write((first + "\n").encode())
            for line in lines:
                f.write((line + "\n").encode())
        return Written(path)

    def _named(self, messages: list[Written | None], name: str) -> None:
        system, at = _system(self.folder)
        for n, m in enumerate(m for m in messages if m is not None and m.path):
            system.move(m.path, f"{at}/{name}-{n:05d}.jsonl")

    def _dropped(self, messages: list[Written | None]) -> None:
        system, _ = _system(self.folder)
        for m in messages:
            if m is not None and m.path:
                system.delete_file(m.path)


class _LogWriter(_Log, DataSourceWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._named(messages, f"part-{uuid.uuid4().hex}")

    def abort(self, messages: list[Written | None]) -> None:
        self._dropped(messages)


class _LogStream(_Log, DataSourceStreamWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self._named(messages, f"batch-{batchId:010d}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._dropped(messages)


class RunLog(DataSource):
    """Rows as JSON lines. Option: path."""

    @classmethod
    def name(cls) -> str:
        return "docweft_log"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a log is only added to")
        return _LogWriter(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _LogStream(self.options)


def register(spark: SparkSession) -> None:
    for source in (FileDocuments, RunLog):
        spark.dataSource.register(source)


def documents(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """The rows of ``scan.documents``, read by the data source."""
    register(spark)
    return scan.finished(spark.read.format("docweft_files").options(**options).load(folder))


def arriving(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """The same as a stream: files once each, as they come."""
    register(spark)
    return scan.finished(spark.readStream.format("docweft_files").options(**options).load(folder))
