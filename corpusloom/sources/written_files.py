"""Documents as files: a data source for writing, one file a row, all of a job's or none, and for reading them again.

Tasks write below a staging folder beside the target, each attempt under names of its own. When all have ended, their files are
moved to where they belong; if one fails, the staging folder goes and no file is left. A path that leaves the
target, is absolute or empty, or comes twice in a task, fails the job before anything is moved; of rows of several tasks with one path the job fails at its commit.

    spark.dataSource.register(DocumentFiles)
    rows.select("path", "text").write.format("document_files").mode("append").save("/shared/docs")

Reading gives every file, also those that hold nothing, which Spark's own file sources leave out.

    spark.read.format("document_files").load("/shared/docs")  # path, content

The target is a local or mounted folder or a URI that pyarrow's file systems know; driver and executors must share it.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


def safe(path: str | None) -> str:
    """path, if it stays below its folder."""
    parts = (path or "").split("/")
    if not path or path.startswith("/") or "\\" in path or "\0" in path or any(p in ("", ".", "..") for p in parts):
        raise PermissionError(f"{path!r} is no path below the target")
    return path


#: Files and bytes that a task reads, about.
PART_FILES, PART_BYTES = 4096, 32 << 20


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]]


def _file_system(target: str):
    from pyarrow import fs

    if "://" in target or target.startswith("file:"):
        return fs.FileSystem.from_uri(target)
    return fs.LocalFileSystem(), target


class DocumentFiles(DataSource):
    """Rows (path, text) as files; files as rows (path, content)."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if not {"path", "text"} <= set(schema.names):
            raise ValueError("rows need path and text")
        return _Writer(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, target: str):
        self.target = target.rstrip("/")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, base = _file_system(self.target)
        parts, n, size = [[]], 0, 0
        for info in system.get_file_info(fs.FileSelector(base, recursive=True)):
            path = info.path[len(base) + 1 :]
            if info.type != fs.FileType.File or path.startswith(".staging-"):
                continue
            if n >= PART_FILES or size >= PART_BYTES:
                parts.append([])
                n = size = 0
            parts[-1].append(path)
            n, size = n + 1, size + info.size
        return [InputPartition(p) for p in parts]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, bytes]]:
        system, base = _file_system(self.target)
        for path in partition.value:
            with system.open_input_stream(f"{base}/{path}") as f:
                yield path, f.read()


class _Writer(DataSourceWriter):
    def __init__(self, target: str):
        self.target, self.job = target.rstrip("/"), uuid.uuid4().hex
        system, base = _file_system(self.target)
        system.create_dir(self._staging(base), recursive=True)  # tasks don't make it: what still runs when a job has failed finds it gone

    def _staging(self, base: str) -> str:
        return f"{base}/.staging-{self.job}"

    def write(self, rows: Iterator[Row]) -> Staged:
        system, base = _file_system(self.target)
        mine, files, seen = f"{self._staging(base)}/{uuid.uuid4().hex}", [], set()
        for n, row in enumerate(rows):
            path = safe(row["path"])
            if path in seen:
                raise ValueError(f"{path} comes twice")
            seen.add(path)
            if not n:
                system.create_dir(mine, recursive=False)
            with system.open_output_stream(f"{mine}/{n}") as out:
                out.write((row["text"] or "").encode())
            files.append((f"{mine}/{n}", path))
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        system, base = _file_system(self.target)
        files = [f for m in messages if m for f in m.files]
        if len({path for _, path in files}) < len(files):
            self.abort(messages)
            raise ValueError("a path comes twice")
        for folder in sorted({f"{base}/{path}".rsplit("/", 1)[0] for _, path in files}):
            system.create_dir(folder, recursive=True)
        for staged, path in files:
            system.move(staged, f"{base}/{path}")
        self._clean(system, base)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clean(*_file_system(self.target))

    def _clean(self, system, base: str) -> None:
        from pyarrow import fs

        for _ in range(20):  # a task of a failed job may still be writing
            if system.get_file_info(self._staging(base)).type == fs.FileType.NotFound:
                return
            try:
                system.delete_dir(self._staging(base))
            except OSError:
                time.sleep(0.1)


def write_files(documents: DataFrame, target: str) -> None:
    """Writes documents (path, text) below target; texts replace what files of these paths held."""
    documents.sparkSession.dataSource.register(DocumentFiles)
    documents.select("path", "text").write.format("document_files").mode("append").save(target)


def read_files(spark: SparkSession, target: str) -> DataFrame:
    """path (below target), content of every file there."""
    spark.dataSource.register(DocumentFiles)
    return spark.read.format("document_files").load(target)
