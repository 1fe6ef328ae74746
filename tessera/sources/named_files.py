"""A sink that writes exactly named files, all of them or none: one file a record, or one a result set.

Each task writes its files under a draft folder beside the target. The driver moves them to their
names when all tasks are done, and deletes the drafts when one fails, so a stopped or failed write
leaves the target as it was. A task that runs again has a draft folder of its own; only the folder of
the attempt that Spark accepts is moved.

A folder may hold millions of files. The driver never holds their names at once: tasks write lists of
theirs beside their drafts, which it goes through part by part, and reading lists a folder in a task.

    write(df, folder, "name", "content")              one row is a file
    write(df, folder, "name", "line", ["a", "b"])     rows of a name are its lines, in order; null lines none
"""

from __future__ import annotations

import io
import itertools
import json
import os
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


#: Partitions of small files that one task reads, if only Spark reads the folder's file system.
READ_TOGETHER = 64
#: Names that a commit holds at once; bytes and files of a batch that is read.
HELD, BATCH, BATCH_FILES = 500_000, 4 << 20, 1000


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with its file system; one without a scheme is on Spark's default file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + found.removeprefix("file:") if found.startswith("file:/") and not found.startswith("file://") else found


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a qualified folder."""
    if uri.startswith("file:///"):  # as it is: from_uri would have it escaped
        return pyarrow.fs.LocalFileSystem(), uri.removeprefix("file://")
    return pyarrow.fs.FileSystem.from_uri(uri)


def names_in(fs: pyarrow.fs.FileSystem, root: str) -> Iterator[str]:
    """Names of the files right in a folder, as a stream where it is local."""
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        with os.scandir(root) as found:
            yield from (f.name for f in found if f.is_file())
    else:
        yield from (f.base_name for f in fs.get_file_info(pyarrow.fs.FileSelector(root)) if f.type == pyarrow.fs.FileType.File)


def remove(folder: str) -> None:
    """Delete a local folder entry by entry, without a list of them."""
    found = True
    while found:  # entries that go may hide others from one pass
        found = False
        with os.scandir(folder) as entries:
            for e in entries:
                found = True
                remove(e.path) if e.is_dir(follow_symlinks=False) else os.unlink(e.path)
    os.rmdir(folder)


@dataclass
class Drafts(WriterCommitMessage):
    """What one task wrote."""

    folder: str
    files: int


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, folder: str, lines: bool, overwrite: bool):
        self.folder, self.lines, self.overwrite = folder, lines, overwrite
        self.drafts = f".drafts-{uuid.uuid4().hex}"

    def _root(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return opened(self.folder)

    def write(self, iterator: Iterator) -> Drafts:
        fs, root = self._root()
        mine = f"{root}/{self.drafts}/{uuid.uuid4().hex}"
        name, out, seen = None, None, set()
        try:
            for row in iterator:
                now, text = row[0], row[1]
                if now != name or out is None:
                    if not now or "/" in now or now in (".", "..") or now.startswith(".drafts-"):
                        raise ValueError(f"no name of a file: {now!r}")
                    if now in seen:
                        raise ValueError(f"rows of {now!r} lie apart, or it is written twice")
                    if out is not None:
                        out.close()
                    elif not seen:
                        fs.create_dir(mine, recursive=True)
                    seen.add(now)
                    name, out = now, fs.open_output_stream(f"{mine}/{now}")
                elif not self.lines:
                    raise ValueError(f"{now!r} is written twice")
                if text is not None:
                    out.write(text.encode() + (b"\n" if self.lines else b""))
        finally:
            if out is not None:
                out.close()
        if seen:
            with fs.open_output_stream(f"{mine}.names", buffer_size=1 << 20) as out:
                for now in seen:
                    out.write(json.dumps(now).encode() + b"\n")
        return Drafts(mine, len(seen))

    def _names(self, fs: pyarrow.fs.FileSystem, done: list[Drafts]) -> Iterator[tuple[str, str]]:
        """(draft folder, name) of each file that the tasks wrote."""
        for m in done:
            with io.BufferedReader(fs.open_input_stream(f"{m.folder}.names"), 1 << 16) as lines:
                for line in lines:
                    yield m.folder, json.loads(line)

    def _parts(self, fs: pyarrow.fs.FileSystem, done: list[Drafts]) -> Iterator[tuple[set[str], Callable[[str], bool]]]:
        """All names in parts of about ``HELD``, and what tells whether a name belongs to the part."""
        n = max(1, -(-sum(m.files for m in done) // HELD))
        for k in range(n):
            belongs = lambda name, k=k: n == 1 or zlib.crc32(name.encode(errors="surrogateescape")) % n == k
            names = set()
            for _, name in self._names(fs, done):
                if belongs(name):
                    if name in names:
                        raise ValueError("two tasks wrote one file; rows of a name must be in one task")
                    names.add(name)
            yield names, belongs

    def commit(self, messages: list) -> None:
        fs, root = self._root()
        done = [m for m in messages if m is not None and m.files]
        try:
            for _ in self._parts(fs, done) if len(done) > 1 else ():
                pass
        except ValueError:
            self.abort(messages)
            raise
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for new, belongs in self._parts(fs, done):
                for name in names_in(fs, root):
                    if belongs(name) and name not in new:
                        fs.delete_file(f"{root}/{name}")
        for folder, name in self._names(fs, done):
            fs.move(f"{folder}/{name}", f"{root}/{name}")
        self._clear(fs, root)

    def abort(self, messages: list) -> None:
        # tasks that are being stopped may still write: until nothing comes back for a second
        fs, root = self._root()
        quiet = 0
        for _ in range(40):
            try:
                quiet = 0 if self._clear(fs, root) else quiet + 1
            except OSError:
                quiet = 0
            if quiet == 4:
                return
            time.sleep(0.25)
        self._clear(fs, root)

    def _clear(self, fs: pyarrow.fs.FileSystem, root: str) -> bool:
        """Delete the drafts; were there any?"""
        at = f"{root}/{self.drafts}"
        found = fs.get_file_info(at).type == pyarrow.fs.FileType.Directory
        if found:
            fs.delete_dir(at)
        return found


class NamedFiles(DataSource):
    """``named_files``: rows (name, text). Options: path, lines (true: rows are lines)."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return NamedFilesWriter(self.options["path"], self.options.get("lines", "false").lower() == "true", overwrite)


def write(df: DataFrame, folder: str, name: str, text: str, order: list[str] | None = None, overwrite: bool = False) -> None:
    """Write the files that ``df`` describes; other files of ``folder`` stay, unless ``overwrite``.

    Without ``order`` a row is a file and its names must be unique. With it, the rows of a name are the
    lines of its file, sorted; they pass through one task as a stream, as one file has one writer.
    """
    spark = df.sparkSession
    spark.dataSource.register(NamedFiles)
    if order is not None:
        df = df.repartition(name).sortWithinPartitions(name, *order)
    rows = df.select(F.col(name).cast("string").alias("name"), F.col(text).cast("string").alias("text"))
    writer = rows.write.format("named_files").mode("overwrite" if overwrite else "append")
    writer.option("lines", str(order is not None).lower()).save(qualified(spark, folder))


def _shown(name: str) -> bool:
    """Does Spark read a file of this name? It passes over hidden ones."""
    hidden = name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")
    return not hidden or name.startswith(("_metadata", "_common_metadata"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of the files of a folder, but for empty and hidden ones, as Spark has it.

    One task lists the folder and deals the names out to those that read the files: Spark's own reader
    keeps all files of a folder in the driver.
    """
    uri = qualified(spark, folder)
    try:
        opened(uri)
    except (OSError, pa.ArrowException):
        return _read_by_spark(spark, folder)

    def listed(batches):
        for _ in batches:
            names = filter(_shown, names_in(*opened(uri)))
            while some := list(itertools.islice(names, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["name"])

    def contents(batches):
        fs, root = opened(uri)
        names, content, size = [], [], 0
        for name in (n for batch in batches for n in batch.column(0).to_pylist()):
            with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                data = f.read()
            if names and (size + len(data) > BATCH or len(names) == BATCH_FILES):
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(content, pa.binary())], names=["name", "content"])
                names, content, size = [], [], 0
            if data:
                names.append(name)
                content.append(data)
                size += len(data)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(content, pa.binary())], names=["name", "content"])

    parts = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = spark.range(0, 1, 1, 1).mapInArrow(listed, "name string").repartition(parts, "name")
    return names.mapInArrow(contents, "name string, content binary")


def _read_by_spark(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(folder)
    # Spark deals out some 30 small files a partition, whose start costs more than they do
    parts = files.rdd.getNumPartitions()
    files = files.coalesce(max(3 * spark.sparkContext.defaultParallelism, parts // READ_TOGETHER))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def records(df: DataFrame, raw: str, added: list[str], name: str) -> DataFrame:
    """(name, content): each raw JSON object with further fields at its end, as indented JSON, characters unescaped.

    ``name`` is the column that names the file (``.json`` is appended). A null added field is left out.
    """
    src = df.select(F.concat(F.col(name).cast("string"), F.lit(".json")).alias("name"), F.col(raw).alias("raw"), F.to_json(F.struct(*[F.col(c) for c in added])).alias("more"))

    def run(batches):
        for batch in batches:
            names, raws, mores = (c.to_pylist() for c in batch.columns)
            content = [json.dumps(json.loads(r) | json.loads(m), ensure_ascii=False, indent=2) for r, m in zip(raws, mores, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(content, pa.string())], names=["name", "content"])

    return src.mapInArrow(run, "name string, content string")
