"""JSON-lines manifests packed by gzip, read by many tasks.

A gzip file may be many members end to end (``pack`` writes such files; so do most parallel
compressors). An index of the members, made once by a scan that Spark spreads over files, lets each
task open a file at its first member. A line that runs over the edge of a task's members belongs to
the task in which it begins. Comparisons of top-level columns with constants are pushed down and
tried on each record before a row is made of it.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType, StructType

from tessera.sources import scratch
from tessera.sources.named_files import qualified

READ = 1 << 20
#: Bytes of text in one member that ``pack`` writes, and of packed bytes that one task reads.
MEMBER, SPLIT = 4 << 20, 64 << 20
INDEX = "path string, at long, size long, whole boolean"


def _opened(uri: str):
    fs, at = pyarrow.fs.FileSystem.from_uri(uri)
    return fs.open_input_file(at)


def members(uri: str) -> Iterator[tuple[int, int, bool]]:
    """(offset, packed bytes, whether its text ends with a line) of each gzip member, in one pass."""
    with _opened(uri) as f:
        at, start, rest, last, d = 0, 0, b"", b"\n", None
        while True:
            data = rest or f.read(READ)
            if not data:
                break
            d = d or zlib.decompressobj(31)
            text = d.decompress(data)
            last = text[-1:] or last
            rest = d.unused_data
            at += len(data) - len(rest)
            if d.eof:
                yield start, at - start, last == b"\n"
                start, d = at, None
        if d is not None:
            raise EOFError(f"{uri} is cut short")


def index(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, size, whole) of the members of all files under ``path``, in order; one task a file."""
    files = spark.read.format("binaryFile").load(path).select("path")
    files = files.select(F.when(F.col("path").startswith("file:/") & ~F.col("path").startswith("file://"), F.concat(F.lit("file://"), F.substring("path", 6, 1 << 30))).otherwise(F.col("path")).alias("path"))

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                found = list(members(uri))
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(found), pa.string()), *(pa.array([m[i] for m in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_())))], names=["path", "at", "size", "whole"])

    return files.repartition("path").mapInArrow(run, INDEX)


def _chunks(uri: str, at: int) -> Iterator[tuple[int, bytes]]:
    """(offset of the member, some of its text) from the member at ``at`` on."""
    with _opened(uri) as f:
        f.seek(at)
        start, place, data, d = at, at, b"", None
        while data := data or f.read(READ):
            d = d or zlib.decompressobj(31)
            text = d.decompress(data)
            place += len(data) - len(d.unused_data)
            data = d.unused_data
            if text:
                yield start, text
            if d.eof:
                start, d = place, None


def lines(uri: str, at: int, end: int, first: bool) -> Iterator[bytes]:
    """Lines that begin in the members from ``at`` to ``end``.

    Unless ``first`` (a line begins at ``at``), what comes before the first line feed is the end of
    an earlier line. The last line is read on beyond ``end`` up to its end.
    """
    text, skip = b"", not first
    for start, more in _chunks(uri, at):
        if start >= end:
            if skip or not text:  # no line that began before is open
                return
            cut = more.find(b"\n")
            if cut < 0:
                text += more
                continue
            yield text + more[:cut]
            return
        text += more
        if skip:
            cut = text.find(b"\n")
            text, skip = (text[cut + 1 :], False) if cut >= 0 else (b"", True)
        *done, text = text.split(b"\n")
        yield from done
    if text and not skip:
        yield text


def value(x: object, kind: DataType) -> object:
    """A parsed JSON value as one of Spark's type; null where it is of another type."""
    if x is None:
        return None
    if isinstance(kind, StringType):
        return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    if isinstance(kind, (IntegerType, LongType)):
        return x if isinstance(x, int) and not isinstance(x, bool) else None
    if isinstance(kind, (DoubleType, FloatType)):
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
    if isinstance(kind, StructType):
        return tuple(value(x.get(f.name), f.dataType) for f in kind.fields) if isinstance(x, dict) else None
    if isinstance(kind, ArrayType):
        return [value(e, kind.elementType) for e in x] if isinstance(x, list) else None
    if isinstance(kind, MapType):
        return {k: value(e, kind.valueType) for k, e in x.items()} if isinstance(x, dict) else None
    return x


@dataclass
class Split(InputPartition):
    path: str
    at: int
    end: int
    first: bool


def holds(f: Filter, x: object) -> bool:
    """Whether a value passes a filter, as SQL compares (null passes only tests of null)."""
    if isinstance(f, IsNull):
        return x is None
    if isinstance(f, EqualNullSafe):
        return x == f.value if x is not None and f.value is not None else x is f.value
    if x is None:
        return False
    if isinstance(f, IsNotNull):
        return True
    if isinstance(f, In):
        return x in f.value
    tests = {EqualTo: x.__eq__, GreaterThan: x.__gt__, GreaterThanOrEqual: x.__ge__, LessThan: x.__lt__, LessThanOrEqual: x.__le__}
    return tests[type(f)](f.value) is True


TRIED = (IsNull, IsNotNull, EqualNullSafe, In, EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, splits: str):
        self.fields, self.splits, self.filters = schema, splits, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Take those on whole columns of texts and whole numbers, whose comparison here is SQL's; give the others back."""
        plain = {f.name for f in self.fields.fields if isinstance(f.dataType, (StringType, IntegerType, LongType))}
        for f in filters:
            if isinstance(f, TRIED) and len(f.attribute) == 1 and f.attribute[0] in plain and (not isinstance(f, In) or None not in f.value):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Split]:
        with _opened(self.splits) as f:
            return [Split(*json.loads(line)) for line in f.read().splitlines()]

    def read(self, partition: Split) -> Iterator[tuple]:
        kinds = {f.name: f.dataType for f in self.fields.fields}
        for line in lines(partition.path, partition.at, partition.end, partition.first):
            if not line.strip():
                continue
            record = json.loads(line)
            if all(holds(f, value(record.get(f.attribute[0]), kinds[f.attribute[0]])) for f in self.filters):
                yield tuple(value(record.get(n), k) for n, k in kinds.items())


class Manifest(DataSource):
    """``split_manifest``: records of a schema. Options: splits (a file as :func:`write_splits` makes it)."""

    @classmethod
    def name(cls) -> str:
        return "split_manifest"

    def schema(self) -> str:
        return "id string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(schema, self.options["splits"])


def write_splits(members_: DataFrame, target: str, split: int = SPLIT) -> int:
    """Join neighbouring members of a file to splits of about ``split`` packed bytes; returns how many.

    The driver sees one row a split (as it does for any file scan) and writes the list to ``target``.
    """
    before = F.sum("size").over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    whole = F.lag("whole", 1, True).over(Window.partitionBy("path").orderBy("at"))
    rows = members_.withColumns({"n": F.floor(F.coalesce(before, F.lit(0)) / split), "first": whole})
    rows = rows.groupBy("path", "n").agg(F.min("at").alias("at"), F.max(F.col("at") + F.col("size")).alias("end"), F.min_by("first", "at").alias("first")).orderBy("path", "n")
    found = [json.dumps([r["path"], r["at"], r["end"], r["first"]]) for r in rows.toLocalIterator()]
    fs, at = pyarrow.fs.FileSystem.from_uri(target)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(at) as out:
        out.write("\n".join(found).encode())
    return len(found)


def read(spark: SparkSession, path: str, schema: str, split: int = SPLIT, known: DataFrame | None = None) -> DataFrame:
    """Records of all files under ``path``, many tasks a file. ``known`` is an index made before.

    Fields that a record lacks or that are of another type are null, unknown ones are left out, blank
    lines are passed over; a line that is no JSON fails the read. Turns on Spark's filter pushdown to
    Python sources for the session.
    """
    spark.dataSource.register(Manifest)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    target = qualified(spark, scratch.path(spark, "splits"))
    write_splits(index(spark, path) if known is None else known, target + "/list", split)
    return spark.read.format("split_manifest").schema(schema).option("splits", target + "/list").load()


def pack(texts: Iterator[bytes], uri: str, member: int = MEMBER) -> None:
    """Write lines as one gzip file of members of about ``member`` bytes of text, each of whole lines."""
    fs, at = pyarrow.fs.FileSystem.from_uri(uri)
    with fs.open_output_stream(at) as out:
        held, size = [], 0
        for line in texts:
            held.append(line + b"\n")
            size += len(line) + 1
            if size >= member:
                out.write(_packed(held))
                held, size = [], 0
        if held:
            out.write(_packed(held))


def _packed(parts: list[bytes]) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join(map(c.compress, parts)) + c.flush()


def write(cuts: DataFrame, folder: str, member: int = MEMBER) -> None:
    """Write records as ``part-NNNNN.jsonl.gz``, one file a partition, in members that can be read apart.

    A file comes under a draft name and is moved when it is whole, so a task that runs again replaces it.
    """
    uri = qualified(cuts.sparkSession, folder)

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, root = pyarrow.fs.FileSystem.from_uri(uri)
        fs.create_dir(root, recursive=True)
        draft = f"{root}/_draft-{context.partitionId()}-{context.taskAttemptId()}"
        scheme = uri.split("://", 1)[0]
        n = 0

        def every():
            nonlocal n
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    n += 1
                    yield text.encode()

        pack(every(), f"{scheme}://{draft}", member)
        fs.move(draft, f"{root}/part-{context.partitionId():05d}.jsonl.gz")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows = cuts.select(F.to_json(F.struct(*cuts.columns)).alias("line"))
    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()
