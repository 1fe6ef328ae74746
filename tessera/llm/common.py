"""What the corpus operators share: scratch tables, id-ordered buckets, small array tools."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only a local master may go without the setting (tests): then a local folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.getCheckpointDir():
            return spark.sparkContext.getCheckpointDir()
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tessera-scratch/{uuid.uuid4().hex}-{name}"
    _SCRATCH.add(path)
    return path


_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage in a way that outlives lost executors. The files go when the driver ends,
    or with :func:`clear_scratch`. With ``rows`` at most so many go to a Python worker at once,
    which bounds what the JVM and the worker hold of wide rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    usual = spark.conf.get(_ARROW_ROWS)
    if rows:
        spark.conf.set(_ARROW_ROWS, str(min(rows, int(usual)) if int(usual) > 0 else rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_ARROW_ROWS, usual)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of whole texts that go to a Python worker at once.
TEXT_ROWS = 1_000


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to TEXT_ROWS rows (never raise them).

    A batch is held by the JVM, on its way and by the worker; texts make it large. Operators that
    return a lazy result over texts call this, as the setting counts when the result is read.
    """
    usual = int(spark.conf.get(_ARROW_ROWS))
    if not 0 < usual <= TEXT_ROWS:
        spark.conf.set(_ARROW_ROWS, str(TEXT_ROWS))


def spare_name(name: str, columns: list[str]) -> str:
    """``name`` with underscores before it until no column is called so (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def clear_scratch(spark: SparkSession) -> None:
    """Delete every scratch table; DataFrames built on them become unreadable."""
    jvm = spark.sparkContext._jvm
    for path in list(_SCRATCH):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _SCRATCH.discard(path)


@atexit.register
def _clear_at_exit() -> None:
    spark = SparkSession.getActiveSession() if _SCRATCH else None
    if spark is not None:
        try:
            clear_scratch(spark)
        except Exception:  # the JVM may be gone already
            _SCRATCH.clear()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_bucket(ids: DataFrame, key: str, n: int) -> Column:
    """Expression 0..n-1 that is monotone in ``key``: equal-count ranges from a quantile sketch.

    Only the key column is scanned; the sketch has a fixed size. Null keys go to bucket 0.
    """
    if n <= 1:
        return F.lit(0)
    cuts = ids.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.1 / n)
    cuts = sorted(set(cuts))
    if not cuts:
        return F.lit(0)
    bounds = F.array(*[F.lit(float(c)) for c in cuts])
    return F.coalesce(F.size(F.filter(bounds, lambda c: c < F.col(key))), F.lit(0))


def order_by_id(docs: DataFrame, key: str, n: int, first_also_before: bool = False) -> DataFrame:
    """Deal rows into ``n`` partitions of ascending ``key`` ranges, sorted inside; adds ``_bucket``.

    With ``first_also_before`` the rows with the smallest key of each bucket are also sent to the
    end of the nearest earlier bucket that has rows (of the first: to the last), with ``_extra``
    true, so a partition knows its successor. One shuffle of the rows; only n keys reach the driver.
    """
    bucket = id_bucket(docs, key, n)
    rows = docs.withColumn("_bucket", bucket)
    if first_also_before:
        least = docs.select(bucket.alias("b"), F.struct(key).alias("k")).groupBy("b").agg(F.min("k"))  # nulls first, as in the sort
        firsts = sorted(((r[0], r[1][0]) for r in least.collect()), key=lambda r: r[0])
        if firsts:
            # bucket -> (its first key, the nearest earlier bucket with rows, cyclic)
            before = {b: (k, firsts[i - 1][0]) for i, (b, k) in enumerate(firsts)}
            slots = F.array(*[F.lit(before[b][1] if b in before else None).cast("int") for b in range(n)])
            keys = F.array(*[F.lit(before[b][0] if b in before else None).cast("long") for b in range(n)])
            is_first = F.get(keys, F.col("_bucket")).eqNullSafe(F.col(key).cast("long")) & F.get(slots, F.col("_bucket")).isNotNull()
            own = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("x"))
            again = F.struct(F.get(slots, F.col("_bucket")).alias("b"), F.lit(True).alias("x"))
            rows = rows.withColumn("_copy", F.explode(F.when(is_first, F.array(own, again)).otherwise(F.array(own))))
            rows = rows.withColumn("_bucket", F.col("_copy.b")).withColumn("_extra", F.col("_copy.x")).drop("_copy")
        else:
            rows = rows.withColumn("_extra", F.lit(False))
        return rows.repartitionById(n, F.col("_bucket")).sortWithinPartitions("_extra", key)
    return rows.repartitionById(n, F.col("_bucket")).sortWithinPartitions(key)


_MEMOS: dict[str, Callable[[], None]] = {}


def remember(owner: str, forget: Callable[[], None]) -> None:
    """Say how to drop what an operator keeps in a Python worker between tasks."""
    _MEMOS[owner] = forget


def tidy() -> None:
    """Give memory that a finished task has freed back to the system; workers live on idle."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_batches(batches, rows: int = 2000, size: int = 4_000_000, owner: str = ""):
    """Slice Arrow batches so that one slice holds few rows and few bytes.

    A worker serves tasks of several operators in turn; what others than ``owner`` keep is dropped.
    """
    for name in [x for x in _MEMOS if x != owner]:
        _MEMOS.pop(name)()
    for batch in batches:
        n, at = batch.num_rows, 0
        while at < n:
            step = min(rows, n - at)
            while step > 1 and batch.slice(at, step).nbytes > size:
                step //= 2
            yield batch.slice(at, step)
            at += step
    tidy()


#: Most ids that are broadcast; with more, rows are matched by a shuffle.
BROADCAST_IDS = 2_000_000


def without(docs: DataFrame, ids: DataFrame, doc_id: str) -> DataFrame:
    """``docs`` without the rows whose id is in the one column of ``ids``; null ids stay."""
    ids = materialize(ids.select(F.col(ids.columns[0]).alias("_gone")).where("_gone IS NOT NULL").distinct(), "gone")
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs[doc_id] == ids["_gone"], "left_anti")


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]
