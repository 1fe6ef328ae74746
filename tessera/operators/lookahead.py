"""Generation in micro-batches with a bounded look-ahead, and a sink that a stopped run goes on with.

Input rows have a place; ``outer`` of them in a row are an outer batch. A task takes whole outer
batches. Up to twice the micro-batch of rows are prepared ahead by threads while the model works, in
input order. A micro-batch never holds rows of two outer batches; the rest of an outer batch is a
micro-batch of its own. A row whose preparation fails is kept apart with its error and takes no place
in a micro-batch.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import ordering
from tessera.operators.generate import Generator
from tessera.sources import scratch

Prepare = Callable[[dict], str | None]
#: Column of the scratch tables: number of the job.
WAVE = "_wave"
#: Columns that generation adds; ``status`` is 'ok' or 'failed'.
ADDED = "micro long, place long, response string, finish_reason string, error string, status string"


class Feed:
    """Prepared rows of one outer batch after another: (row, prompt or error), at most ``ahead`` in preparation."""

    def __init__(self, rows: Iterator[tuple[object, pa.RecordBatch, dict]], prepare: Prepare, ahead: int, pool: ThreadPoolExecutor):
        self.rows, self.prepare, self.ahead, self.pool = rows, prepare, ahead, pool
        self.waiting: deque = deque()
        self.most = 0  # rows that were in preparation at once

    def _safe(self, row: dict) -> tuple[str | None, str | None]:
        try:
            prompt = self.prepare(row)
        except Exception as e:  # any failure of a row's preparation concerns that row alone
            return None, f"{type(e).__name__}: {e}"
        return (prompt, None) if prompt is not None else (None, "no prompt")

    def __iter__(self) -> Iterator[tuple[object, pa.RecordBatch, str | None, str | None]]:
        more = True
        while more or self.waiting:
            while more and len(self.waiting) < self.ahead:
                found = next(self.rows, None)
                if found is None:
                    more = False
                    break
                outer, piece, row = found
                self.waiting.append((outer, piece, self.pool.submit(self._safe, row)))
                self.most = max(self.most, len(self.waiting))
            if self.waiting:
                outer, piece, result = self.waiting.popleft()
                yield outer, piece, *result.result()


def micro_batches(feed, size: int) -> Iterator[tuple[int, list, list]]:
    """(number in the outer batch, rows with prompts, failed rows before its end) from a feed."""
    ready: list = []
    failed: list = []
    current, number = None, 0
    for outer, piece, prompt, error in feed:
        if outer != current:
            if ready or failed:
                yield number, ready, failed
            current, number, ready, failed = outer, 0, [], []
        if error is not None:
            failed.append((piece, error))
            continue
        ready.append((piece, prompt))
        if len(ready) == size:
            yield number, ready, failed
            number, ready, failed = number + 1, [], []
    if ready or failed:
        yield number, ready, failed


def generate(df: DataFrame, outer: str, order: list[str], prepare: Prepare, make: Callable[[], Generator], size: int = 32, threads: int = 4, partitions: int | None = None) -> DataFrame:
    """``df`` with :data:`ADDED`: its outer batch's micro-batch, the place in it, and response or error.

    ``prepare`` turns a row (a dict) into a prompt; an exception or None fails the row. ``make`` runs
    once a task. Rows of an outer batch go to one task, in ``order``; null outer batches are one batch.
    """
    names = [c for c in df.columns if c not in {x.split()[0] for x in ADDED.split(", ")}]
    rows = df.select(*names)
    rows = (rows.repartition(partitions, outer) if partitions else rows.repartition(outer)).sortWithinPartitions(outer, *order)
    at = names.index(outer)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), ADDED])

    def pieces(batches):
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                yield batch.column(at)[i].as_py(), batch.slice(i, 1), row

    def joined(parts: list[pa.RecordBatch], *added: list) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
        columns = [c.chunk(0) for c in table.columns] + [pa.array(x, k) for x, k in zip(added, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=[*table.schema.names, *(x.split()[0] for x in ADDED.split(", "))])

    def run(batches):
        model = None
        with ThreadPoolExecutor(threads) as pool:
            for number, ready, failed in micro_batches(Feed(pieces(batches), prepare, 2 * size, pool), size):
                if failed:
                    none, n = [None] * len(failed), len(failed)
                    yield joined([p for p, _ in failed], none, none, none, none, [e for _, e in failed], ["failed"] * n)
                if ready:
                    model = model or make()
                    out, n = model([p for _, p in ready]), len(ready)
                    yield joined([p for p, _ in ready], [number] * n, list(range(n)), [x for x, _ in out], [y for _, y in out], [None] * n, ["ok"] * n)

    return rows.mapInArrow(run, schema)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(at) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(at))


def generate_into(df: DataFrame, key: str, order: list[str], path: str, prepare: Prepare, make: Callable[[], Generator], outer: int = 2048, size: int = 32, wave: int = 64, threads: int = 4) -> DataFrame:
    """Generate for all rows of ``df`` that ``path`` doesn't hold yet, and return what it holds then.

    ``path`` is a table of Parquet files by status (``status=ok``, ``status=failed``). Places in
    ``order`` number the outer batches, the same in every run over the same input. ``wave`` outer
    batches are one job, so a run that is stopped leaves whole jobs behind; the next one leaves out the
    rows (by key and place, null keys too) that are there, failed ones included, and writes the others.
    """
    spark = df.sparkSession
    placed = ordering.position(df, "position", None, order).withColumn("position", F.col("position").cast("long"))
    placed = placed.withColumn("outer", F.floor(F.col("position") / outer).cast("long"))
    placed = placed.withColumn(WAVE, F.floor(F.col("outer") / wave).cast("long"))
    rows = scratch.materialize(placed, "prompts", WAVE)  # a job reads the files of its wave, not the whole table
    if _exists(spark, path):
        done = spark.read.parquet(path).select(F.col(key).alias("_key"), F.col("position").alias("_position"))
        rows = scratch.materialize(rows.join(done, (rows["position"] == done["_position"]) & rows[key].eqNullSafe(done["_key"]), "left_anti"), "open-prompts", WAVE)
    for number in sorted(r[0] for r in rows.select(WAVE).distinct().collect()):
        part = rows.where(F.col(WAVE) == number).drop(WAVE)
        generate(part, "outer", ["position"], prepare, make, size, threads).write.mode("append").partitionBy("status").parquet(path)
    if not _exists(spark, path):  # no rows at all
        generate(rows.drop(WAVE), "outer", ["position"], prepare, make, size, threads).write.mode("append").parquet(path)
    return spark.read.parquet(path)
