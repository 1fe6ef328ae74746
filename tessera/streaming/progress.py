"""Progress of streams as a table: what each micro-batch wrote and how long it took.

The counts of a micro-batch are observed while it is written and stored under its number right after,
before the batch counts as done. A batch that runs again after a failure overwrites both its rows and
its progress, so the table's totals are those of the sink at any time. What only the engine knows
(durations, rates) comes from a listener and is stored beside.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow.fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tessera.sources.named_files import qualified

COUNTS = "batch long, rows long, metrics map<string,double>"
ENGINE = "batch long, id string, input_rows long, seconds double, rows_per_second double"


def _put(folder: str, name: str, record: dict) -> None:
    """A small file, complete or not there."""
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/_draft-{name}") as out:
        out.write(json.dumps(record).encode())
    fs.move(f"{root}/_draft-{name}", f"{root}/{name}.json")


class Listener(StreamingQueryListener):
    """Stores what the engine reports of each micro-batch of one query (by its name)."""

    def __init__(self, folder: str, query: str):
        self.folder, self.query = folder, query

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.name == self.query:
            seconds = p.batchDuration / 1000
            _put(f"{self.folder}/engine", f"{p.batchId:012d}", {"batch": p.batchId, "id": str(p.id), "input_rows": p.numInputRows, "seconds": seconds, "rows_per_second": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def write(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, folder: str, metrics: dict[str, Column] | None = None, once: bool = True, name: str = "stream") -> StreamingQuery:
    """Apply a batch operator to each micro-batch, write it under its number, and its progress to ``folder``.

    ``metrics`` are further sums or counts over the written rows. Each is one pass with the write.
    """
    spark = stream.sparkSession
    at = qualified(spark, folder)

    def each(batch: DataFrame, number: int) -> None:
        seen = Observation(f"batch-{number}")
        counts = [F.count(F.lit(1)).alias("rows"), *[c.cast("double").alias(k) for k, c in (metrics or {}).items()]]
        transform(batch).observe(seen, *counts).write.mode("overwrite").parquet(f"{out}/batch={number}")
        got = seen.get
        _put(f"{at}/counts", f"{number:012d}", {"batch": number, "rows": got["rows"], "metrics": {k: got[k] for k in metrics or {}}})

    listener = Listener(at, name)
    spark.streams.addListener(listener)
    writer = stream.writeStream.queryName(name).foreachBatch(each).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if once else writer).start()
    query.listener = listener  # for spark.streams.removeListener
    return query


def table(spark: SparkSession, folder: str) -> DataFrame:
    """One row a micro-batch: batch, rows, metrics, and rows so far."""
    from tessera.operators import ordering

    rows = spark.read.schema(COUNTS).json(f"{folder}/counts")
    return ordering.running(rows, "so_far", None, ["batch"], value=F.col("rows"))


def engine(spark: SparkSession, folder: str) -> DataFrame:
    """What the listener stored: one row a micro-batch that was reported."""
    return spark.read.schema(ENGINE).json(f"{folder}/engine")
