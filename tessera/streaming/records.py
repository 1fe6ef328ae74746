"""File streams over the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_trigger: int = 1) -> DataFrame:
    """New files of a folder; a bounded number a trigger keeps producers and consumer in step."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def write_batches(df: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Apply a batch operator to each micro-batch and write it under its own number.

    A batch that runs again after a failure overwrites its folder, so each row is written once.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
