"""Batches laid out in the order of training, with an index to go on exactly where a run stopped.

An epoch is written in the order of its steps: steps are the batches in an order drawn by (seed,
epoch), ``STEPS`` of them lie in one part (a folder), sorted by step. The index has one row a step and
says in which part, and at which rows of it and of the epoch, the step lies. Reading from a step on
leaves out whole epochs and parts by their folders, and what lies before in the first part by a filter
on the sorted step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import ordering
from tessera.sources import scratch

#: Steps in one part.
STEPS = 1_000


def steps(batches: DataFrame, keys: list[str], seed: int, epoch: int) -> DataFrame:
    """keys, n_rows and step (from 0) of every batch, in the order drawn for the epoch."""
    sizes = batches.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    name = F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    rows = scratch.materialize(sizes.withColumn("_h", F.md5(name)), "batches")
    return ordering.position(rows, "step", None, ["_h", *keys]).drop("_h").withColumn("step", F.col("step").cast("long"))


def write_epochs(batches: DataFrame, keys: list[str], order: str, path: str, seed: int, epochs: range, per_part: int = STEPS) -> DataFrame:
    """Write ``epochs`` of the batches (rows with ``keys`` and ``order``, the place in a batch), return the index.

    Under ``path``: ``rows/epoch=/part=`` and ``index/epoch=``. An epoch that is written again replaces
    itself. Null keys are keys. The rows of a part are one task's; parts are of bounded size.
    """
    spark = batches.sparkSession
    for epoch in epochs:
        drawn = steps(batches, keys, seed, epoch)
        index = ordering.running(drawn, "epoch_row", None, ["step"], value=F.col("n_rows"), inclusive=False)
        index = index.withColumns({"part": F.floor(F.col("step") / per_part), "epoch_row": F.col("epoch_row").cast("long")})
        first = index.where(F.col("step") % per_part == 0).select("part", F.col("epoch_row").alias("_first"))
        index = scratch.materialize(index.join(first, "part").withColumn("part_row", F.col("epoch_row") - F.col("_first")).drop("_first"), "index")
        index.repartition(1 + index.count() // 1_000_000).sortWithinPartitions("step").write.mode("overwrite").parquet(f"{path}/index/epoch={epoch}")
        rows = ordering.with_totals(batches, index.select(*keys, "step", "part"), keys)
        rows = rows.repartition("part").sortWithinPartitions("part", "step", order)
        rows.write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows/epoch={epoch}")
    return spark.read.parquet(f"{path}/index")


def part_steps(spark: SparkSession, path: str) -> int:
    """Steps of a part, as the layout was written."""
    found = spark.read.parquet(f"{path}/index").where("part = 0").agg(F.max("step")).first()[0]
    return 0 if found is None else found + 1


def read_from(spark: SparkSession, path: str, epoch: int, step: int = 0) -> DataFrame:
    """All rows from a step of an epoch on, with epoch, part and step; epochs and parts before aren't read."""
    rows = spark.read.parquet(f"{path}/rows")
    here = F.col("epoch") == epoch
    if step:
        here = here & (F.col("part") >= step // max(part_steps(spark, path), 1)) & (F.col("step") >= step)
    return rows.where((F.col("epoch") > epoch) | here)


def locate(spark: SparkSession, path: str, epoch: int, rows: int) -> tuple[int, int]:
    """(step, rows of it that are done) of a run that has read ``rows`` rows of an epoch."""
    index = spark.read.parquet(f"{path}/index").where((F.col("epoch") == epoch) & (F.col("epoch_row") <= rows))
    found = index.agg(F.max(F.struct("step", "epoch_row", "n_rows")).alias("at")).first()["at"]
    if found is None:
        return 0, 0
    done = rows - found["epoch_row"]
    return (found["step"] + 1, 0) if done >= found["n_rows"] else (found["step"], done)


def pruned(df: DataFrame, columns: tuple[str, ...] = ("epoch", "part")) -> bool:
    """Whether the scan of ``df`` picks folders by all these columns."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    at = plan.find("PartitionFilters: [")
    filters = plan[at : plan.find("PushedFilters", at)] if at >= 0 else ""
    return reduce(lambda a, c: a and c + "#" in filters, columns, True)
