"""Ordering, mixing and batching of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import ordering
from tessera.sources import scratch

#: Rows that one fold takes; larger buckets are folded in runs of this many.
RUN = 4096


def seeded_key(seed: int, key: Column) -> Column:
    """Uniform hexadecimal key of a deterministic shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def named_or_whole(df: DataFrame, key: str) -> Column:
    """The key as text; where it is null, a digest of the row, so that rows without a key spread as others do."""
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.coalesce(F.col(key).cast("string"), F.concat(F.lit("no key "), F.xxhash64(*plain).cast("string")))


def seeded_shuffle(df: DataFrame, seed: int, key: str, name: str = "rank") -> DataFrame:
    """Add the 0-based place of each row in a seeded order; the same on every run. Rows without a key have places too."""
    rows = df.withColumn("_h", seeded_key(seed, named_or_whole(df, key)))
    return ordering.position(rows, name, ordering.hex_bucket("_h", ordering.hex_digits(df.count())), ["_h", key]).drop("_h")


def fixed_batches(index: Column, size: int) -> Column:
    return F.floor(index / size).cast("long")


def micro_batches(index: Column, outer: int, inner: int) -> tuple[Column, Column]:
    """(outer batch, micro-batch in it); micro-batches never span outer batches."""
    return F.floor(index / outer).cast("long"), F.floor((index % outer) / inner).cast("long")


def batch_order(df: DataFrame, batch: str, id_column: str, duration: str = "duration") -> DataFrame:
    """Rank inside a batch, longest first; ties by id. Batches are small by construction."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(batch).orderBy(F.desc(duration), id_column)).cast("long"))


def weighted_mux(df: DataFrame, source: str, weight: str, key: str, name: str = "rank") -> DataFrame:
    """Interleave sources: the i-th row of a source stands at (i - 0.5) / weight; ties by source.

    Rows whose weight is null or 0 come first. A null source is one source; null keys come first in theirs.
    """
    rows = ordering.running(df, "_i", None, [key], within=[source])
    rows = rows.withColumn("_at", F.try_divide(F.col("_i") - 0.5, F.col(weight).cast("double")))
    return ordering.position(rows, name, None, ["_at", source, key]).drop("_i", "_at")


def _fold(rows: Column, limit: float, kind: str) -> Column:
    """Greedy batches over array<struct<o, id, v>>: a row opens a batch if it doesn't fit any more."""
    start = F.struct(F.lit(-1).cast("long").alias("batch"), F.lit(0).cast(kind).alias("total"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["batch"] >= 0) & (acc["total"] + x["v"] <= F.lit(limit))
        batch = F.when(fits, acc["batch"]).otherwise(acc["batch"] + 1)
        total = F.when(fits, acc["total"] + x["v"]).otherwise(x["v"]).cast(kind)
        return F.struct(batch.alias("batch"), total.alias("total"), F.concat(acc["out"], F.array(batch)).alias("out"))

    return F.aggregate(rows, start, step)["out"]


def bounded_batches(df: DataFrame, id_column: str, length: str, value: str, limit: float, buckets: int, seed: int, drop_last: bool = False) -> DataFrame:
    """Batches of rows of like length whose values sum to at most ``limit`` (a larger row is alone).

    Buckets are tiles of ``length``; a bucket is walked in seeded order, in runs of ``RUN`` rows,
    and each run is folded by itself, so no task takes more. Adds bucket, run, batch_id (0-based in
    a run). With ``drop_last`` the last, still open batch of each run is left out.
    """
    # read several times below (bounds, totals, rows), so what made the rows runs once
    df = scratch.materialize(df.select(*dict.fromkeys([id_column, length, value])), "sized")
    kind = dict(df.dtypes)[value]
    kind = "double" if kind in ("double", "float") else "bigint"
    total = df.count()
    placed = ordering.position(df, "_p", None, [length, id_column], n=total)
    placed = placed.withColumn("bucket", ordering.ntile(F.col("_p"), F.lit(total), buckets)).withColumn("_h", seeded_key(seed, named_or_whole(df, id_column)))
    placed = ordering.position(placed, "_q", ordering.hex_bucket("_h", ordering.hex_digits(total // buckets)), ["_h", id_column], within=["bucket"])
    placed = placed.withColumn("run", F.floor(F.col("_q") / RUN).cast("long"))
    groups = placed.groupBy("bucket", "run").agg(F.array_sort(F.collect_list(F.struct(F.col("_q").alias("o"), F.col(id_column).alias("id"), F.col(value).cast(kind).alias("v")))).alias("rows"))
    out = groups.withColumn("b", _fold(F.col("rows"), limit, kind)).select("bucket", "run", F.explode(F.arrays_zip("rows", "b")).alias("z"))
    out = out.select("bucket", "run", F.col("z.b").alias("batch_id"), F.col("z.rows.id").alias(id_column), F.col("z.rows.v").alias(value))
    if drop_last:
        last = Window.partitionBy("bucket", "run")
        out = out.withColumn("_last", F.max("batch_id").over(last)).where("batch_id < _last").drop("_last")
    return out


def repeat_epochs(df: DataFrame, epochs: int) -> DataFrame:
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))))
