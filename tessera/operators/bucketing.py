"""Length buckets from a mergeable quantile sketch, and batches that close as rows arrive.

The sketch counts lengths in bins that grow by a fixed ratio, so it has a few hundred rows for any
table, adds up over tables, files and days, and gives each quantile with a bounded relative error.
Buckets get equal shares of the total length, not of the rows. Rows are then read once: each shard
(one consumer) walks its rows in a seeded order and keeps one open batch a bucket; a row that doesn't
fit closes its bucket's batch and opens the next. A shard holds open batches only.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import ordering
from tessera.operators.batching import named_or_whole, seeded_key

#: Relative error of a sketch's quantiles.
ERROR = 0.01


def _ratio(error: float) -> float:
    return (1 + error) / (1 - error)


def sketch(df: DataFrame, length: str, error: float = ERROR) -> DataFrame:
    """(bin, n, total) of the positive lengths; combined in every task before the small shuffle.

    Null lengths and those of 0 or below aren't counted (batches put them into the first bucket).
    """
    x = F.col(length).cast("double")
    rows = df.where(x > 0).select(F.ceil(F.log(x) / F.lit(math.log(_ratio(error)))).cast("int").alias("bin"), x.alias("_x"))
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("_x").alias("total"))


def merged(*sketches: DataFrame) -> DataFrame:
    """The sketch of all rows of sketches made with one error."""
    rows = sketches[0]
    for s in sketches[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def bounds(counted: DataFrame, buckets: int, error: float = ERROR) -> list[float]:
    """Upper ends of all buckets but the last, so that each has an equal share of the total length.

    Each is within ``error`` (relative) of the length at which the exact running total of the rows in
    ascending length passes the share. Equal ends count once, so there may be fewer buckets. The
    driver gets one row a bin, at most log(longest / shortest) / (2 error).
    """
    rows = sorted((r["bin"], r["total"]) for r in counted.collect())
    every = math.fsum(t for _, t in rows)
    out: list[float] = []
    seen, ratio = 0.0, _ratio(error)
    for b, total in rows:
        seen += total
        while len(out) < buckets - 1 and seen >= every * (len(out) + 1) / buckets:
            out.append(2 * ratio**b / (ratio + 1))
    return sorted(set(out))


def bucket(length: Column, ends: list[float]) -> Column:
    """0-based bucket: a length belongs to the first bucket whose end it doesn't pass; null to the first."""
    if not ends:
        return F.lit(0).cast("long")
    below = ordering.place(F.array(*[F.lit(-e) for e in reversed(ends)]), -length.cast("double"), len(ends))
    return F.when(length.isNotNull(), F.lit(len(ends)) - below).otherwise(F.lit(0)).cast("long")


class OpenBatches:
    """One shard's open batches, a bucket each. ``add`` gives the batch that the row closes, if any."""

    def __init__(self, limit: float, padded: bool):
        self.limit, self.padded = limit, padded
        self.open: dict[int, list] = {}
        self.used: dict[int, tuple[float, int]] = {}
        self.number: dict[int, int] = {}

    def add(self, bucket: int, value: float, row: object) -> tuple[int, int, list] | None:
        held, widest = self.used.get(bucket, (0.0, 0))
        rows = self.open.get(bucket, [])
        widest = max(widest, value)
        needed = widest * (len(rows) + 1) if self.padded else held + value
        closed = None
        if rows and needed > self.limit:
            closed = (bucket, self.number.get(bucket, 0), rows)
            self.number[bucket] = self.number.get(bucket, 0) + 1
            rows, held, widest = [], 0.0, value
        rows.append(row)
        self.open[bucket], self.used[bucket] = rows, (held + value, widest)
        return closed

    def rest(self) -> list[tuple[int, int, list]]:
        return [(b, self.number.get(b, 0), rows) for b, rows in sorted(self.open.items())]


def dynamic_batches(df: DataFrame, id_column: str, length: str, value: str, limit: float, ends: list[float], seed: int, shards: int = 1, drop_last: bool = False, padded: bool = False) -> DataFrame:
    """Rows (id, length, value) with shard, bucket, batch_id (in shard and bucket), step and place.

    ``step`` numbers a shard's batches as they close; the open ones follow at the end by bucket, or are
    left out with ``drop_last``. The values of a batch sum to at most ``limit`` (with ``padded``: rows
    times the largest value); a larger row is alone. Shard and order come from digests of the id (rows
    without an id: of the row), equal ids go by length and value. Null values count 0. One shuffle of
    three columns; a shard is one task's stream, so take as many shards as there are consumers.
    """
    row_key = named_or_whole(df, id_column)
    rows = df.select(F.col(id_column), F.col(length), F.col(value), seeded_key(seed, row_key).alias("_h"), bucket(F.col(length), ends).alias("bucket"))
    rows = rows.withColumn("shard", (F.conv(F.substring(F.md5(F.concat(F.lit("shard|"), "_h")), 1, 8), 16, 10).cast("long") % shards).cast("int"))
    rows = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "_h", id_column, length, value)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = f"shard int, bucket long, batch_id long, step long, place long, `{id_column}` {kinds[id_column]}, `{length}` {kinds[length]}, `{value}` {kinds[value]}"
    names = ["shard", "bucket", "batch_id", "step", "place", id_column, length, value]

    def run(batches):
        state, shard, step, pieces, filled = OpenBatches(limit, padded), None, 0, [], []

        def emitted() -> pa.RecordBatch:
            table = pa.Table.from_batches([p for p, _ in pieces]).combine_chunks()
            own = [c.chunk(0) for c in table.columns[:3]]
            marks = [pa.array([x[i] for x in filled], pa.int32() if i == 0 else pa.int64()) for i in range(5)]
            pieces.clear()
            filled.clear()
            return pa.RecordBatch.from_arrays([*marks, *own], names=names)

        def close(done) -> None:
            nonlocal step
            b, number, held = done
            pieces.extend(held)
            filled.extend((shard, b, number, step, i) for i in range(len(held)))
            step += 1

        for batch in batches:
            at = batch.schema.names
            shard_of, bucket_of, values = (batch.column(at.index(c)).to_pylist() for c in ("shard", "bucket", value))
            for i, (s, b, x) in enumerate(zip(shard_of, bucket_of, values, strict=True)):
                if s != shard:
                    for done in () if drop_last or shard is None else state.rest():
                        close(done)
                    state, shard, step = OpenBatches(limit, padded), s, 0
                if (done := state.add(b, x or 0, (batch.slice(i, 1), None))) is not None:
                    close(done)
                    if len(pieces) >= 10_000:
                        yield emitted()
        for done in () if drop_last or shard is None else state.rest():
            close(done)
        if pieces:
            yield emitted()

    return rows.mapInArrow(run, schema)


def padding(batches: DataFrame, length: str, keys: tuple[str, ...] = ("shard", "bucket", "batch_id"), by: str = "bucket") -> DataFrame:
    """Per bucket: batches, rows, length used, length with every row padded to its batch's longest, and the share lost."""
    sizes = batches.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(length).alias("_used"), F.max(length).alias("_max"))
    out = sizes.groupBy(by).agg(F.count(F.lit(1)).alias("batches"), F.sum("_n").alias("rows"), F.sum("_used").alias("used"), F.sum(F.col("_n") * F.col("_max")).alias("padded"))
    return out.withColumn("waste", F.when(F.col("padded") > 0, 1 - F.col("used") / F.col("padded")).otherwise(F.lit(0.0)))
