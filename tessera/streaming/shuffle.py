"""Buffered shuffle of an endless stream of epochs.

Each shard keeps a bounded buffer as streaming state. A row that comes to a full buffer takes the place
of a row drawn by (seed, shard, epoch, number of the row), which goes out; when the next epoch's first
row comes, what is left goes out in drawn order. So every epoch is complete, has an order of its own,
and is the same in every run, whatever the micro-batches are and however often the query restarts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators import ordering

_STATE = "epoch long, seen long, sent long, held array<string>"
_OUT = "shard int, epoch long, place long, row string"


def draw(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("|".join(map(str, parts)).encode(), digest_size=8).digest(), "big")


class Buffer:
    """One shard's buffer; ``push`` gives what goes out, as (epoch, place, item)."""

    def __init__(self, seed: int, shard: int, size: int, epoch: int = -1, seen: int = 0, sent: int = 0, held: list[str] | None = None):
        self.seed, self.shard, self.size = seed, shard, size
        self.epoch, self.seen, self.sent, self.held = epoch, seen, sent, held or []

    def push(self, epoch: int, item: str | None) -> Iterator[tuple[int, int, str]]:
        """A row of an epoch; None only says that the epoch before is over."""
        if epoch < self.epoch:
            raise ValueError(f"a row of epoch {epoch} after epoch {self.epoch} began")
        if epoch > self.epoch:
            order = sorted(range(len(self.held)), key=lambda i: (draw(self.seed, self.shard, self.epoch, "rest", i), i))
            for i in order:
                yield self._out(self.held[i])
            self.epoch, self.seen, self.sent, self.held = epoch, 0, 0, []
        if item is None:
            return
        if len(self.held) < self.size:
            self.held.append(item)
        else:
            i = draw(self.seed, self.shard, epoch, self.seen) % self.size
            out, self.held[i] = self.held[i], item
            yield self._out(out)
        self.seen += 1

    def _out(self, item: str) -> tuple[int, int, str]:
        self.sent += 1
        return self.epoch, self.sent - 1, item


def buffered_shuffle(stream: DataFrame, seed: int, size: int, shards: int = 1, epoch: str = "epoch", pos: str = "pos") -> DataFrame:
    """(shard, epoch, place and the stream's other columns), each shard and epoch in a drawn order.

    ``pos`` is a row's place in its epoch; shard is ``pos`` modulo ``shards``. Rows of a shard come in
    order of epoch and place, over micro-batches too (rows of one micro-batch may be in any order). A row
    with a null place (one a shard: see :func:`epoch_end`) ends its predecessors' epoch. State per shard
    is ``size`` rows as JSON.
    """
    rest = [f for f in stream.schema.fields if f.name not in (epoch, pos, "shard", "place")]
    columns = {f.name for f in stream.schema.fields}
    shard = F.coalesce((F.col(pos) % shards).cast("int"), F.col("shard").cast("int") if "shard" in columns else F.lit(0))
    kind = "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in rest) + ">"
    row = F.when(F.col(pos).isNotNull(), F.to_json(F.struct(*[F.col(f.name) for f in rest])))
    rows = stream.select(shard.alias("shard"), F.col(epoch).cast("long").alias("epoch"), F.col(pos).cast("long").alias("pos"), row.alias("row"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer = Buffer(seed, key[0], size, *state.get) if state.exists else Buffer(seed, key[0], size)
        got = pd.concat(list(frames)).sort_values(["epoch", "pos"], na_position="first")
        out = [x for e, r in zip(got["epoch"].tolist(), got["row"].tolist(), strict=True) for x in buffer.push(e, r)]
        state.update((buffer.epoch, buffer.seen, buffer.sent, buffer.held))
        yield pd.DataFrame({"shard": [key[0]] * len(out), "epoch": [x[0] for x in out], "place": [x[1] for x in out], "row": [x[2] for x in out]})

    mixed = rows.groupBy("shard").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
    return mixed.select("shard", "epoch", "place", F.from_json("row", kind).alias("r")).select("shard", "epoch", "place", "r.*")


def epoch_end(spark: SparkSession, like: DataFrame, epoch: int, shards: int = 1) -> DataFrame:
    """Rows of the columns of ``like`` (and shard) that end all epochs before ``epoch``; for finite runs."""
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema.fields if f.name not in ("epoch", "shard")]
    return spark.range(shards).select(F.lit(epoch).cast("long").alias("epoch"), F.col("id").cast("int").alias("shard"), *none).select(*like.columns, *[] if "shard" in like.columns else ["shard"])


def endless(spark: SparkSession, rows: DataFrame, order: list[str], per_trigger: int = 10_000, partitions: int = 8) -> DataFrame:
    """A stream that gives ``rows`` in ``order`` again and again: their columns, epoch and pos.

    The source only counts; its offsets are all that a restart needs. The table is joined by place.
    """
    placed = ordering.position(rows, "pos", None, order).withColumn("pos", F.col("pos").cast("long"))
    n = rows.count()
    if not n:
        raise ValueError("no rows to repeat")
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", per_trigger).option("numPartitions", partitions).load()
    return ticks.select(F.floor(F.col("value") / n).alias("epoch"), (F.col("value") % n).alias("pos")).join(placed, "pos")
