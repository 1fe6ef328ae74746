"""The block-diagonal causal mask of packed sequences, as intervals instead of a square.

Of T packed positions a query may look at the keys from its sequence's first position to itself, so a
row of the mask is one run (q, k_from, k_to). Any block of queries and keys is expanded from the
sequences that reach into it: both are cut at multiples of ``width``, meet by the number of the cut
piece (a hash join), and only what they share is expanded. Nothing of the size T x T is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import ordering

#: Positions in one bin of the range join.
WIDTH = 4_096


def segments(lengths: DataFrame, order: str, length: str = "length") -> DataFrame:
    """(segment, first, last) of sequences packed end to end in ``order``; empty ones take no place.

    ``lengths``: one row a sequence. A null length is 0. The key may be null (that sequence comes first).
    """
    rows = lengths.select(F.col(order).alias("segment"), F.coalesce(F.col(length).cast("long"), F.lit(0).cast("long")).alias("_n"))
    rows = ordering.running(rows, "first", None, ["segment", "_n"], value=F.col("_n"), inclusive=False)
    return rows.where("_n > 0").select("segment", F.col("first").cast("long").alias("first"), (F.col("first") + F.col("_n") - 1).cast("long").alias("last"))


def _bins(low: Column, high: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))


def intervals(packed: DataFrame, width: int = WIDTH) -> DataFrame:
    """(segment, q, k_from, k_to): the run of keys of every query, both ends belonging to it.

    Long sequences are cut into bins first, which spread before their queries are made.
    """
    cut = packed.withColumn("_bin", _bins(F.col("first"), F.col("last"), width)).repartition("_bin")
    q = F.explode(F.sequence(F.greatest("first", F.col("_bin") * width), F.least("last", (F.col("_bin") + 1) * width - 1)))
    return cut.select("segment", "first", q.alias("q")).select("segment", "q", F.col("first").alias("k_from"), F.col("q").alias("k_to"))


def expand(packed: DataFrame, blocks: DataFrame, width: int = WIDTH) -> DataFrame:
    """(block, q, k_from, k_to): the runs of allowed keys inside blocks of the mask; rows without any are left out.

    ``blocks``: block, q_from, q_to, k_from, k_to (both ends belong). Blocks may overlap, be of any size
    and reach beyond the packed positions. Sequence and block meet in each bin of queries that both
    reach, and are used in the part of the block that lies in that bin, so nothing counts twice.
    """
    left = packed.select("first", "last").withColumn("_bin", _bins(F.col("first"), F.col("last"), width))
    right = blocks.where("q_from <= q_to AND k_from <= k_to AND q_to >= 0 AND k_to >= 0")
    right = right.withColumn("_bin", _bins(F.greatest("q_from", F.lit(0)), F.col("q_to"), width))
    met = left.join(right, "_bin")
    low = F.greatest("first", "q_from", "k_from", F.col("_bin") * width)  # a query before k_from looks at no key of the block
    high = F.least("last", "q_to", (F.col("_bin") + 1) * width - 1)
    met = met.withColumns({"_low": low, "_high": high}).where("_low <= _high AND first <= k_to AND last >= k_from")
    rows = met.select("block", "first", "k_from", "k_to", F.explode(F.sequence("_low", "_high")).alias("q"))
    return rows.select("block", "q", F.greatest("first", "k_from").alias("k_from"), F.least("q", "k_to").alias("k_to"))


def additive(runs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, q, mask): the rows of each block as 0 and -infinity, one value a key, for all its queries.

    A block has to fit a task's memory row by row; choose its width for the consumer.
    """
    every = blocks.select("block", F.col("k_from").alias("_a"), F.col("k_to").alias("_b"), F.explode(F.sequence("q_from", "q_to")).alias("q"))
    rows = every.join(runs, ["block", "q"], "left")
    no, yes = F.lit(float("-inf")).cast("float"), F.lit(0.0).cast("float")
    before = F.coalesce(F.col("k_from") - F.col("_a"), F.lit(0)).cast("int")
    open_ = F.coalesce(F.col("k_to") - F.col("k_from") + 1, F.lit(0)).cast("int")
    after = (F.col("_b") - F.col("_a") + 1).cast("int") - before - open_
    return rows.select("block", "q", F.concat(F.array_repeat(no, before), F.array_repeat(yes, open_), F.array_repeat(no, after)).alias("mask"))


def tiles(packed: DataFrame, side: int) -> DataFrame:
    """(q_tile, k_tile, allowed): square tiles of the mask with an allowed pair, and how many they have.

    ``allowed`` = side * side is a full tile. For kernels that skip empty tiles. A sequence gives the
    tiles of its own triangle; counts are in closed form, no pair is made.
    """
    rows = packed.withColumn("q_tile", _bins(F.col("first"), F.col("last"), side)).repartition("q_tile")
    low, high = F.greatest("first", F.col("q_tile") * side), F.least("last", (F.col("q_tile") + 1) * side - 1)
    rows = rows.withColumns({"_low": low, "_high": high}).withColumn("k_tile", F.explode(F.sequence(F.floor(F.col("first") / side), F.floor(high / side))))
    k_low = F.greatest("first", F.col("k_tile") * side)
    k_high = (F.col("k_tile") + 1) * side - 1
    rows = rows.withColumns({"_k": k_low, "_kk": F.least(k_high, F.col("_high"))})
    # query q has min(q, k_high) - k_low + 1 keys: first rising by one, then as wide as the tile
    rising_from, rising_to = F.greatest("_low", "_k"), F.col("_kk")
    n = F.greatest(rising_to - rising_from + 1, F.lit(0))
    rising = ((rising_from - F.col("_k") + 1) + (rising_to - F.col("_k") + 1)) * n / 2
    wide_from = F.greatest("_low", F.col("_kk") + 1)
    wide = F.greatest(F.col("_high") - wide_from + 1, F.lit(0)) * (F.col("_kk") - F.col("_k") + 1)
    return rows.groupBy("q_tile", "k_tile").agg(F.sum((rising + wide).cast("long")).alias("allowed")).where("allowed > 0")
