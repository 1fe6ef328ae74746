"""Minimax contiguous sharding of ordered atomic groups.

Groups of equal texts, in the order of their smallest doc_id, are cut into K contiguous shards so
that the largest shard is as small as can be. The smallest feasible capacity is found by binary
search; a greedy pass checks a capacity: fill a shard to the capacity, cut, go on.

Group sizes stay distributed. The driver sees a bounded number of blocks (runs of groups) with
their sums. With blocks only, a greedy pass gives a lower and an upper bound for each cut; blocks
in which a cut may still fall are split finer by another scan, until the cuts are exact.

A group larger than an even share gets a shard of its own (it alone decides the minimax value);
the others are cut over the shards that are left. So one huge group doesn't leave shards empty.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import id_bucket, materialize, partitions

BLOCKS = 20_000


@dataclass
class Cuts:
    """Ends of the shards as offsets in the running sum of sizes; the last is the total."""

    capacity: int
    ends: list[int]


def _greedy(edges: list[int], atomic: list[bool], capacity: int, shards: int) -> tuple[list[int], list[int]]:
    """Lower and upper bounds of the cut offsets. ``edges``: known group ends from 0 to the total;
    ``atomic[i]``: the block edges[i]..edges[i+1] is one group."""
    low, high, lows, highs = 0, 0, [], []
    for _ in range(shards):
        i = bisect.bisect_right(edges, low + capacity) - 1
        low = edges[i]
        j = bisect.bisect_right(edges, high + capacity) - 1
        high = edges[j] if j == len(edges) - 1 or atomic[j] else high + capacity
        lows.append(low)
        highs.append(high)
    return lows, highs


def minimax(blocks: list[tuple[int, int, bool]], largest: int, shards: int, refine) -> Cuts:
    """Smallest capacity and its greedy cuts.

    ``blocks``: (start, end, is one group), contiguous in the running sum. ``refine(ranges, n)``
    gives at least ``n`` blocks for offset ranges, or one a group.
    """
    total = blocks[-1][1] if blocks else 0
    if not total:
        return Cuts(0, [0] * shards)
    while True:
        edges = [b[0] for b in blocks] + [total]
        atomic = [b[2] for b in blocks]
        least = max(largest, -(-total // shards))
        # smallest capacity that is feasible for sure, and the largest that surely isn't
        a, b = least, total
        while a < b:
            c = (a + b) // 2
            if _greedy(edges, atomic, c, shards)[0][-1] >= total:
                b = c
            else:
                a = c + 1
        sure = a
        a, b = least, sure
        while a < b:
            c = (a + b) // 2
            if _greedy(edges, atomic, c, shards)[1][-1] >= total:
                b = c
            else:
                a = c + 1
        maybe = a
        lows = _greedy(edges, atomic, maybe, shards)[0]
        highs = _greedy(edges, atomic, sure, shards)[1]
        if maybe == sure:
            exact, upper = _greedy(edges, atomic, sure, shards)
            if exact == upper:
                return Cuts(sure, exact)
        # open intervals in which a cut may fall, out to block edges; at most one a shard
        spans = []
        for lo, hi in zip(lows, highs, strict=True):
            i, j = bisect.bisect_right(edges, lo) - 1, bisect.bisect_left(edges, hi)
            if any(not x for x in atomic[i:j]):
                spans.append((edges[i], edges[j]))
        ranges: list[list[int]] = []
        for start, end in sorted(spans):
            if ranges and start <= ranges[-1][1]:
                ranges[-1][1] = max(end, ranges[-1][1])
            else:
                ranges.append([start, end])
        wanted = [(r[0], r[1]) for r in ranges]
        firsts = [r[0] for r in wanted]
        inside = lambda x: (at := bisect.bisect_right(firsts, x[0]) - 1) >= 0 and x[1] <= wanted[at][1]
        kept = [x for x in blocks if not inside(x)]
        blocks = sorted(kept + refine(wanted, 2 * (len(blocks) - len(kept))))


def _blocks(groups: DataFrame, ranges: list[tuple[int, int]] | None, count: int) -> list[tuple[int, int, bool]]:
    """Blocks of the groups in the offset ranges: about ``count`` runs of equally many groups."""
    if ranges is None:
        part = groups.withColumn("_r", F.lit(0))
    else:
        starts = F.array(*[F.lit(s).cast("long") for s, _ in ranges])
        ends = F.array(*[F.lit(e).cast("long") for _, e in ranges])
        part = groups.withColumn("_r", F.size(F.filter(starts, lambda s: s <= F.col("start"))) - 1)
        part = part.where((F.col("_r") >= 0) & (F.col("end") <= F.get(ends, F.col("_r"))))
    step = max(1, -(-part.count() // count))
    rows = part.groupBy("_r", F.floor(F.col("place") / F.lit(step)).alias("b")).agg(F.min("start").alias("s"), F.max("end").alias("e"), F.count(F.lit(1)).alias("n")).select("s", "e", "n").collect()
    return sorted((r[0], r[1], r[2] == 1) for r in rows)


def _running(groups: DataFrame) -> DataFrame:
    """Add start and end offsets in group order: running sums inside id ranges plus range offsets."""
    spark = groups.sparkSession
    spread = groups.withColumn("_b", id_bucket(groups, "first", partitions(spark)))
    inside = Window.partitionBy("_b").orderBy("first", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = materialize(spread.withColumns({"_end": F.sum("bytes").over(inside), "_place": F.count(F.lit(1)).over(inside)}), "shard-groups")
    sums = rows.groupBy("_b").agg(F.max("_end").alias("t"), F.max("_place").alias("n"))
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_b", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"))
    offsets = {r[0]: (r[1], r[2]) for r in sums.collect()}  # one row per id range
    top = max(offsets, default=-1) + 1
    shift = lambda i: F.get(F.array(*[F.lit(offsets.get(b, (0, 0))[i]).cast("long") for b in range(top)]), F.col("_b")) if top else F.lit(0)
    return rows.withColumns({"end": F.col("_end") + shift(0), "place": F.col("_place") - 1 + shift(1)}).withColumn("start", F.col("end") - F.col("bytes"))


def _shard_of(ends: list[int], names: list[int]) -> Column:
    """Shard of a group from its start offset."""
    cuts = F.array(*[F.lit(e).cast("long") for e in ends[:-1]]) if len(ends) > 1 else F.array().cast("array<bigint>")
    at = F.size(F.filter(cuts, lambda c: c <= F.col("start")))
    return F.get(F.array(*[F.lit(x) for x in names]), at)


def shard(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every document into one of ``shards`` shards of near-equal bytes; equal texts stay together.

    Returns doc_id, size (UTF-8 bytes plus 16; null text has none), text_crc32 (null: 0), shard and
    slot (gapless from 0 in each shard, ascending doc_id). Null and empty text are one group each.
    Repeated rows each get a slot. Extra columns are not carried. An empty table gives an empty one.
    """
    spark: SparkSession = docs.sparkSession
    t = docs[text].cast("string")
    size = F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 16
    base = docs.select(docs[doc_id].cast("long").alias("doc_id"), size.alias("size"), F.coalesce(F.crc32(t), F.lit(0)).cast("long").alias("text_crc32"), F.coalesce(F.unhex(F.sha2(t, 256)), F.lit(b"")).alias("key"))
    base = materialize(base, "shard-rows")
    # one row per distinct text; copies meet in map-side sums first
    groups = base.groupBy("key").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes"))
    groups = materialize(groups, "shard-texts")
    total, n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    alone: list[tuple[int, bytes]] = []
    left, room = total, shards
    while room > 1:  # an oversize group leaves a smaller even share to the others
        found = groups.where(F.col("bytes") > F.lit(left // room)).select("bytes", "key").orderBy(F.desc("bytes"), "key").limit(shards).collect()
        fresh = [(r[0], bytes(r[1])) for r in found if (r[0], bytes(r[1])) not in alone][: room - 1]
        # with few texts an even share is below one of them; a shard each is then what greedy cuts give
        if not fresh or n <= shards:
            break
        alone += fresh
        left, room = total - sum(x[0] for x in alone), shards - len(alone)
    big = F.col("key").isin([bytearray(k) for _, k in alone]) if alone else F.lit(False)
    rest = _running(groups.where(~big)) if alone else _running(groups)
    largest = rest.agg(F.max("bytes")).first()[0] or 0
    blocks = _blocks(rest, None, BLOCKS)
    cuts = minimax(blocks, largest, room, lambda ranges, n: _blocks(rest, ranges, max(n, BLOCKS)))
    placed = rest.select("key", _shard_of(cuts.ends, list(range(room))).cast("int").alias("shard"))
    if alone:
        own = F.lit(None).cast("int")
        for i, (_, k) in enumerate(alone):
            own = F.when(F.col("key") == F.lit(bytearray(k)), F.lit(room + i)).otherwise(own)
        placed = placed.unionByName(groups.where(big).select("key", own.alias("shard")))
    rows = base.join(placed, "key").drop("key")
    rows = materialize(rows.withColumn("_b", id_bucket(base, "doc_id", partitions(spark))), "shard-placed")
    # slots: rows before in earlier id ranges of the shard, then the rank inside the range
    counts = rows.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("shard", "_b", before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_b", "shard").orderBy("doc_id", "text_crc32")) - 1
    return rows.withColumn("_rank", rank).join(counts, ["_b", "shard"]).select("doc_id", "size", "text_crc32", "shard", (F.col("_before") + F.col("_rank")).cast("long").alias("slot"))
