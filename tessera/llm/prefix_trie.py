"""Prefix trie of conversations as a Cartesian tree over their sorted order.

Distinct conversations are sorted turn by turn and numbered; ``lcp`` of number k is the count of
leading turns that it shares with k - 1. Each value of that array stands for the interval of
conversations between the nearest smaller values on both sides, and these intervals (equal ones
merged, as equal values in one interval are one node) are the branching nodes of the trie. A
conversation that goes on beyond what it shares with its neighbours is a leaf. Depths between a node
and its parent are filled in afterwards: the node of depth d whose first conversation is k is turn d
of k, as k shares less than d turns with k - 1.

Nearest smaller values are found in blocks of ``BLOCK`` neighbours. What a block leaves open (its
running minima, at most one a distinct depth) looks for the nearest block whose minimum is smaller and
then in that block's own running minima. Only one row a block reaches the driver. Sums and minima over
an interval come from running sums and from minima up to and from a block's ends.

A conversation is held in parts of ``TURNS`` turns, so that no row grows with its length: parts are
numbered in sorted order, then pairs of neighbouring numbers again, until one number is left.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, partitions
from tessera.operators import ordering

#: Sorted conversations whose nearest smaller values are looked for together; turns in one row; ids hashed at once.
BLOCK, TURNS, IDS = 8_192, 64, 1_000
_HEX = 32
NONE = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, item, size): turns by ``turn`` (null first), numbered from 0 in each conversation.

    ``item`` is a digest of role and text (null: empty), ``size`` the text's code points. Rows of one
    conversation and turn go by their digest, so repeated rows are turns of their own. Rows without a
    conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    item = F.md5(F.concat(F.char_length(role).cast("string"), F.lit("|"), role, text))
    rows = conversations.where(conversations["conv_id"].isNotNull()).select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"], item.alias("item"), F.char_length(text).cast("long").alias("size"))
    placed = ordering.position(rows, "pos", None, ["turn", "item"], within=["conv_id"])
    return placed.select("conv_id", F.col("pos").cast("long").alias("pos"), "item", "size")


def share_openings(turns: DataFrame, most: int = 5, family: int = 100) -> tuple[DataFrame, DataFrame]:
    """(turns, ids of all conversations), each conversation's first turns replaced by those of its family's first.

    With h = crc32(decimal conv_id) % (most + 1), conversation c becomes the first h turns of conversation
    c - c % family (fewer, if it has fewer) and then its own turns after its first h. It may be left without turns.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % (most + 1)
    ids = turns.select("conv_id").distinct()
    first = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < most)).groupBy(F.col("conv_id").alias("head")).agg(F.array_sort(F.collect_list(F.struct("pos", "item", "size"))).alias("opening"))
    head = F.col("conv_id") - F.col("conv_id") % family
    heads = ids.withColumns({"head": head, "h": h.cast("int")}).join(first, "head").select("conv_id", F.explode(F.slice("opening", 1, F.col("h"))).alias("t"))
    own = turns.withColumns({"head": head, "h": h}).where("pos >= h").join(first.select("head", F.size("opening").alias("there")), "head", "left")
    own = own.withColumn("pos", F.col("pos") - F.col("h") + F.least("h", F.coalesce("there", F.lit(0))))
    return heads.select("conv_id", "t.pos", "t.item", "t.size").unionByName(own.select("conv_id", "pos", "item", "size")), ids


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with the place of their ``order`` columns among all distinct ones."""
    distinct = materialize(rows.select(*order).distinct(), "distinct")
    return rows.join(ordering.position(distinct, name, None, order), order)


def sort_numbers(blocks: DataFrame) -> DataFrame:
    """(conv_id, k): conversations in the order of their turns, a prefix first; equal ones share k."""
    now = _numbered(blocks.select("conv_id", "b", "key"), ["key"], "k").select("conv_id", "b", F.col("k").cast("long").alias("k"))
    now = materialize(now, "numbers")
    top = now.agg(F.max("b")).first()[0]
    while top:
        left, right = F.max(F.when(F.col("b") % 2 == 0, F.col("k"))), F.max(F.when(F.col("b") % 2 == 1, F.col("k")))
        pairs = now.groupBy("conv_id", F.floor(F.col("b") / 2).alias("b")).agg(left.alias("left"), F.coalesce(right, F.lit(-1)).alias("right"))
        pairs = _numbered(materialize(pairs, "pairs"), ["left", "right"], "k")
        now = materialize(pairs.select("conv_id", "b", F.col("k").cast("long").alias("k")), "numbers")
        top //= 2
    return now.select("conv_id", "k")


def _digests(members: DataFrame) -> DataFrame:
    """(k, ends): SHA-256 of the decimal ids of each k, ascending, comma-joined.

    Such a digest is sequential, so the ids of one k pass through one task, as a stream of strings
    that other tasks have joined; none is held as a whole.
    """
    chunks = members.groupBy("k", F.floor(F.col("conv_id") / IDS).alias("c")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("s"))
    chunks = chunks.repartition(partitions(members.sparkSession), "k").sortWithinPartitions("k", "c")

    def run(batches):
        k, digest = None, hashlib.sha256()
        for batch in batches:
            ks, done = [], []
            for now, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if now == k:
                    digest.update(b"," + s.encode())
                    continue
                if k is not None:
                    ks.append(k)
                    done.append(digest.hexdigest())
                k, digest = now, hashlib.sha256(s.encode())
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(done, pa.string())], names=["k", "ends"])
        if k is not None:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([digest.hexdigest()])], names=["k", "ends"])

    return chunks.mapInArrow(run, "k long, ends string")


def _alike(x: Column, y: Column) -> Column:
    """Leading turns that two keys share."""
    n = (F.least(F.char_length(x), F.char_length(y)) / _HEX).cast("int")
    same = F.filter(F.sequence(F.lit(1), n), lambda i: F.left(x, i * _HEX) == F.left(y, i * _HEX))
    return F.when(n > 0, F.size(same)).otherwise(F.lit(0))


def neighbours(parts: DataFrame, last: int) -> DataFrame:
    """(k, lcp) for k from 1 to ``last``: leading turns that k shares with k - 1."""
    sides = parts.select("k", "b", F.col("key").alias("x"), F.lit(None).cast("string").alias("y")).unionByName(parts.where(F.col("k") < last).select((F.col("k") + 1).alias("k"), "b", F.lit(None).cast("string").alias("x"), F.col("key").alias("y")))
    both = sides.where("k > 0").groupBy("k", "b").agg(F.coalesce(F.max("x"), F.lit("")).alias("x"), F.coalesce(F.max("y"), F.lit("")).alias("y"))
    return both.where("x <> y").groupBy("k").agg(F.min(F.col("b") * TURNS + _alike(F.col("x"), F.col("y"))).alias("lcp"))


def nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the nearest smaller values before and after each value; -1 where there is none."""
    left, right, open_ = [-1] * len(values), [-1] * len(values), []
    v = values.tolist()
    for i, x in enumerate(v):
        while open_ and v[open_[-1]] > x:
            right[open_.pop()] = i
        j = open_[-1] if open_ else -1
        left[i] = left[j] if j >= 0 and v[j] == x else j
        open_.append(i)
    return np.array(left, np.int64), np.array(right, np.int64)


class RangeMin:
    """Minimum of any range (both ends belong), from minima of runs of each power of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            step = 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-step], self.rows[-1][step:]))

    def get(self, a: int, b: int) -> int:
        level = (b - a + 1).bit_length() - 1
        return min(int(self.rows[level][a]), int(self.rows[level][b - (1 << level) + 1]))

    def before(self, i: int, v: int) -> int:
        """The last place before ``i`` with a value below ``v``; -1 without."""
        for level in range(len(self.rows) - 1, -1, -1):  # skip runs that are nowhere below v
            while i >= 1 << level and self.rows[level][i - (1 << level)] >= v:
                i -= 1 << level
        return i - 1

    def after(self, i: int, v: int) -> int:
        """The first place after ``i`` with a value below ``v``; -1 without."""
        n = len(self.rows[0])
        i += 1
        for level in range(len(self.rows) - 1, -1, -1):
            while i + (1 << level) <= n and self.rows[level][i] >= v:
                i += 1 << level
        return i if i < n else -1


def _in_block(table: pa.Table) -> pa.Table:
    """One block: nearest smaller values inside it, minima and running sums."""
    table = table.sort_by("k")
    k, lcp, conv, w, leaf = (table.column(c).to_numpy() for c in ("k", "lcp", "conv", "w", "leaf"))
    left, right = nearest_smaller(lcp)
    least = RangeMin(conv)
    inside = (left >= 0) & (right >= 0)
    low = [least.get(a, b - 1) if ok else None for a, b, ok in zip(left.tolist(), right.tolist(), inside.tolist(), strict=True)]
    more = {
        "left": np.where(left >= 0, left + k[0], -1), "right": np.where(right >= 0, right + k[0], -1), "low": pa.array(low, pa.int64()),
        "low_on": np.minimum.accumulate(conv[::-1])[::-1], "low_to": np.minimum.accumulate(conv), "w_to": np.cumsum(w), "leaf_to": np.cumsum(leaf),
    }
    for name, x in more.items():
        table = table.append_column(name, pa.chunked_array([x if isinstance(x, pa.Array) else pa.array(x, pa.int64())]))
    return table


_LOCAL = "k long, conv long, w long, n long, lcp long, nxt long, leaf long, block long, left long, right long, low long, low_on long, low_to long, w_to long, leaf_to long"


def intervals(local: DataFrame, lows: np.ndarray, count: int) -> DataFrame:
    """(k, lcp, l, r, low) of every place with lcp >= 0: the conversations that share these turns.

    ``lows``: the smallest lcp of each block. What stays open in a block are its running minima.
    """
    opens = {
        "left": local.where("left < 0").groupBy("block", "lcp").agg(F.min("k").alias("at")),
        "right": local.where("right < 0").groupBy("block", "lcp").agg(F.max("k").alias("at")),
    }
    search = RangeMin(lows)
    found = {}
    for side, other, pick in (("left", "right", F.max), ("right", "left", F.min)):

        def look(batches, side=side):
            for part in batches:
                b, v = (part.column(i).to_pylist() for i in (0, 1))
                to = [search.before(x, y) if side == "left" else search.after(x, y) for x, y in zip(b, v, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(to, pa.int64())], names=["block", "lcp", "to"])

        asked = opens[side].where("lcp >= 0").select("block", "lcp").mapInArrow(look, "block long, lcp long, to long")
        there = opens[other].select(F.col("block").alias("to"), F.col("lcp").alias("value"), "at")
        met = asked.join(there, "to", "left").where("to < 0 OR value < lcp")
        found[side] = met.groupBy("block", "lcp").agg(pick("at").alias("far_" + side))
    out = local.where("lcp >= 0").join(found["left"], ["block", "lcp"], "left").join(found["right"], ["block", "lcp"], "left")
    left = F.when(F.col("left") >= 0, F.col("left")).otherwise(F.col("far_left"))
    right = F.when(F.col("right") >= 0, F.col("right")).otherwise(F.coalesce("far_right", F.lit(count)))
    return out.select("k", "lcp", left.alias("l"), (right - 1).alias("r"), "low")


def _summed(nodes: DataFrame, local: DataFrame, blocks: list, block: int) -> DataFrame:
    """Intervals with what their ends and the blocks between know: parent's depth, least conversation, counts."""
    lows = RangeMin(np.array([x["conv"] for x in blocks], np.int64))
    before_w, before_leaf = (np.concatenate([[0], np.cumsum([x[c] for x in blocks])]) for c in ("w", "leaf"))
    first = local.select(F.col("k").alias("l"), F.col("n").alias("n_l"), F.col("lcp").alias("lcp_l"), "low_on", (F.col("w_to") - F.col("w")).alias("w_l"), (F.col("leaf_to") - F.col("leaf")).alias("leaf_l"))
    last = local.select(F.col("k").alias("r"), F.col("nxt").alias("nxt_r"), "low_to", F.col("w_to").alias("w_r"), F.col("leaf_to").alias("leaf_r"))
    cols = ["l", "r", "v", "m", "low", "n_l", "lcp_l", "low_on", "w_l", "leaf_l", "nxt_r", "low_to", "w_r", "leaf_r"]
    names = ["l", "r", "v", "n_l", "up", "via", "conv", "n_convs", "n_leaves", "n_children"]

    def run(batches):
        for part in batches:
            rows = []
            for l, r, v, m, low, n_l, lcp_l, low_on, w_l, leaf_l, nxt_r, low_to, w_r, leaf_r in zip(*(c.to_pylist() for c in part.columns), strict=True):
                a, b = l // block, r // block
                if a != b:
                    low = min(low_on, low_to, *([lows.get(a + 1, b - 1)] if b > a + 1 else []))
                elif low is None:  # ends with its block
                    low = low_on
                up = max(lcp_l, nxt_r)
                rows.append((l, r, v, n_l, up, None if up < 0 else l if lcp_l >= nxt_r else r + 1, low, int(before_w[b] - before_w[a]) + w_r - w_l, int(before_leaf[b] - before_leaf[a]) + leaf_r - leaf_l, m + (n_l != v) if m else 0))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in range(len(names))], names=names)

    return nodes.join(first, "l").join(last, "r").select(*cols).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Every distinct sequence of first turns as a node, from the root (depth 0).

    ``turns``: conv_id, pos (from 0, gapless), item, size, as :func:`turns_of` gives them; ``ids``: all
    conversations, also those without turns. Returns conv_id (smallest member), depth, parent_conv_id
    (root: null), n_convs, n_children, n_leaves, saved_tokens (over the subtree, what all members but
    one spend on a node's last turn, in its size) and ends_sha256 (of the ids that end in the node). No
    conversations give no rows.
    """
    part = turns.groupBy("conv_id", F.floor(F.col("pos") / TURNS).alias("b")).agg(F.array_sort(F.collect_list(F.struct("pos", "item", "size"))).alias("t"))
    part = part.select("conv_id", "b", F.array_join(F.transform("t", lambda t: t["item"]), "").alias("key"), F.transform("t", lambda t: t["size"]).alias("sizes"))
    part = materialize(part, "parts")
    bare = ids.join(part.where("b = 0").select("conv_id"), "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("b"), F.lit("").alias("key"), F.array().cast("array<bigint>").alias("sizes"))
    part = part.unionByName(bare)
    members = sort_numbers(part)
    groups = materialize(members.groupBy("k").agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("w")), "groups")
    count = groups.count()
    own = part.join(groups.select("k", F.col("conv").alias("conv_id")), "conv_id").select("k", "b", "key", "sizes")
    own = materialize(own, "own-parts")
    lcp = materialize(neighbours(own, count - 1), "lcp")
    rows = groups.join(own.groupBy("k").agg(F.sum(F.size("sizes")).alias("n")), "k").join(lcp, "k", "left").join(lcp.select((F.col("k") - 1).alias("k"), F.col("lcp").alias("nxt")), "k", "left").na.fill(-1, ["lcp", "nxt"])
    rows = rows.select("k", "conv", "w", "n", "lcp", "nxt", (F.col("nxt") < F.col("n")).cast("long").alias("leaf"), F.floor(F.col("k") / BLOCK).cast("long").alias("block"))
    local = materialize(rows.groupBy("block").applyInArrow(_in_block, _LOCAL), "blocks")
    blocks = local.groupBy("block").agg(*[F.min(c).alias(c) for c in ("lcp", "conv")], *[F.sum(c).alias(c) for c in ("w", "leaf")]).orderBy("block").collect()
    found = materialize(intervals(local, np.array([x["lcp"] for x in blocks], np.int64), count), "intervals")
    inner = found.groupBy("l", "r").agg(F.min("lcp").alias("v"), F.count(F.lit(1)).alias("m"), F.max("low").alias("low"))
    leaves = local.where("leaf = 1").select(F.col("k").alias("l"), F.col("k").alias("r"), F.col("n").alias("v"), F.lit(0).cast("long").alias("m"), F.col("conv").alias("low"))
    nodes = materialize(_summed(inner.unionByName(leaves), local, blocks, BLOCK), "nodes")

    # a parent is the interval of a place beside its child; that of most children, the root, is known without a join
    top = min((x["conv"] for x in blocks), default=None)
    parents = found.where("lcp > 0").join(nodes.select("l", "r", F.col("conv").alias("above")), ["l", "r"]).select(F.col("k").alias("via"), "above")
    nodes = nodes.where("up > 0").join(parents, "via", "left").unionByName(nodes.where("up <= 0").withColumn("above", F.when(F.col("up") == 0, F.lit(top).cast("long"))))

    # sizes of turns up to each depth, in the parts of a node's first conversation
    sums = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    sized = own.select(F.col("k").alias("l"), "b", "sizes")
    sized = materialize(ordering.running(sized, "before", F.floor(F.col("b") / BLOCK), ["b"], value=sums, within=["l"], inclusive=False), "sizes")
    spans = lambda df: df.where("v > 0").withColumn("b", F.explode(F.sequence(F.floor(F.greatest("up", F.lit(0)) / TURNS), F.floor((F.col("v") - 1) / TURNS)))).join(sized, ["l", "b"])
    to = lambda depth: F.col("before") + F.aggregate(F.slice("sizes", 1, F.greatest(F.least(depth - F.col("b") * TURNS, F.lit(TURNS)), F.lit(0)).cast("int")), F.lit(0).cast("long"), lambda a, x: a + x)
    whole = spans(nodes.select("l", "r", "v", "up")).groupBy("l", "r").agg(F.max(to(F.col("v"))).alias("all"), F.min(to(F.col("up"))).alias("less"))
    nodes = nodes.join(whole, ["l", "r"], "left").na.fill(0, ["all", "less"]).withColumn("cost", (F.col("n_convs") - 1) * (F.col("all") - F.col("less"))).withColumn("back", -F.col("r"))
    nodes = materialize(nodes, "costs")
    # in this order a subtree follows its top, up to the node where its last conversation ends
    nodes = materialize(ordering.running(nodes, "upto", F.floor(F.col("l") / BLOCK), ["l", "back"], value=F.col("cost")), "running")
    tops = nodes.where("v = n_l").select(F.col("l").alias("r"), F.col("upto").alias("end"))
    nodes = nodes.join(tops, "r").withColumn("below", F.col("end") - F.col("upto"))
    nodes = nodes.join(_digests(members).withColumnRenamed("k", "l"), "l", "left").withColumn("ends", F.when(F.col("v") == F.col("n_l"), F.col("ends")))
    kept = ["l", "v", "up", "conv", "above", "n_convs", "n_children", "n_leaves", "all", "below", "ends"]
    nodes = materialize(nodes.select(*kept), "whole-nodes")

    def row(depth: Column, sizes_before: Column, root: bool) -> list[Column]:
        bottom = depth == F.col("v")
        return [
            F.col("conv").alias("conv_id"), depth.cast("long").alias("depth"),
            (F.lit(None).cast("long") if root else F.when(depth - 1 > F.col("up"), F.col("conv")).otherwise(F.col("above"))).alias("parent_conv_id"),
            "n_convs", F.when(bottom, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
            (F.col("below") + (F.col("n_convs") - 1) * (F.col("all") - sizes_before)).alias("saved_tokens"),
            F.coalesce(F.when(bottom, F.col("ends")), F.lit(NONE)).alias("ends_sha256"),
        ]

    root = nodes.where("up < 0").select(*row(F.lit(0).cast("long"), F.lit(0).cast("long"), True))
    deep = spans(nodes).withColumn("d", F.explode(F.sequence(F.greatest(F.col("up"), F.col("b") * TURNS, F.lit(0)) + 1, F.least(F.col("v"), (F.col("b") + 1) * TURNS))))
    return root.unionByName(deep.select(*row(F.col("d"), to(F.col("d") - 1), False)))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """:func:`trie` of a table (conv_id, turn, role, text), conversations as they are."""
    turns = materialize(turns_of(conversations), "turns")
    return trie(turns, turns.select("conv_id").distinct())


def shared_prefix_trie(conversations: DataFrame) -> DataFrame:
    """:func:`trie` of a table (conv_id, turn, role, text) after :func:`share_openings`."""
    turns, ids = share_openings(materialize(turns_of(conversations), "turns"))
    return trie(turns, ids)
