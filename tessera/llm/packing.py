"""Packing of documents into as few sequences of a fixed length as possible.

Lengths are small integers, so the whole problem is their histogram, which has at most ``capacity``
rows at any number of documents. It is solved by linear grouping: the large lengths in descending
order fall into groups of equal cardinality and count as their group's largest; the fractional best
mix of configurations (how many of each group share a sequence) comes from column generation, and its
whole parts are used. The documents' true lengths are put into the slots; sequences that this fills
well are kept. What is left of the large ones and then the small ones go, longest first, where they fit
best. How full is well enough is tried for a few shares of the capacity, and the plan with the fewest
sequences is taken.

Sequences of one make are handled together as a run, so that the plan is a table of ranges: documents
of length s and ranks r0..r1 among that length go to sequences first + (rank - r0) // p. Spark gives
each document its rank in its length (in parts, so that a frequent length is many tasks' work) and
looks its range up; no table of documents passes through one task.
"""

from __future__ import annotations

import zlib
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import word_ids
from tessera.llm.common import bound_batches, materialize, spare_name, strings, text_batches

#: Lengths above capacity / SMALL are large; groups of the large ones; documents of a length ranked together.
SMALL, GROUPS, WIDTH = 8, 112, 500
#: Gaps, as divisors of the capacity, up to which a sequence is kept when true lengths are in its slots.
GAPS = (1, 64, 128, 256, 512)
#: Most pivots of the column generation, as a multiple of the groups; any mix before the last is valid too.
PIVOTS = 20


@dataclass
class Run:
    """``n`` sequences with the same layout: items (length, first rank, number a sequence)."""

    n: int
    gap: int
    items: list[tuple[int, int, int]] = field(default_factory=list)

    def split(self, k: int) -> tuple[Run, Run]:
        """The first ``k`` sequences and the others."""
        rest = [(s, r + k * p, p) for s, r, p in self.items]
        return Run(k, self.gap, list(self.items)), Run(self.n - k, self.gap, rest)

    def add(self, size: int, rank: int, p: int) -> None:
        self.items.append((size, rank, p))
        self.gap -= size * p


def best_column(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of sizes within the capacity: value and counts."""
    best = np.zeros(capacity + 1)
    taken: list[tuple[int, np.ndarray]] = []
    for i, (s, v) in enumerate(zip(sizes, values.tolist(), strict=True)):
        if v <= 1e-12:
            continue
        for _ in range(capacity // s):  # one more of the size in each pass
            more = best[:-s] + v
            better = more > best[s:] + 1e-12
            if not better.any():
                break
            best[s:][better] = more[better]
            taken.append((i, better))
    counts, room = np.zeros(len(sizes)), capacity
    for i, better in reversed(taken):
        s = sizes[i]
        if room >= s and better[room - s]:
            counts[i] += 1
            room -= s
    return float(best[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """Whole parts of the fractional best mix: (times, counts of each size)."""
    k = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    x = np.array(demand, float) / np.diag(basis)
    for _ in range(PIVOTS * k):
        value, column = best_column(sizes, np.linalg.solve(basis.T, np.ones(k)), capacity)
        if value <= 1 + 1e-7:
            break
        w = np.linalg.solve(basis, column)
        able = w > 1e-9
        if not able.any():
            break
        ratio = np.full(k, np.inf)
        ratio[able] = x[able] / w[able]
        out = int(np.argmin(ratio))
        step = max(ratio[out], 0.0)
        x = np.maximum(x - step * w, 0.0)
        x[out] = step
        basis[:, out] = column
    return [(int(t), c) for t, c in zip(np.floor(x + 1e-6).tolist(), np.rint(basis.T).astype(int).tolist(), strict=True) if t >= 1]


def groups_of(large: list[tuple[int, int]], k: int) -> list[list[tuple[int, int, int]]]:
    """(length, count) in descending order, cut into at most ``k`` groups of equal cardinality.

    Gives lists of (length, first rank, count). Lengths are left as they are if there are few.
    """
    if len(large) <= k:
        return [[(s, 0, n)] for s, n in large]
    size = -(-sum(n for _, n in large) // k)
    out: list[list[tuple[int, int, int]]] = [[]]
    room = size
    for s, n in large:
        rank = 0
        while n:
            take = min(n, room)
            out[-1].append((s, rank, take))
            rank, n, room = rank + take, n - take, room - take
            if not room:
                out.append([])
                room = size
    return [g for g in out if g]


def _substitute(groups: list[list[tuple[int, int, int]]], mix: list[tuple[int, list[int]]], capacity: int) -> tuple[list[Run], list[tuple[int, int, int]]]:
    """True lengths in the slots of the configurations, and what found none."""
    queues = [deque(g) for g in groups]
    runs = []
    for times, counts in mix:
        slots = [(i, p) for i, p in enumerate(counts) if p]
        while times and any(queues[i] for i, _ in slots):
            # as many sequences as the lengths at the heads of the queues serve alike
            alike = min([queues[i][0][2] // p for i, p in slots if queues[i]] + [times])
            run = Run(max(alike, 1), capacity)
            for i, p in slots:
                left = p
                while left and queues[i]:
                    s, r, n = queues[i].popleft()
                    take = min(left, n) if not alike else p
                    run.add(s, r, take)
                    if n > take * run.n:
                        queues[i].appendleft((s, r + take * run.n, n - take * run.n))
                    left -= take
            times -= run.n
            runs.append(run)
    return runs, [x for q in queues for x in q]


def _fit(runs: list[Run], rest: list[tuple[int, int, int]], capacity: int) -> list[Run]:
    """Best fit, longest first: each document to the sequence with the smallest gap that takes it."""
    by_gap: list[list[Run]] = [[] for _ in range(capacity + 1)]
    there = 0  # bit g: some sequence has a gap of g
    for run in runs:
        by_gap[run.gap].append(run)
        there |= 1 << run.gap
    new = []
    for s, rank, n in sorted(rest, key=lambda x: (-x[0], x[1])):
        while n:
            able = there >> s
            if able:
                gap = s + (able & -able).bit_length() - 1
                run = by_gap[gap].pop()
            else:
                gap, run = capacity, Run(n, capacity)
                new.append(run)
            p = min(gap // s, n)
            used = min(run.n, n // p)
            if used < run.n:
                run, other = run.split(used)
                if able:
                    by_gap[gap].append(other)
            if able and not by_gap[gap]:
                there &= ~(1 << gap)
            run.add(s, rank, p)
            by_gap[run.gap].append(run)
            there |= 1 << run.gap
            rank, n = rank + p * used, n - p * used
    return [run for runs in by_gap for run in runs]


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Ranges (length, r0, r1, first sequence, number a sequence, offset) for a histogram of lengths.

    Lengths are 1 to ``capacity``. Sorted by length and r0; the ranges of a length cover its ranks.
    """
    if any(not 1 <= s <= capacity for s in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    sizes = sorted((s for s in counts if counts[s]), reverse=True)
    large = [(s, counts[s]) for s in sizes if s * SMALL > capacity]
    small = [(s, 0, counts[s]) for s in sizes if s * SMALL <= capacity]
    filled: list[Run] = []
    left: list[tuple[int, int, int]] = []
    if large:
        groups = groups_of(large, GROUPS)
        mix = configurations([g[0][0] for g in groups], [sum(x[2] for x in g) for g in groups], capacity)
        filled, left = _substitute(groups, mix, capacity)
    plans = []
    for gap in sorted({capacity // g for g in GAPS}):
        kept = [Run(r.n, r.gap, list(r.items)) for r in filled if r.gap <= gap]
        again = [(s, r, p * x.n) for x in filled if x.gap > gap for s, r, p in x.items]
        plans.append(_fit(kept, [*left, *again, *small], capacity))
    rows, first = [], 0
    for run in min(plans, key=lambda runs: sum(r.n for r in runs)):
        offset = 0
        for s, r, p in run.items:
            rows.append((s, r, r + p * run.n, first, p, offset))
            offset += s * p
        first += run.n
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Token ids of each whole text, an end id after them, cut into pieces of at most ``capacity``.

    Returns doc_id, piece (from 0), start (ids of the document before it), length, ids_crc32 and, with
    ``ids``, the piece's ids as little-endian unsigned 32-bit integers. Only the last piece of a
    document may be shorter. Null and empty texts hold the end id alone; repeated rows stay.
    """
    bound_batches(docs.sparkSession)
    src = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        coder = word_ids.load(tokenizer_path)
        for part in text_batches(batches, owner="word_ids"):
            rows, raws = [], []
            for i, raw in zip(part.column(0).to_pylist(), coder.encode(strings(part.column(1))), strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    some = raw[at : at + 4 * capacity]
                    rows.append((i, k, at // 4, len(some) // 4, zlib.crc32(some)))
                    if ids:
                        raws.append(some)
            cols = [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(raws, pa.binary())] * ids, names=names + ["ids"] * ids)

    return src.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)


def pack(rows: DataFrame, length: str, keys: list[str], capacity: int) -> DataFrame:
    """``rows`` with sequence_id and offset: rows of a sequence lie end to end, at most ``capacity`` long.

    ``length`` is from 1 to ``capacity`` in every row. ``rows`` is read twice (write it first if it is
    dear). ``keys`` order the rows of a length; rows alike in all of them must be alike altogether, or
    their places may be swapped when a task runs again. Null keys are ordinary; columns named as the
    results give way. No rows give no rows.
    """
    rows = rows.select(*[c for c in rows.columns if c not in ("sequence_id", "offset")])
    total, deal, before, inside, parts = (spare_name(n, rows.columns) for n in ("total", "deal", "before", "inside", "parts"))
    histogram = {r[0]: r[1] for r in rows.groupBy(length).agg(F.count(F.lit(1))).collect()}  # at most ``capacity`` rows
    ranges = plan(histogram, capacity)
    # ranks in a length: each part of it is counted by itself, then the parts' counts add up
    dealt = np.zeros(capacity + 1, np.int64)
    for s, n in histogram.items():
        dealt[s] = -(-n // WIDTH)
    table = rows.sparkSession.createDataFrame([(int(s), int(dealt[s])) for s in histogram], f"`{length}` long, `{parts}` long")
    rows = rows.join(F.broadcast(table), length).withColumn(deal, F.pmod(F.xxhash64(*keys), F.col(parts))).drop(parts)
    totals = rows.groupBy(length, deal).agg(F.count(F.lit(1)).alias(total))
    earlier = Window.partitionBy(length).orderBy(deal).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(length, deal, F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(before))
    rows = rows.withColumn(inside, F.row_number().over(Window.partitionBy(length, deal).orderBy(*keys)).cast("long") - 1)
    rows = rows.join(totals, [length, deal]).withColumn(inside, F.col(inside) + F.col(before)).drop(deal, before)
    codes = (ranges[:, 0] << 40) | ranges[:, 1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != inside)
    names = [c for c in rows.columns if c != inside]

    def place(batches):
        for part in batches:
            size = part.column(part.schema.get_field_index(length)).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = part.column(part.schema.get_field_index(inside)).to_numpy(zero_copy_only=False)
            at = ranges[np.searchsorted(codes, (size << 40) | rank, side="right") - 1] if len(size) else ranges[:0]
            of = rank - at[:, 1]
            cols = [part.column(part.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(at[:, 3] + of // at[:, 4]), pa.array(at[:, 5] + of % at[:, 4] * size)], names=[*names, "sequence_id", "offset"])

    return rows.mapInArrow(place, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, ids: bool = False) -> DataFrame:
    """Each document's pieces (see :func:`token_pieces`) with sequence_id and offset."""
    rows = materialize(token_pieces(docs, tokenizer_path, capacity, end_id, ids=ids), "pieces")
    return pack(rows, "length", ["doc_id", "piece", "ids_crc32", "start"], capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, starts (offsets of the pieces) and ids of pieces packed with their ids.

    A sequence holds at most the capacity, so a group is never larger.
    """
    pieces = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    out = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), pieces.alias("p"))
    hexed = F.array_join(F.transform("p", lambda p: F.hex(p["ids"])), "")
    return out.select("sequence_id", "n_tokens", F.transform("p", lambda p: p["offset"]).alias("starts"), F.unhex(hexed).alias("ids"))
