"""Periodic runs of words, by comparing a text's word ids with each shift of themselves.

A run with period q is a stretch of words in which words q apart are equal. At lag q the array of
word ids is compared with itself q places on; a run is a stretch of true values, q words longer. All
lags up to n / 3 are compared. Texts of like length stand end to end in one array (their ids are
disjoint), so one comparison serves many of them. The lags of a long text are dealt out: each range
of lags is a row of its own, which Spark gives to any machine, and the ranges' runs meet again by text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, materialize, partitions, spare_name, strings, text_batches

#: A run has at least this many words, and at least this many periods.
WORDS, EXPONENT = 24, 3
#: Bytes of a text whose lags are dealt out, and word pairs that one range of lags compares.
LONG_BYTES, PAIRS = 48_000, 20_000_000
#: Ranges of one text; beyond PAIRS times as many pairs the ranges grow, as each carries the ids.
RANGES = 256
#: Words of the texts that are compared together.
TOGETHER = 65_536

_ALL = np.uint64(0x0101010101010101)
Edit = Callable[[int | None, list[bytes]], list[bytes]]
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def word_ids(words: list[bytes], base: int = 0) -> np.ndarray:
    """Numbers of the words from ``base``, equal words alike."""
    known: dict[bytes, int] = defaultdict(count(base).__next__)
    return np.fromiter(map(known.__getitem__, words), np.uint32, len(words))


def least(lag: int) -> int:
    """Words of the shortest run with that period."""
    return max(WORDS, EXPONENT * lag)


def scan(ids: np.ndarray, sizes: np.ndarray, first: int = 1, last: int | None = None) -> list[tuple[int, int, int]]:
    """Runs (start, end, smallest period) of texts end to end in ``ids``, longest text first.

    The texts' ids are disjoint, so no run goes beyond its text. With ``first`` and ``last`` only
    these lags are compared, and the period is the smallest among them. Lags rise, so the first time
    that a stretch is found its lag is the smallest; multiples of it find the same stretch.
    """
    found: dict[tuple[int, int], int] = {}
    ends = np.cumsum(sizes)
    buffer = np.zeros(len(ids) + 8, bool)
    for lag in range(first, (int(sizes[0]) // EXPONENT if last is None else last) + 1):
        texts = int(np.searchsorted(-sizes, -least(lag), side="right"))  # those that are long enough
        if not texts:
            break
        n = int(ends[texts - 1])
        equal = np.equal(ids[: n - lag], ids[lag:n], out=buffer[: n - lag])
        # a stretch of at least 16 true values holds eight at a place that eight divides
        if not (buffer[: (n - lag) // 8 * 8].view(np.uint64) == _ALL).any():
            continue
        turns = np.flatnonzero(equal[1:] != equal[:-1]) + 1
        turns = np.concatenate([[0] if equal[0] else [], turns, [n - lag] if equal[-1] else []]).astype(np.int64)
        starts, stops = turns[::2], turns[1::2]
        long = stops - starts >= least(lag) - lag
        for s, e in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
            found.setdefault((s, e + lag), lag)
    return [(s, e, lag) for (s, e), lag in found.items()]


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Each text's runs (start, length, period) by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted((i for i, t in enumerate(texts) if len(t) >= WORDS), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        group, total = [], 0
        while at < len(order) and (not group or total + len(texts[order[at]]) <= TOGETHER):
            group.append(order[at])
            total += len(texts[order[at]])
            at += 1
        base, parts = 0, []
        for i in group:
            parts.append(word_ids(texts[i], base))
            base += len(texts[i])
        sizes = np.array([len(p) for p in parts])
        begins = np.cumsum(sizes) - sizes
        for s, e, lag in scan(np.concatenate(parts), sizes):
            k = int(np.searchsorted(begins, s, side="right")) - 1
            out[group[k]].append((s - int(begins[k]), e - s, lag))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join(compress(words, (np.cumsum(depth[:-1]) == 0).tolist()))


def lag_ranges(n: int) -> list[tuple[int, int]]:
    """Ranges of lags (both ends belong) that compare about as many pairs each."""
    last = n // EXPONENT
    if n < WORDS or not last:
        return []
    pairs = np.cumsum(n - np.arange(1, last + 1))
    parts = min(RANGES, -(-int(pairs[-1]) // PAIRS))
    cuts = np.unique(np.searchsorted(pairs, pairs[-1] * np.arange(1, parts) / parts) + 1)
    edges = [0, *(c for c in cuts.tolist() if c < last), last]
    return [(a + 1, b) for a, b in zip(edges, edges[1:], strict=False)]


def _words(part: pa.RecordBatch, doc_id: int, text: int, edit: Edit | None) -> list[list[bytes]]:
    # bytes are split at 0x20 and 0x09-0x0D, as asked, not at other white space
    texts = [t.encode().split() for t in strings(part.column(text))]
    return [edit(d, w) for d, w in zip(part.column(doc_id).to_pylist(), texts, strict=True)] if edit else texts


def _result(part: pa.RecordBatch, keep: int, texts: list[list[bytes]], runs: list[list[tuple[int, int, int]]], names: list[str]) -> pa.RecordBatch:
    flat = [r for rs in runs for r in rs]
    values = pa.StructArray.from_arrays([pa.array([r[i] for r in flat], pa.int64()) for i in range(3)], names=["start", "length", "period"])
    offsets = np.concatenate([[0], np.cumsum([len(rs) for rs in runs])]).astype(np.int32)
    collapsed = [collapse(w, rs).decode() for w, rs in zip(texts, runs, strict=True)]
    cols = [pa.array([len(w) for w in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), pa.array(collapsed, pa.string())]
    return pa.RecordBatch.from_arrays([*part.columns[:keep], *cols], names=names)


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edit: Edit | None = None) -> DataFrame:
    """Input columns other than ``text``, then n_words (long), runs (start, length, period by start, then period) and collapsed.

    Words are runs of characters other than space and 0x09-0x0D. A run is a stretch of words with
    smallest period q and at least max(24, 3 q) words that no neighbour extends with that period.
    ``collapsed`` is the text without the words that a run holds after its first period, joined by one
    space. ``edit`` may change a text's words before (called with the id and the words).

    Null, empty and blank texts have no words, no runs and '' as collapsed; null ids are as others;
    repeated rows stay, each with the same result; input columns named as the results give way.
    Texts up to ``LONG_BYTES`` are read in one narrow stage. The lags of longer ones are dealt out in
    ranges that Spark spreads; only word ids go with them. No range depends on the others.
    """
    bound_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != text and c not in ("n_words", "runs", "collapsed")]
    if doc_id not in keep:
        raise ValueError(f"no column {doc_id}")
    t, key = spare_name("text", keep), spare_name("key", [*keep, "text"])
    at, names = keep.index(doc_id), [*keep, "n_words", "runs", "collapsed"]
    src = docs.select(*[docs[c] for c in keep], docs[text].cast("string").alias(t))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    schema = f"{kept}, n_words long, runs {RUNS}, collapsed string"
    long = F.coalesce(F.octet_length(t) > LONG_BYTES, F.lit(False))

    def whole(batches):
        for part in text_batches(batches, owner="periodic"):
            texts = _words(part, at, len(keep), edit)
            yield _result(part, len(keep), texts, runs_of(texts), names)

    short = src.where(~long).mapInArrow(whole, schema)
    identity = F.sha2(F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), t), 256)
    # texts of one id and content have the same runs, so repeated rows share them
    longs = materialize(src.where(long).withColumn(key, identity), "long-texts")

    def deal(batches):
        for part in text_batches(batches, rows=8, owner="periodic"):
            for k, words in zip(part.column(len(keep) + 1).to_pylist(), _words(part, at, len(keep), edit), strict=True):
                raw = word_ids(words).tobytes()
                for a, b in lag_ranges(len(words)):
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([a], pa.int64()), pa.array([b], pa.int64()), pa.array([raw], pa.binary())], names=["k", "a", "b", "ids"])

    def compare(batches):
        for part in text_batches(batches, rows=8, owner="periodic"):
            for k, a, b, raw in zip(*(c.to_pylist() for c in part.columns), strict=True):
                ids = np.frombuffer(raw, np.uint32)
                found = scan(ids, np.array([len(ids)]), a, b)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.string()), *(pa.array(x, pa.int64()) for x in ([s for s, _, _ in found], [e - s for s, e, _ in found], [q for _, _, q in found]))], names=["k", "start", "length", "period"])

    ranges = longs.mapInArrow(deal, "k string, a long, b long, ids binary").repartition(4 * partitions(docs.sparkSession), "k", "a")
    runs = ranges.mapInArrow(compare, "k string, start long, length long, period long")
    runs = runs.groupBy("k", "start", "length").agg(F.min("period").alias("period"))
    by_text = runs.groupBy("k").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    found = F.array_sort(F.transform("runs", lambda r: F.struct(r["start"], r["period"], r["length"])))

    def finish(batches):
        for part in text_batches(batches, rows=64, owner="periodic"):
            runs = [[(r["start"], r["length"], r["period"]) for r in rs or []] for rs in part.column(len(keep) + 1).to_pylist()]
            yield _result(part, len(keep), _words(part, at, len(keep), edit), runs, names)

    met = longs.join(by_text, longs[key] == by_text["k"], "left").select(*[longs[c] for c in keep], longs[t], found.alias(key))
    return short.unionByName(met.mapInArrow(finish, schema))


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; ties by start, then period; null without runs."""
    better = lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a)
    return F.when(F.size(runs) > 0, F.aggregate(runs, F.get(runs, F.lit(0)), better))
