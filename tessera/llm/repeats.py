"""Passages that repeat across documents, by sparse suffix arrays over words.

Suffixes are kept only at content-selected positions: the minimisers of eight-word grams over
windows of fifty words, so that every passage of fifty words holds one, at the same place in each
of its occurrences. From a kept position two seeds start: 29 words to the right, and 29 that end
with the gram. A shared passage of fifty words around the position contains one of the two whole.

Of a passage around a seed, at least eleven words lie on one side of it. So the suffixes of a seed
are dealt out by the eleven words that follow it, and once more by the eleven before it: what is
compared in one place agrees in forty words, and a seed that many texts have falls into parts.
There, suffixes are sorted by the words that follow (and, reversed, by those before); neighbours have
the longest common extensions, so each suffix is compared with its neighbours and extended left and
right; fifty-word windows around the seed that no neighbour covers are compared with those of all
suffixes of the part by hash. Of copies of a text one stands for all. Seeds with more suffixes than
a task may hold have all fifty-word windows around them counted by hash, which needs no rows of a
seed together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shingles
from tessera.llm.common import BROADCAST_IDS, materialize, strings, text_batches

LENGTH = 50
GRAM = 8
SEED = 29
#: Words that a seed leaves of a passage of the smallest length, on both sides together.
REST = LENGTH - SEED
#: Words of context on each side; longer passages are covered by their next positions.
REACH = 50
#: Words next to a seed by which its suffixes are dealt out.
SPREAD = (REST + 1) // 2
#: Suffixes of one seed that a task may hold (400 bytes each); with more, windows are counted instead.
SORTED = 100_000


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash in each run of ``window`` grams, leftmost of equals.

    Whether a position is one depends on the grams of the run alone, so all occurrences of a
    passage have the same ones. Only where whole runs are one repeated gram (one word again and
    again) positions are thinned, as far as each run still holds one: there all seeds are equal.
    """
    if len(grams) < window:
        return np.zeros(0, np.int64)
    at = np.unique(sliding_window_view(grams, window).argmin(axis=1) + np.arange(len(grams) - window + 1))
    change = np.concatenate([[0], np.cumsum(grams[1:] != grams[:-1])])
    constant = np.zeros(len(grams) + 1, bool)
    constant[: len(grams) - window + 1] = change[window - 1 :] == change[: len(change) - window + 1]
    inner = constant[at] & constant[at - 1] & constant[at + 1]
    if inner.any():
        starts = np.flatnonzero(constant[:-1] & ~np.concatenate([[False], constant[:-2]]))
        first = starts[np.searchsorted(starts, at, side="right").clip(1) - 1]
        at = at[~inner | ((at - first) % window == 0)]
    return at


def seeds(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of the seeds of one document and their hashes; equal words, equal hashes."""
    none = np.zeros(0, np.int64)
    if len(w) < LENGTH:
        return none, none.view(np.uint64)
    grams = shingles.join_hashes(w, GRAM)
    at = minimisers(grams, LENGTH - GRAM + 1)
    runs = shingles.join_hashes(w, SEED)
    right = at[at + SEED <= len(w)]
    left = at[at >= SEED - GRAM] - (SEED - GRAM)
    starts = np.unique(np.concatenate([right, left]))
    return starts, runs[starts]


def _word_lists(texts: list[str]) -> list[np.ndarray]:
    w, owner, _, _ = shingles.words([t.encode("utf-8", "surrogatepass") for t in texts], lower=False)
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [w[cut[i] : cut[i + 1]] for i in range(len(texts))]


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common start of the rows of two matrices; 0 marks the end of a text."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def extend(doc: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For suffixes of one seed: (index, words to the left, words to the right) of found matches.

    Both orders are sorted; each suffix is compared with the nearest one of another document before
    and after it. Matches under the smallest length are left out. The nearest ones agree longest on
    one side only; where they leave a passage of the smallest length around a seed open, it is
    decided against all suffixes of the seed by its hash.
    """
    n = len(doc)
    found_i, found_l, found_r = [], [], []
    for first in (right, left):
        order = np.lexsort(first.T[::-1])
        d = doc[order]
        new = np.concatenate([[True], d[1:] != d[:-1]])
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        before = np.where(run > 0, starts[run] - 1, -1)  # last place of the run before
        ends = np.concatenate([starts[1:], [n]])
        after = np.where(ends[run] < n, ends[run], -1)
        for other in (before, after):
            has = np.flatnonzero(other >= 0)
            i, j = order[has], order[other[has]]
            found_i.append(i)
            found_l.append(_common(left[i], left[j]))
            found_r.append(_common(right[i], right[j]))
    i, lo, hi = np.concatenate(found_i), np.concatenate(found_l), np.concatenate(found_r)
    keep = lo + hi >= REST
    i, lo, hi = i[keep], lo[keep], hi[keep]
    if n == 2:
        return i, lo, hi
    part = np.arange(REST + 1)  # words that a passage of the smallest length has before the seed
    covered = np.zeros((n, REST + 1), bool)
    np.logical_or.at(covered, i, (part >= REST - hi[:, None]) & (part <= lo[:, None]))
    if covered.all():
        return i, lo, hi
    more, before = np.nonzero(_shared(doc, left, right) & ~covered)
    return np.concatenate([i, more]), np.concatenate([lo, before]), np.concatenate([hi, REST - before])


def _shared(doc: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For suffixes of one seed and 0..REST words before it: does another document have the passage
    of the smallest length around the seed as well? Equal passages have equal hashes of both sides.
    """
    n = len(doc)
    sides, inside = [], []
    for side, mark in ((left, np.uint64(0x9E3779B97F4A7C15)), (right, np.uint64(0xC2B2AE3D27D4EB4F))):
        hashes = np.zeros((n, REST + 1), np.uint64)
        for k in range(REST):
            h = (hashes[:, k] ^ side[:, k]) * mark
            hashes[:, k + 1] = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(k + 1)
        sides.append(hashes)
        inside.append(np.concatenate([np.ones((n, 1), bool), np.logical_and.accumulate(side[:, :REST] != 0, axis=1)], axis=1))
    keys = sides[0] ^ (sides[1][:, ::-1] * np.uint64(0x94D049BB133111EB))
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + np.arange(REST + 1, dtype=np.uint64)
    whole = np.flatnonzero((inside[0] & inside[1][:, ::-1]).ravel())
    keys, owner = keys.ravel()[whole], doc[whole // (REST + 1)]
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    group = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    answer = np.zeros(n * (REST + 1), bool)
    if len(starts):
        answer[whole[order]] = (np.minimum.reduceat(owner, starts) != np.maximum.reduceat(owner, starts))[group]
    return answer.reshape(n, REST + 1)


def _contexts(texts: DataFrame) -> DataFrame:
    """Of texts with their repeated seeds: contexts of ordinary seeds, window hashes of crowded ones."""

    def run(batches):
        for part in text_batches(batches, rows=500, size=1_000_000):
            out: dict[str, list] = {x: [] for x in ("seed", "doc", "at", "left", "right")}
            wide = SEED + SPREAD
            for doc, w, hits in zip(part.column(0).to_pylist(), _word_lists(strings(part.column(1))), part.column(2).to_pylist(), strict=True):
                short = (w >> np.uint64(32)).astype(np.uint32)
                short[short == 0] = 1
                padded = np.concatenate([np.zeros(REACH, np.uint32), short, np.zeros(REACH, np.uint32)])
                crowded: set[int] = set()
                spread = shingles.join_hashes(w, wide).view(np.int64) if len(w) >= wide else np.zeros(0, np.int64)
                for hit in hits:
                    at = hit["at"]
                    if hit["crowded"]:
                        crowded.update(range(max(0, at - REST), min(at, len(w) - LENGTH) + 1))
                        continue
                    left, right = padded[at : at + REACH][::-1].tobytes(), padded[REACH + at + SEED : 2 * REACH + at + SEED].tobytes()
                    for start in (at, at - SPREAD):  # with the words after the seed, with those before it
                        if 0 <= start < len(spread):
                            out["seed"].append(spread[start] ^ (start - at))
                            out["doc"].append(doc)
                            out["at"].append(at)
                            out["left"].append(left)
                            out["right"].append(right)
                if crowded:  # windows of neighbouring seeds overlap; each counts once
                    starts = sorted(crowded)
                    out["seed"] += shingles.join_hashes(w, LENGTH).view(np.int64)[starts].tolist()
                    out["doc"] += [doc] * len(starts)
                    out["at"] += starts
                    out["left"] += [None] * len(starts)
                    out["right"] += [None] * len(starts)
            yield pa.RecordBatch.from_arrays([pa.array(out["seed"], pa.int64()), pa.array(out["doc"], pa.int64()), pa.array(out["at"], pa.int32()), pa.array(out["left"], pa.binary()), pa.array(out["right"], pa.binary())], names=["seed", "doc", "at", "left", "right"])

    return texts.mapInArrow(run, "seed long, doc long, at int, left binary, right binary")


def _compare(rows: DataFrame) -> DataFrame:
    """Spans (doc, start, end) of matches among the suffixes of each part of a seed, at most SORTED."""

    def answer(doc, at, left, right):
        doc, at = np.array(doc, np.int64), np.array(at, np.int64)
        m = [np.frombuffer(b"".join(x), np.uint32).reshape(-1, REACH) for x in (left, right)]
        i, lo, hi = extend(doc, *m)
        return doc[i], at[i] - lo, at[i] + SEED + hi

    def run(batches):
        seed, held = None, ([], [], [], [])
        for part in batches:
            docs, starts, ends = [], [], []
            for s, *row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if s != seed:
                    if len(held[0]) > 1:
                        a, b, c = answer(*held)
                        docs.append(a)
                        starts.append(b)
                        ends.append(c)
                    seed, held = s, ([], [], [], [])
                for x, y in zip(held, row, strict=True):
                    x.append(y)
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(ends).astype(np.int32))], names=["doc", "start", "end"])
        if len(held[0]) > 1:
            a, b, c = answer(*held)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b.astype(np.int32)), pa.array(c.astype(np.int32))], names=["doc", "start", "end"])

    return rows.select("seed", "doc", "at", "left", "right").mapInArrow(run, "doc long, start int, end int")


def _merge(spans: DataFrame) -> DataFrame:
    """Union of the spans of each document: doc, spans array<struct<start,end>>."""
    rows = spans.distinct().groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s"))
    joined = F.aggregate(
        "s",
        F.slice("s", 1, 1),
        lambda acc, x: F.when(x["start"] <= F.element_at(acc, -1)["end"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    return rows.select("doc", joined.alias("spans"))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with passages of fifty words or more that another document has as well.

    Returns one row per such document: doc_id, n_words, n_spans, repeated_words and spans
    (``start:end`` in words, end exclusive, comma-joined, merged). Words are what white space
    (space, 0x09-0x0D) parts, compared byte for byte. Copies of a text of fifty words or more are
    repeated as a whole. Passages that repeat only within one document don't count. Null texts, null
    ids and texts under fifty words are never reported; rows with the same id are one document, and
    their texts are all searched. An empty table gives an empty one. Other columns are not carried.
    """
    src = docs.select(docs[doc_id].cast("long").alias("doc"), docs[text].cast("string").alias("t")).where("doc IS NOT NULL AND t IS NOT NULL")

    def run(batches):
        for part in text_batches(batches, rows=500, size=1_000_000):
            ids, keys, sizes, ats, hashes = [], [], [], [], []
            for doc, key, w in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), _word_lists(strings(part.column(1))), strict=True):
                if len(w) < LENGTH:
                    continue
                at, h = seeds(w)
                ids.append(doc)
                keys.append(key)
                sizes.append(len(w))
                ats.append(at.astype(np.int32))
                hashes.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(ats, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))], names=["doc", "key", "n_words", "at", "seed"])

    keyed = src.select("doc", "t", F.xxhash64("t", F.md5("t")).alias("key"))
    base = materialize(keyed.mapInArrow(run, "doc long, key long, n_words int, at array<int>, seed array<long>"), "repeat-seeds", 500)
    # of copies one text stands for all
    first = F.min(F.struct("doc", "n_words", "at", "seed")).alias("m")
    texts = materialize(base.groupBy("key").agg(first, F.max("doc").alias("other")).select("key", "m.*", "other"), "repeat-texts")

    rows = texts.select("doc", "key", F.explode(F.arrays_zip("at", "seed")).alias("z")).select("doc", "key", F.col("z.at").alias("at"), F.col("z.seed").alias("seed"))
    counts = rows.groupBy("seed").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo <> hi").select("seed", (F.col("c") > SORTED).alias("crowded"))
    # a text that has a seed again and again meets it once; the places come from its own list
    met = texts.select("doc", F.explode(F.array_distinct("seed")).alias("seed")).join(counts, "seed")
    found = met.groupBy("doc").agg(F.collect_set(F.struct("seed", "crowded")).alias("found")).select("doc", F.map_from_entries("found").alias("found"))
    placed = F.transform(F.arrays_zip("at", "seed"), lambda z: F.struct(z["at"].alias("at"), z["seed"].alias("seed"), F.element_at("found", z["seed"]).alias("crowded")))
    placed = texts.join(found, "doc").select("doc", F.filter(placed, lambda z: z["crowded"].isNotNull()).alias("hits"))
    hits = materialize(placed.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits")), "repeat-hits")
    ids = hits.select("doc")
    small = hits.count() <= BROADCAST_IDS
    picked = src.join(F.broadcast(ids) if small else ids, "doc", "left_semi").join(hits, "doc").select("doc", "t", "hits")
    rows = materialize(_contexts(picked), "repeat-suffixes", 500)

    crowded = rows.where("left IS NULL")
    often = crowded.groupBy("seed").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("seed")
    counted = crowded.join(often, "seed").select("doc", F.col("at").alias("start"), (F.col("at") + LENGTH).alias("end"))
    ordered = rows.where("left IS NOT NULL").repartition("seed").sortWithinPartitions("seed", "right")
    spans = _merge(_compare(ordered).unionByName(counted)).select(F.col("doc").alias("rep"), "spans")

    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").alias("end")))
    every = base.select("doc", "key").distinct().join(texts.select("key", F.col("doc").alias("rep"), "other", "n_words"), "key").join(spans, "rep", "left")
    every = every.select("doc", "n_words", F.when(F.col("rep") != F.col("other"), whole).otherwise(F.col("spans")).alias("spans")).where("spans IS NOT NULL")
    one = every.groupBy("doc").agg(F.max(F.struct("n_words", "spans")).alias("m")).select("doc", F.col("m.n_words").alias("n_words"), F.col("m.spans").alias("spans"))
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return one.select(F.col("doc").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), F.size("spans").cast("long").alias("n_spans"), words.alias("repeated_words"), F.array_join(F.transform("spans", lambda s: F.concat(s["start"], F.lit(":"), s["end"])), ",").alias("spans"))
