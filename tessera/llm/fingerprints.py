"""Context-triggered piecewise hashing of documents.

A rolling hash over seven bytes ends a chunk wherever its low bits are all ones; the number of
bits is the block size's exponent. Each chunk gives one of 64 signature characters. The block size
is the smallest power of two that needs at most 64 chunks, so the whole text is always covered,
and a fingerprint ``size:signature:signature`` also carries the signature at twice that size. Two
fingerprints compare by edit distance at the sizes that both have.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import order_by_id, partitions, strings, text_batches

WINDOW = 7
LONGEST = 64
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)
_TABLE = np.random.default_rng(20240607).integers(0, 1 << 32, 256, np.uint32)
SHARED_RUN = 4
SHORT = 12


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x = x * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def rolling(data: bytes) -> np.ndarray:
    """Hash of the last seven bytes at each position (fewer at the start)."""
    t = _TABLE[np.frombuffer(data, np.uint8)]
    h = t.copy()
    for k in range(1, WINDOW):
        turn = np.uint32(4 * k)
        h[k:] ^= (t[:-k] << turn) | (t[:-k] >> np.uint32(32 - 4 * k))
    return _mix(h)


def _signature(h: np.ndarray, ends: np.ndarray) -> str:
    """One character per chunk; ``ends`` are the triggers, the rest after the last is a chunk too."""
    starts = np.concatenate([[0], ends + 1])
    if starts[-1] >= len(h):
        starts = starts[:-1]
    sums = _mix(np.add.reduceat(h, starts, dtype=np.uint32))
    return _LETTERS[sums >> np.uint32(26)].tobytes().decode()


def fingerprint(text: str) -> str:
    """Fingerprint of a whole text; that of an empty one is ``1::``."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return "1::"
    h = rolling(data)
    ones = ~h & (h + np.uint32(1))  # the lowest zero bit: 2 ** number of trailing ones
    size = 1
    # a text of n bytes has about n / size triggers
    at = np.arange(len(h)) if len(h) <= LONGEST else np.flatnonzero(ones >= np.uint32(2))
    level = ones[at]
    if len(h) > LONGEST:
        size = 2
    while len(at) + (len(at) == 0 or at[-1] != len(h) - 1) > LONGEST:
        size *= 2
        keep = (level >= np.uint32(size)) | (level == 0)
        at, level = at[keep], level[keep]
        if size >= 1 << 31:
            at, level = at[:0], level[:0]
    coarse = at[(level >= np.uint32(min(size * 2, 1 << 31))) | (level == 0)]
    return f"{size}:{_signature(h, at)}:{_signature(h, coarse)}"


def _ranks(signatures: list[str]) -> tuple[np.ndarray, np.ndarray]:
    out = np.full((len(signatures), LONGEST), 255, np.uint8)
    size = np.zeros(len(signatures), np.int64)
    for i, s in enumerate(signatures):
        raw = np.frombuffer(s.encode(), np.uint8)
        out[i, : len(raw)] = raw
        size[i] = len(raw)
    return out, size


def signature_likeness(left: list[str], right: list[str]) -> np.ndarray:
    """1 - edit distance / (both lengths), a replacement counting as two; 0 without a shared run.

    The longest common subsequence is found for all pairs at once: bit-parallel rows in one 64-bit
    word a pair. Signatures that share no run of four characters (three, if one has under twelve)
    are unrelated.
    """
    n = len(left)
    if not n:
        return np.zeros(0)
    a, la = _ranks(left)
    b, lb = _ranks(right)
    rows = np.arange(n)
    places = np.zeros((n, 256), np.uint64)
    for j in range(LONGEST):
        on = j < la
        places[rows[on], a[on, j]] |= np.uint64(1) << np.uint64(j)
    v = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    short = np.minimum(la, lb) < SHORT
    shared = np.zeros(n, bool)
    history = []
    for j in range(int(lb.max(initial=0))):
        m = np.where(j < lb, places[rows, b[:, j]], np.uint64(0))
        u = v & m
        v = np.where(j < lb, (v + u) | (v - u), v)
        history.append(m)
        for need, pairs in ((SHARED_RUN, ~short), (SHARED_RUN - 1, short)):
            if len(history) >= need:
                run = history[-1]
                for k in range(1, need):
                    run = run & (history[-1 - k] << np.uint64(k))
                shared |= pairs & (run != 0)
    mask = np.where(la >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(la, 63).astype(np.uint64)) - np.uint64(1))
    lcs = np.bitwise_count(~v & mask).astype(np.int64)
    equal = np.array([x == y for x, y in zip(left, right, strict=True)])
    total = la + lb
    out = np.where(total > 0, 2.0 * lcs / np.maximum(total, 1), 1.0)
    return np.where(equal, 1.0, np.where(shared, out, 0.0))


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Likeness 0..1 of fingerprints, pair by pair: the best over the block sizes both carry."""
    out = np.zeros(len(left))
    jobs: list[tuple[int, str, str]] = []
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        if x == y:
            out[i] = 1.0
            continue
        sx, x1, x2 = x.split(":")
        sy, y1, y2 = y.split(":")
        p, q = int(sx), int(sy)
        if not x1 or not y1:
            continue
        if p == q:
            jobs += [(i, x1, y1), (i, x2, y2)]
        elif p == 2 * q:
            jobs.append((i, x1, y2))
        elif q == 2 * p:
            jobs.append((i, x2, y1))
    if jobs:
        at = np.array([j[0] for j in jobs])
        np.maximum.at(out, at, signature_likeness([j[1] for j in jobs], [j[2] for j in jobs]))
        # only equal fingerprints reach 1
        differ = np.array([x != y for x, y in zip(left, right, strict=True)])
        out = np.where(differ, np.minimum(out, 0.999), out)
    return out


def edited(text: str, following: str) -> str:
    """The last half of ``text`` gives way to as many first characters of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every text, its edited text and the likeness to both it and the next document.

    Rows are dealt into ascending doc_id ranges (one shuffle of id and text) and streamed in order;
    the first rows of a range also close the range before it, so each row meets its successor; the
    last one's is the first. A single row follows itself. Equal ids are ordered by text. Null text
    counts as empty; null ids come first. Columns other than id and text are not carried. An empty
    table gives an empty one.
    """
    spark = docs.sparkSession
    rows = order_by_id(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")), "doc_id", partitions(spark), first_also_before=True)
    rows = rows.sortWithinPartitions("_extra", "doc_id", "text").select("_extra", "doc_id", "text")

    def run(batches):
        held: tuple[int | None, str, str] | None = None  # the row whose successor is yet to come
        done = False
        for part in text_batches(batches, rows=500):
            ready: list[tuple] = []
            for extra, i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strings(part.column(2)), strict=True):
                if done:
                    break
                f = fingerprint(t)
                if held is not None:
                    ready.append((*held, t, f))
                held = (i, t, f)
                done = extra
            if ready:
                texts = [edited(r[1], r[3]) for r in ready]
                prints = [fingerprint(x) for x in texts]
                own = [r[2] for r in ready]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in ready], pa.int64()),
                        pa.array([len(r[1]) for r in ready], pa.int64()),
                        pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in texts]),
                        pa.array(own),
                        pa.array(prints),
                        pa.array(likeness(own, prints)),
                        pa.array(likeness(own, [r[4] for r in ready])),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return rows.mapInArrow(run, OUT)
