"""Byte-level BPE encoding and decoding.

Text is split by a pattern; each piece is resolved in two tiers. A minimal perfect hash over the
vocabulary answers pieces that are whole entries. The rest are merged by a heap over linked bytes.
Pieces seen lately are remembered in a memo of bounded size, so work follows distinct pieces.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tessera.llm.common import bound_batches, remember, spare_name, strings, text_batches
from tessera.llm.pieces import CHUNK_ENTRIES, PieceEncoder

OUT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class PerfectHash:
    """Minimal perfect hash of byte strings: hash, then displace; n keys fill n slots.

    Keys fall into n/2 buckets. From the fullest on, a bucket tries displacements until its keys
    land on free slots; buckets of one key name a free slot outright. ``get`` checks the stored
    key, as a hash of this kind maps unknown keys to some slot as well.
    """

    _MIX = 0x9E3779B97F4A7C15
    _ALL = (1 << 64) - 1

    def __init__(self, keys: list[bytes]):
        self.n = n = max(1, len(keys))
        self.buckets = max(1, n // 2)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        if len(set(hashes)) != len(keys):
            raise ValueError("keys repeat, or two collide in 64 bits")
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        self.displace = np.zeros(self.buckets, np.int64).tolist()
        self.slot_key: list[bytes | None] = [None] * n
        self.slot_of = [0] * len(keys)
        free = [True] * n
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        rest = 0
        for b in order:
            own = members[b]
            if len(own) > 1:
                d = 0
                while True:
                    slots = {self._place(hashes[i], d) for i in own}
                    if len(slots) == len(own) and all(free[s] for s in slots):
                        break
                    d += 1
                self.displace[b] = d
                for i in own:
                    self._put(i, self._place(hashes[i], d), keys, free)
            elif own:
                while not free[rest]:
                    rest += 1
                self.displace[b] = -1 - rest
                self._put(own[0], rest, keys, free)

    def _place(self, h: int, d: int) -> int:
        x = ((h >> 20) ^ (d + 1) * self._MIX) * 0xFF51AFD7ED558CCD & self._ALL
        return (x >> 29) % self.n

    def _put(self, i: int, slot: int, keys: list[bytes], free: list[bool]) -> None:
        free[slot], self.slot_key[slot], self.slot_of[i] = False, keys[i], slot

    def get(self, key: bytes) -> int:
        """Slot of ``key``, or -1 where it is no member."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displace[h % self.buckets]
        slot = -1 - d if d < 0 else self._place(h, d)
        return slot if self.slot_key[slot] == key else -1


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranks of ``piece``: the pair of lowest rank, leftmost first, is merged until none is left.

    Spans form a linked list over byte offsets; a heap holds pairs as one integer (rank, start,
    end), and entries that no longer describe two live neighbours are skipped. O(n log n).
    """
    n = len(piece)
    end = list(range(1, n + 2))  # end[i]: where the span that starts at i ends, 0 once swallowed
    back = list(range(-1, n))  # back[i]: start of the span before i
    bits = n.bit_length()
    low, high, get = (1 << bits) - 1, 2 * bits, ranks.get
    heap = []
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            heap.append(r << high | i << bits | i + 2)
    heapify(heap)
    while heap:
        x = heappop(heap)
        z = x & low
        a = x >> bits & low
        m = end[a]
        if not m or m >= n or end[m] != z:
            continue
        end[a], end[m] = z, 0
        if z < n:
            back[z] = a
            e = end[z]
            if (q := get(piece[a:e])) is not None:
                heappush(heap, q << high | a << bits | e)
        if a:
            p = back[a]
            if (q := get(piece[p:z])) is not None:
                heappush(heap, q << high | p << bits | z)
    out, i = [], 0
    while i < n:
        e = end[i]
        out.append(ranks[piece[i:e]])
        i = e
    return out


class ByteBPE:
    """Encoder and decoder for one rank file (base64 token, space, rank per line) and pattern."""

    def __init__(self, path: str, pattern: str, remembered: int):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        keys = list(self.ranks)
        self.whole = PerfectHash(keys)
        self.slot_rank = [0] * len(keys)
        for i, k in enumerate(keys):
            self.slot_rank[self.whole.slot_of[i]] = self.ranks[k]
        self.slot_bytes = [r.to_bytes(4, "little") for r in self.slot_rank]
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for k, r in self.ranks.items():
            self.token[r] = k
        self.encode = PieceEncoder(pattern, self._piece, remembered, remembered // 2).encode  # ids as little-endian unsigned 32-bit integers

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        slot = self.whole.get(raw)
        if slot >= 0:
            return self.slot_bytes[slot]
        merged = merge_bytes(raw, self.ranks)
        return struct.pack(f"<{len(merged)}I", *merged)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def load(path: str, pattern: str, remembered: int = CHUNK_ENTRIES) -> ByteBPE:
    remember("bpe", load.cache_clear)
    return ByteBPE(path, pattern, remembered)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: bool = False, remembered: int = CHUNK_ENTRIES) -> DataFrame:
    """Encode each whole text and decode it again; one narrow stage, no shuffle.

    Returns the input columns other than ``text`` that do not clash with the results, then
    n_tokens long, ids_sha256, decoded_sha256 (both lowercase hex), and with ``ids`` the column
    ids array<int>. Null and empty texts give no ids. Repeated rows stay repeated; an empty table
    gives an empty one. A clashing input column gives way to the result of the same name. Long
    texts are one row like others. Rows keep no order. ``remembered`` bounds the chunks a worker
    keeps (about 300 bytes each): more cost memory, fewer cost time.
    """
    bound_batches(docs.sparkSession)
    made = {"n_tokens", "ids_sha256", "decoded_sha256"} | ({"ids"} if ids else set())
    keep = [c for c in docs.columns if c != text and c not in made]
    src = docs.select(*[docs[c] for c in keep], docs[text].cast("string").alias(spare_name("text", keep)))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), OUT, *(["ids array<int>"] if ids else [])])

    def run(batches):
        for part in text_batches(batches, owner="bpe"):
            bpe = load(ranks_path, pattern, remembered)
            counts, hashed, back, lists = [], [], [], []
            for t in strings(part.column(part.num_columns - 1)):
                coded = bpe.encode(t)
                counts.append(len(coded) // 4)
                hashed.append(hashlib.sha256(coded).hexdigest())
                back.append(hashlib.sha256(bpe.decode(coded)).hexdigest())
                if ids:
                    lists.append(np.frombuffer(coded, "<u4").astype(np.int32))
            cols = [*part.columns[:-1], pa.array(counts, pa.int64()), pa.array(hashed, pa.string()), pa.array(back, pa.string())]
            names = [*part.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return src.mapInArrow(run, schema)
