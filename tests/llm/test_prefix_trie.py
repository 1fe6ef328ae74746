import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import prefix_trie
from tessera.llm.queries import QUERIES

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, depth int, k string"


def own_turns(rows):
    """conv_id -> [(role, text)]; null turns first, equal turns by their digest, as documented."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}|{role}{text}".encode()).hexdigest(), (role, text)))
    return {c: [t[3] for t in sorted(ts)] for c, ts in by.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute(convs):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) if children[p] else 1
        saved[p] = sum(saved[x] for x in children[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], digest(ends[p])) for p, m in members.items())


def collected(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect())


def made(rng, n, longest, words=3):
    rows = []
    for c in rng.sample(range(400), n):
        last = [("user", f"{'é' * rng.randint(0, 3)}{rng.randint(1, words)}") for _ in range(rng.randint(1, longest))]
        rows += [(c, t, *x) for t, x in enumerate(last)]
        if rng.random() < 0.3:  # a copy, a prefix or a continuation
            other = [*last[: rng.randint(1, longest)], *([("assistant", "x")] * rng.randint(0, 1))]
            rows += [(1000 + c, t, *x) for t, x in enumerate(other)]
    return rows


@pytest.mark.parametrize(("seed", "block", "turns"), [(1, 4, 2), (2, 7, 64), (3, 8192, 3), (4, 1, 1)])
def test_trie_equals_brute_force(spark, monkeypatch, seed, block, turns):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "TURNS", turns)
    rng = random.Random(seed)
    rows = made(rng, 60, 9)
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA)
    assert collected(prefix_trie.prefix_trie(df)) == brute(own_turns(rows))
    if seed < 3:
        assert collected(prefix_trie.shared_prefix_trie(df)) == brute(rebuilt(own_turns(rows)))


def test_odd_rows(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, None, None), (5, 0, "user", "hi"), (5, 0, "user", "hi"), (7, None, "user", "hi"), (7, 3, "", ""), (None, 0, "user", "lost"), (9, 0, "us", "erhi"), (11, 2, None, "x" * 100_000), (-3, 0, "user", "hi"), (205, 0, "a", "b")]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    own = own_turns(rows)
    assert collected(prefix_trie.prefix_trie(df)) == brute(own)
    positive = {c: t for c, t in own.items() if c >= 0}  # Python's remainder of negatives differs from SQL's
    assert collected(prefix_trie.shared_prefix_trie(df.where("conv_id >= 0"))) == brute(rebuilt(positive))
    assert prefix_trie.shared_prefix_trie(df.where("false")).count() == 0


def test_one_long_conversation_and_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    rows = [(1, t, "user", f"t{t}") for t in range(500)] + [(2, t, "user", f"t{t}") for t in range(200)] + [(3, t, "user", "other" if t == 130 else f"t{t}") for t in range(140)]
    rows += [(c, t, "user", f"c{t}") for c in range(10, 60) for t in range(3)]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)
    assert collected(prefix_trie.prefix_trie(df)) == brute(own_turns(rows))


def test_query_equals_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(QUERIES["op13_prefix_trie"](spark, small)) == brute(rebuilt(own_turns(rows)))


def test_nearest_smaller_and_range_minima():
    rng = random.Random(8)
    for _ in range(200):
        v = [rng.randint(0, 4) for _ in range(rng.randint(1, 30))]
        left, right = prefix_trie.nearest_smaller(np.array(v))
        low = prefix_trie.RangeMin(np.array(v))
        for i, x in enumerate(v):
            before = [j for j in range(i) if v[j] < x]
            after = [j for j in range(i + 1, len(v)) if v[j] < x]
            assert left[i] == low.before(i, x) == (before[-1] if before else -1)
            assert right[i] == low.after(i, x) == (after[0] if after else -1)
            j = rng.randint(i, len(v) - 1)
            assert low.get(i, j) == min(v[i : j + 1])
