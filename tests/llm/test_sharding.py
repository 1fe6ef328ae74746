import random
import zlib
from collections import defaultdict

import pytest

from tessera.llm.queries import QUERIES
from tessera.llm.sharding import minimax, shard


def plain(sizes, shards):
    def cuts(c):
        out, fill, total = [], 0, 0
        for z in sizes:
            if fill + z > c:
                out.append(total)
                fill = 0
            fill += z
            total += z
        return [*out, total] if len(out) < shards else None

    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        m = (lo + hi) // 2
        lo, hi = (lo, m) if cuts(m) else (m + 1, hi)
    c = cuts(lo)
    return lo, c + [c[-1]] * (shards - len(c))


def test_minimax_from_blocks():
    rng = random.Random(5)
    for _ in range(400):
        sizes = [rng.randint(1, rng.choice([5, 50, 1000])) for _ in range(rng.randint(1, 150))]
        shards = rng.randint(1, 12)
        pre = [0]
        for z in sizes:
            pre.append(pre[-1] + z)

        def blocks(lo, hi, n, pre=pre, sizes=sizes):
            idx = [i for i in range(len(sizes)) if pre[i] >= lo and pre[i + 1] <= hi]
            step, found = max(1, -(-len(idx) // n)), defaultdict(list)
            for i in idx:
                found[i // step].append(i)
            return sorted((pre[v[0]], pre[v[-1] + 1], len(v) == 1) for v in found.values())

        got = minimax(blocks(0, pre[-1], rng.choice([1, 3, 8])), max(sizes), shards, lambda rs, n: [x for a, b in rs for x in blocks(a, b, max(2, n))])
        assert (got.capacity, got.ends) == plain(sizes, shards)


def check(rows, data, shards):
    assert len(rows) == len(data)
    slots, where = defaultdict(list), defaultdict(set)
    texts = dict(data)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert r["size"] == len(t.encode()) + 16 if texts[r["doc_id"]] is not None else r["size"] == 16
        assert r["text_crc32"] == zlib.crc32(t.encode())
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        where[texts[r["doc_id"]]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(w) == 1 for w in where.values())


def test_query(spark, small, texts):
    rows = QUERIES["op2_sharding"](spark, small).collect()
    check(rows, texts, 40)
    groups = {}
    for d, t in texts:
        first, size = groups.get(t, (d, 0))
        groups[t] = (first, size + len(t.encode()) + 16)
    load = defaultdict(int)
    for r in rows:
        load[r["shard"]] += r["size"]
    alone, rest = [], sorted(groups.values())
    while True:
        left, room = sum(z for _, z in rest), 40 - len(alone)
        big = sorted((g for g in rest if g[1] > left // room), key=lambda g: -g[1])[: room - 1]
        if not big:
            break
        alone += big
        rest = [g for g in rest if g not in big]
    assert max(load.values()) == max([plain([z for _, z in rest], 40 - len(alone))[0], *(z for _, z in alone)])


def test_hot_group_has_its_own_shard(spark):
    rows = [(i, "hot text " * 40) for i in range(60)] + [(100 + i, f"text number {i} " * 20) for i in range(120)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    check(got, rows, 8)
    hot = {r["shard"] for r in got if r["doc_id"] < 60}
    assert len(hot) == 1 and not any(r["shard"] in hot for r in got if r["doc_id"] >= 100)
    assert {r["shard"] for r in got} == set(range(8))


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_odd_rows(odd, empty, shards):
    rows = shard(odd, shards).collect()
    assert len(rows) == odd.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard(empty, shards).collect() == []
