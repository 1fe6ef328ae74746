import random
import re
from collections import defaultdict

import numpy as np

from tessera.llm import repeats
from tessera.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(data):
    lists = [(d, WORD.findall(t or "")) for d, t in data if d is not None]
    where = defaultdict(set)
    for d, w in lists:
        for j in range(len(w) - 49):
            where[tuple(w[j : j + 50])].add(d)
    out = {}
    for d, w in lists:
        spans = []
        for j in range(len(w) - 49):
            if len(where[tuple(w[j : j + 50])]) > 1:
                if spans and j <= spans[-1][1]:
                    spans[-1][1] = j + 50
                else:
                    spans.append([j, j + 50])
        if spans:
            out[d] = ",".join(f"{a}:{b}" for a, b in spans)
    return out


def answer(df):
    return {r["doc_id"]: r["spans"] for r in df.collect()}


def test_query(spark, small, texts):
    assert answer(QUERIES["op6_suffix_array_dedup"](spark, small)) == plain(texts)


def planted(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    some = lambda n: [word() for _ in range(n)]
    shared = [some(n) for n in (49, 50, 51, 60, 130, 400)]
    data = []
    for i in range(120):
        w = some(rng.randint(0, 150))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(shared)
        data.append((i, " ".join(w)))
    base = some(300)
    for i in range(30):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = word()
        data.append((1000 + i, " ".join(w)))
    data += [(2000, " ".join(base)), (2001, "le " * 300), (2002, "le " * 200 + "x"), (2003, " ".join(some(60) * 3)), (2004, "same short text"), (2005, "same short text")]
    return data


def test_planted(spark):
    for seed in (1, 2):
        data = planted(seed)
        assert answer(repeats.repeats(spark.createDataFrame(data, "doc_id long, text string"))) == plain(data)


def test_crowded_seeds(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SORTED", 3)
    data = planted(3)
    got = answer(repeats.repeats(spark.createDataFrame(data, "doc_id long, text string")))
    assert got == plain(data)


def test_minimisers_cover_every_window():
    rng = np.random.default_rng(2)
    for top in (3, 50, 1 << 40):
        g = rng.integers(0, top, 400).astype(np.uint64)
        g[100:220] = 0
        at = repeats.minimisers(g, 43)
        assert all(((at >= s) & (at < s + 43)).any() for s in range(len(g) - 42))
        assert len(repeats.minimisers(np.zeros(1000, np.uint64), 43)) < 60


def records(rng, shared, lead):
    """A list of 17-word records that open with one phrase of eight words, ``shared`` at its end."""
    phrase = [f"p{i}" for i in range(8)]
    rest = [f"q{i}" for i in range(8)]
    return [w for r in [*(rng.randrange(10**9) for _ in range(lead)), *shared] for w in [*phrase, f"r{r}", *rest]]


def test_records_after_odd_and_even_leads(spark):
    rng = random.Random(5)
    data = []
    for pair in range(40):
        shared = [rng.randrange(10**9) for _ in range(8)]
        for side in range(2):
            data.append((2 * pair + side, " ".join(records(rng, shared, 3 * pair + side))))
    assert answer(repeats.repeats(spark.createDataFrame(data, "doc_id long, text string"))) == plain(data)


def test_periodic_texts(spark):
    rng = random.Random(6)
    data = []
    for i in range(150):
        unit = rng.choice([["le"], ["le"], ["le", "la"], [f"u{j}" for j in range(9)], [f"u{j}" for j in range(17)]])
        shift = rng.randrange(len(unit))
        run = (unit * 200)[shift : shift + rng.choice([49, 50, 51, 60, 70, 100, 200])]
        edge = lambda: [rng.choice("xyz") for _ in range(rng.choice([0, 0, 1, 10, 30]))]
        data.append((i, " ".join(edge() + run + edge())))
    assert answer(repeats.repeats(spark.createDataFrame(data, "doc_id long, text string"))) == plain(data)


def near_copies(seed, n, share):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    base = [word() for _ in range(300)]
    return [(i, " ".join(word() if rng.random() < share else w for w in base)) for i in range(n)]


def test_hundreds_of_near_copies(spark):
    for seed, n, share in ((7, 200, 0.03), (8, 400, 0.04)):
        data = near_copies(seed, n, share)
        assert answer(repeats.repeats(spark.createDataFrame(data, "doc_id long, text string"))) == plain(data)


def test_partner_behind_neighbours():
    rng = np.random.default_rng(9)
    for size in (3, 12, 40):
        left, right = (rng.integers(1, 3, (size, repeats.REACH)).astype(np.uint32) for _ in range(2))
        for side in (left, right):
            for row in range(size):
                side[row, rng.integers(8, 50) :] = rng.choice([0, row + 5])
        doc = rng.integers(0, size, size)
        i, lo, hi = repeats.extend(doc, left, right)
        got = {(a, j) for a, x, y in zip(i.tolist(), lo.tolist(), hi.tolist(), strict=True) for j in range(max(0, repeats.REST - y), min(x, repeats.REST) + 1)}
        side = lambda a, j: (left[a, :j].tolist(), right[a, : repeats.REST - j].tolist())
        ok = lambda a, j: all(side(a, j)[0]) and all(side(a, j)[1])
        want = {(a, j) for a in range(size) for j in range(repeats.REST + 1) if ok(a, j) and any(doc[a] != doc[b] and side(a, j) == side(b, j) for b in range(size))}
        assert got == want


def test_odd_rows(spark, odd, empty):
    assert repeats.repeats(odd).collect() == []
    long = " ".join(f"w{i}" for i in range(2500))
    again = spark.createDataFrame([(1, long, 0), (2, long, 0), (2, long, 0), (None, long, 0), (3, None, 0), (4, "pre " + long, 0)], "doc_id long, text string, spans int")
    assert answer(repeats.repeats(again)) == {1: "0:2500", 2: "0:2500", 4: "1:2501"}
    once = spark.createDataFrame([(1, long), (1, long), (None, long)], "doc_id long, text string")
    assert answer(repeats.repeats(once)) == {}
    assert repeats.repeats(empty).collect() == []
