import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import jaccard, shingles
from tessera.llm.components import components
from tessera.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def plain_set(t):
    w = words(t)
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain(data):
    sets = [plain_set(t) for _, t in data]
    index = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            index[x].append(i)
    met = defaultdict(int)
    for group in index.values():
        for x, a in enumerate(group):
            for b in group[x + 1 :]:
                met[a, b] += 1
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), k in met.items():
        if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
            x, y = find(a), find(b)
            if data[x][0] > data[y][0]:
                x, y = y, x
            root[y] = x
    return {d: (len(sets[i]), data[find(i)][0]) for i, (d, _) in enumerate(data)}


def answer(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_query(spark, small, texts):
    assert answer(QUERIES["op5_jaccard_join"](spark, small)) == plain(texts)


@pytest.mark.parametrize("blocks", [7, 1024])
def test_families_and_boilerplate(spark, monkeypatch, blocks):
    """Large families of near copies, a passage in most documents, and borderline likenesses."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    passage = [word() for _ in range(40)]
    data = []
    for family in range(6):
        base = [word() for _ in range(rng.choice([30, 90, 200]))]
        for _ in range(45):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = word()
            data.append(w)
    for _ in range(150):
        data.append([word() for _ in range(rng.randint(3, 120))] + passage)
    rows = [(i * 2 + 1, " ".join(w)) for i, w in enumerate(data)]
    rng.shuffle(rows)
    monkeypatch.setattr(jaccard, "OFTEN", 8)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", blocks)
    monkeypatch.setattr(jaccard, "PAIRS", 64)
    monkeypatch.setattr(jaccard, "SHORT_LIST", 12 if blocks == 7 else 400)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert answer(jaccard.jaccard_components(df)) == plain(sorted(rows))


def near_copies(rng, groups, copies, size, passage):
    """Texts of ``groups`` bases, each with a word changed here and there ``copies`` times, and a passage in all."""
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    common = [word() for _ in range(passage)]
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            w[rng.randrange(size)] = word()
            rows.append((len(rows), " ".join(w + common)))
    return rows


def test_copies_and_passages_grow_in_proportion(spark, monkeypatch):
    """A pair leaves as few rows, not one a list it meets in, and a set goes out once a passage, not once a list."""
    rows = near_copies(random.Random(3), 30, 6, 120, 60)
    made, sent = [], []
    possible, unit_links = jaccard._possible, jaccard._unit_links

    def counted(met, unlisted):
        made.append((met.count(), met.select("a", "b").distinct().count()))
        return possible(met, unlisted)

    def noted(units, full, name):
        sent.append((name, units.distinct().count()))
        return unit_links(units, full, name)

    monkeypatch.setattr(jaccard, "_possible", counted)
    monkeypatch.setattr(jaccard, "_unit_links", noted)
    monkeypatch.setattr(jaccard, "FREQUENT", 0)  # the passage is posted and makes long lists
    settings = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    usual = {k: spark.conf.get(k) for k in settings}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert answer(jaccard.jaccard_components(df)) == plain(rows)
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)
    assert all(0 < n <= 3 * pairs for n, pairs in made), made
    assert all(n <= 3 * len(rows) for _, n in sent), sent


def test_frequent_shingles_spread_over_many_runs(spark):
    """A shingle of 70 sets that meet two by two in 400 runs is frequent, one of four sets isn't."""
    rows = [(None, -1, None, [7, *([9] if i < 2 else [])] if i < 35 else [1000 + i], [2, *([2] if i < 2 else [])] if i < 35 else [2]) for i in range(400)]
    noted = spark.createDataFrame(rows, "doc_id long, n long, key binary, often array<long>, times array<long>")
    got = jaccard._frequent(noted).tolist()
    assert got[-1] == 7 and 1100 not in got
    assert jaccard._frequent(noted.limit(0)).tolist() == []


def test_large_families_send_their_own_sets_only(spark, monkeypatch):
    """Sets outside large families aren't sent for these, and one of them goes out once a set it is compared with."""
    rows = near_copies(random.Random(5), 1, 30, 120, 0) + [(1000 + i, t) for i, t in near_copies(random.Random(6), 40, 3, 60, 0)]
    sent = {}
    unit_links = jaccard._unit_links

    def noted(units, full, name):
        sent[name] = units.distinct().select("rep").collect()
        return unit_links(units, full, name)

    monkeypatch.setattr(jaccard, "_unit_links", noted)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
    assert answer(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)
    assert 0 < len(sent["jaccard-best-links"]) <= 2 * 30
    assert all(r["rep"] < 1000 for r in sent["jaccard-best-links"] + sent["jaccard-rest-links"])


def test_odd_rows(spark, odd, empty):
    rows = jaccard.jaccard_components(odd).collect()
    assert len(rows) == odd.count()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got[15][1] == 0 and got[0][0] == 14
    assert got[3] == (0, 3) and got[6] == (0, 6) and got[9] == (0, 9) and got[12] == (1, 12)
    assert got[None][1] is None
    assert jaccard.jaccard_components(empty).collect() == []
    kept = jaccard.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [0, 3, 6, 9, 12, 18, 21, 24, 27]
    assert kept.where("doc_id IS NULL").count() == 1


def test_shingle_hashes(texts):
    raw = [t.encode() for _, t in texts] + [b"", b" \n", b"x" * 500 + b" y", b"A b\x0bC\x0cd"]
    for t, s in zip(raw, shingles.sets(raw), strict=True):
        assert len(s) == len(plain_set(t.decode())) and np.all(np.diff(s.astype(object)) > 0) if len(s) > 1 else True
    assert shingles.sets([b"One two THREE four five"])[0].tolist() == shingles.sets([b"one  two\nthree four five "])[0].tolist()
    a, b = shingles.sets([b"p" * 300 + b" q", b"p" * 299 + b"r q"])
    assert a[0] != b[0]


@pytest.mark.parametrize("kind", ["path", "star", "random"])
def test_components(spark, kind):
    rng = random.Random(4)
    if kind == "path":
        edges = [(i, i + 1) for i in range(60)]
    elif kind == "star":
        edges = [(50, i) for i in range(50)] + [(70, 71)]
    else:
        edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for node in {x for e in edges if e[0] != e[1] for x in e}:
        seen, todo = {node}, [node]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got[node] == min(seen)
