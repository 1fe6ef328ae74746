import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from tessera.llm import periodic
from tessera.llm.queries import QUERIES, with_planted_run


def brute(words):
    """Every period of every stretch, by its definition."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        s = 0
        while s < n - q:
            e = s
            while e < n - q and words[e] == words[e + q]:
                e += 1
            if e > s and e - s + q >= max(24, 3 * q):
                found.setdefault((s, e - s + q), q)
            s = max(e, s + 1)
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def made(rng, n):
    few = [b"w%d" % i for i in range(rng.choice([1, 2, 3, 40]))]
    words = [rng.choice(few) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        a, q = rng.randrange(n), 1 + rng.randrange(max(1, n // 4))
        for i in range(a, min(n, a + rng.randint(0, n))):
            words[i] = words[a + (i - a) % q]
    return words


def collapsed(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_equal_brute_force(monkeypatch):
    rng = random.Random(5)
    texts = [made(rng, rng.randint(1, 150)) for _ in range(300)] + [[b"a"] * 23, [b"a"] * 24, [b"a", b"b"] * 12, []]
    want = [brute(t) for t in texts]
    for together in (1, 500, periodic.TOGETHER):
        monkeypatch.setattr(periodic, "TOGETHER", together)
        assert periodic.runs_of(texts) == want
    assert sum(map(len, want)) > 100
    assert [len(r) for r in want[-4:]] == [0, 1, 1, 0]
    for t, r in zip(texts, want, strict=True):
        assert periodic.collapse(t, r) == collapsed(t, r)


def test_ranges_cover_all_lags(monkeypatch):
    monkeypatch.setattr(periodic, "PAIRS", 1000)
    for n in (0, 23, 24, 30, 100, 999, 3000):
        ranges = periodic.lag_ranges(n)
        assert [x for a, b in ranges for x in range(a, b + 1)] == (list(range(1, n // 3 + 1)) if n >= 24 else [])
        assert len(ranges) <= periodic.RANGES


def test_query_equals_brute_force(spark, small, texts):
    rows = {r["doc_id"]: r for r in QUERIES["op12_periodic_runs"](spark, small).collect()}
    assert len(rows) == len(texts)
    planted = 0
    for d, t in texts:
        words = t.encode().split()
        if words and zlib.crc32(str(d).encode()) % 10 == 0:
            g, n = zlib.crc32(str(d).encode()) // 10, len(words)
            a, planted = g % n, planted + 1
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs, got = brute(words), rows[d]
        assert got["n_runs"] == len(runs)
        assert got["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert got["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs)).hexdigest()
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        assert (got["start"], got["length"], got["period"]) == best
        assert got["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
    assert planted > 5


def test_strongest_ties(spark):
    df = spark.createDataFrame([([(5, 30, 3), (9, 20, 2), (40, 31, 3), (50, 62, 6)],), ([],)], f"runs {periodic.RUNS}")
    assert [r[0] and tuple(r[0]) for r in df.select(periodic.strongest(df["runs"]).alias("b")).collect()] == [(40, 31, 3), None]


@pytest.mark.parametrize("long_bytes", [periodic.LONG_BYTES, 100, 0])
def test_odd_rows_and_dealt_lags(odd, empty, spark, monkeypatch, long_bytes):
    monkeypatch.setattr(periodic, "LONG_BYTES", long_bytes)
    monkeypatch.setattr(periodic, "PAIRS", 500)
    rng = random.Random(9)
    rows = [(i, b" ".join(made(rng, rng.randint(1, 200))).decode(), "x") for i in range(40)]
    rows += [rows[3], rows[3], (None, rows[4][1], "y"), (77, "word " * 5000, None), (78, "a\x0bb\x1cc\x85d " * 60, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted((r["doc_id"] or -1, r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in periodic.periodic_runs(df).collect())
    want = []
    for d, t, _ in rows:
        words = t.encode().split()
        runs = brute(words) if len(words) < 4000 else [(0, 5000, 1)]
        want.append((-1 if d is None else d, len(words), tuple(runs), collapsed(words, runs).decode()))
    want = sorted((x[0] or -1, *x[1:]) for x in want)
    assert got == want
    rows = periodic.periodic_runs(odd).collect()
    assert len(rows) == odd.count() and rows[0].asDict().keys() == {"doc_id", "lang", "n_tokens", "score", "n_words", "runs", "collapsed"}
    assert all(r["collapsed"] == "" for r in rows if not r["n_words"])
    assert periodic.periodic_runs(empty).count() == 0


def test_long_texts(spark):
    words = [b"x%d" % (i % 4001) for i in range(14_000)]
    df = spark.createDataFrame([(1, b" ".join(words).decode()), (2, "z" * 1_000_000), (3, "q " * 200_000)], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periodic.periodic_runs(df).collect()}
    assert got == {1: [(0, 14_000, 4001)], 2: [], 3: [(0, 200_000, 1)]}


def test_null_id_is_not_edited():
    assert with_planted_run(None, [b"a"] * 3) == [b"a"] * 3
