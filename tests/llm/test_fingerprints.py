import hashlib
import random

import pytest

from tessera.llm import fingerprints as fp
from tessera.llm.queries import QUERIES


def lcs(x, y):
    d = [0] * (len(y) + 1)
    for p in x:
        q = 0
        for j, w in enumerate(y, 1):
            q, d[j] = d[j], (q + 1 if p == w else max(d[j], d[j - 1]))
    return d[-1]


def plain_fingerprint(text):
    """The definition, byte by byte."""
    data = text.encode()
    if not data:
        return "1::"
    m = (1 << 32) - 1

    def mix(x):
        x ^= x >> 16
        x = x * 0x7FEB352D & m
        x ^= x >> 15
        x = x * 0x846CA68B & m
        return x ^ x >> 16

    h = []
    for i in range(len(data)):
        x = int(fp._TABLE[data[i]])
        for k in range(1, min(fp.WINDOW, i + 1)):
            t = int(fp._TABLE[data[i - k]])
            x ^= (t << 4 * k | t >> (32 - 4 * k)) & m
        h.append(mix(x))

    def signature(size):
        out, total = "", 0
        for i, x in enumerate(h):
            total = total + x & m
            if x & (size - 1) == size - 1 or i == len(h) - 1:
                out += fp.ALPHABET[mix(total) >> 26]
                total = 0
        return out

    size = 1 if len(data) <= fp.LONGEST else 2
    while len(s := signature(size)) > fp.LONGEST:
        size *= 2
    return f"{size}:{s}:{signature(size * 2)}"


def test_fingerprint_definition(texts):
    for t in [t for _, t in texts[:40]] + ["", "a", "ab" * 500, "x" * 200, "é" * 64]:
        assert fp.fingerprint(t) == plain_fingerprint(t)


def test_likeness_is_edit_distance():
    rng = random.Random(3)
    make = lambda: ["".join(rng.choices(fp.ALPHABET[:5], k=rng.randint(1, 64))) for _ in range(200)]
    left, right = make(), make()
    for x, y, got in zip(left, right, fp.signature_likeness(left, right), strict=True):
        need = 3 if min(len(x), len(y)) < 12 else 4
        shared = any(x[i : i + need] in y for i in range(len(x) - need + 1))
        want = 1.0 if x == y else 2 * lcs(x, y) / (len(x) + len(y)) if shared else 0.0
        assert got == pytest.approx(want)


def test_incompatible_sizes_are_unlike():
    assert fp.likeness(["2:abcd:ab", "2:abcd:ab", "4:ab:a", "8:ab:a"], ["2:abcd:ab", "4:ab:a", "2:abcd:ab", "2:ab:ab"]).tolist()[0] == 1.0
    assert fp.likeness(["8:abcdef:ab"], ["2:abcdef:ab"]).tolist() == [0.0]


def check(rows, data):
    by = {r["doc_id"]: r for r in rows}
    for i, (doc, text) in enumerate(data):
        following = data[(i + 1) % len(data)][1]
        edited = fp.edited(text, following)
        r = by[doc]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fp.fingerprint(text)
        assert r["near_edited"] == pytest.approx(fp.likeness([r["fingerprint"]], [fp.fingerprint(edited)])[0])
        assert r["near_next"] == pytest.approx(fp.likeness([r["fingerprint"]], [fp.fingerprint(following)])[0])


def test_query(spark, small, texts):
    rows = QUERIES["op1_document_fingerprints"](spark, small).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    assert sum(r["near_edited"] > 0.3 for r in rows) > 0.9 * len(rows)


def test_odd_rows(odd, empty, spark):
    rows = fp.fingerprints(odd).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    same = [r["fingerprint"] for r in rows if r["doc_id"] in (0, 15)]
    assert len(set(same)) == 1
    assert fp.fingerprints(empty).collect() == []
    one = spark.createDataFrame([(7, "alone here")], "doc_id long, text string")
    check(fp.fingerprints(one).collect(), [(7, "alone here")])
