import zlib

import numpy as np

from tessera.llm import quality
from tessera.llm.queries import QUERIES


def test_query(spark, small, texts):
    rows = {r["doc_id"]: r for r in QUERIES["op3_quality_classifier"](spark, small).collect()}
    assert len(rows) == len(texts)
    for d, _ in texts:
        r = rows[d]
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op3_quality_classifier"](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    y = np.array([labels[r["doc_id"]] for r in rows])
    s = np.array([r["score"] for r in rows])
    assert ((s >= 0.5) == y).mean() > 0.96
    order = s.argsort()
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.97
    assert (s[y == 1] >= 0.5).mean() > 0.98


def test_held_out_labels_are_never_read(spark, documents):
    ids = [r["doc_id"] for r in documents.collect()]
    flip = lambda d, bad: 1 - bad if zlib.crc32(str(d).encode()) % 3 == 1 else d % 2
    make = lambda bad: spark.createDataFrame([(d, flip(d, bad)) for d in ids], "doc_id long, quality int")
    a, b = quality.fit(documents, make(0)), quality.fit(documents, make(1))
    assert a.good == b.good and a.bad == b.bad and np.allclose(a.weights, b.weights)


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(0, 1), (0, 0), (24, 0), (None, 1), (15, None), (27, 1), (18, 7)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (3, 6)}) == 1
    assert quality.score(empty, model).collect() == []
    none = quality.fit(empty, labels.limit(0))
    assert {r["score"] for r in quality.score(odd, none).collect()} == {0.5}


def test_long_text_does_not_end_the_sample():
    rows = [(1, 0, 5), (2, 1, 900), (3, 0, 200), (4, 0, 90), (5, 0, 5), (6, 0, 1)]
    assert quality._within(rows, 100) == [(1, 0), (4, 0), (5, 0), (2, 1)]


def test_fit_passes_over_a_long_text(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit_texts", lambda texts, labels, counts=None: seen.append(list(zip(texts, labels, strict=True))))
    docs = spark.createDataFrame([(i, "x" * (500 if i % 3 == 0 else 10)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    quality.fit(docs, labels, size=400)
    known = labels.where(~quality.held_out(labels["doc_id"])).collect()
    short = sorted(r["quality"] for r in known if r["doc_id"] % 3)
    assert sorted(y for t, y in seen[0] if len(t) == 10) == short


def test_scores_equal_a_plain_compressor_loop(spark, documents, texts):
    """Each text compressed on its own with each dictionary, the formula of the score written out."""
    import math

    import zstandard

    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.fit(documents, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(documents, model).collect()}
    for d, t in [*texts, (-1, ""), (-2, "word " * 20_000), (-3, "x" * 1_000_000)]:
        raw = (t or "").encode()
        size = []
        for dictionary in (model.good, model.bad):
            plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
            made = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, **plain)
            size.append(len(made.compress(raw)))
        diff = 10 * (size[1] - size[0]) / (size[0] + size[1])
        ratio = min(max(math.log(min(size) / len(raw)), -6), 2) if raw else 0.0
        low, short = max(-1.5 - ratio, 0), 1 / math.sqrt(1 + len(raw) / 50)
        z = sum(w * x for w, x in zip(model.weights, (1, diff, low, short, diff * short, max(diff, 0)), strict=True))
        want = 1 / (1 + math.exp(-min(max(z, -30), 30)))
        mine = got[d] if d >= 0 else float(model.score([raw])[0])
        assert abs(mine - want) < 1e-9
