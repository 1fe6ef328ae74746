"""A million characters without a space, 20,000 words and 200,000 one-letter words, beside ordinary rows."""

import zlib

import public_tokenizers as P
import pytest

from tessera.llm import decontaminate, fingerprints, packing, pii, quality, sharding, token_counts

PROBLEM = "If Anna buys 12 kg of apples and Anna gives 5 kg of them to her neighbour then how many apples does she keep for the winter"
LONG = ["x" * 1_000_000, " ".join(f"word{i}" for i in range(20_000)) + " " + PROBLEM, "a " * 200_000, "", None, "short text", "short text"]


@pytest.fixture(scope="module")
def long(spark):
    return spark.createDataFrame([(i, t, "n") for i, t in enumerate(LONG)], "doc_id long, text string, size string").cache()


def test_sharding(long):
    rows = {r["doc_id"]: r for r in sharding.shard(long, 3).collect()}
    assert len(rows) == len(LONG)
    for i, t in enumerate(LONG):
        assert rows[i]["size"] == len((t or "").encode()) + 16 and rows[i]["text_crc32"] == zlib.crc32((t or "").encode())
    assert rows[5]["shard"] == rows[6]["shard"]
    for shard in {r["shard"] for r in rows.values()}:
        slots = sorted(r["slot"] for r in rows.values() if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_quality(spark, long):
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(LONG))], "doc_id long, quality int")
    rows = quality.score(long, quality.fit(long, labels)).collect()
    assert len(rows) == len(LONG) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["text"] == "short text"}) == 1


def test_decontamination(spark, long):
    items = spark.createDataFrame([(1, PROBLEM), (2, "word5 word6 word7 word8 word9 and some more words")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(long, items).collect()} == {(1, 1)}


def test_ties_of_equal_diagonals(spark):
    """A text that holds an item twice: the diagonals tie, the earlier one is reported, once."""
    docs = spark.createDataFrame([(1, f"one {PROBLEM} two three {PROBLEM}")] * 2, "doc_id long, text string")
    items = spark.createDataFrame([(7, PROBLEM), (8, PROBLEM)], "item_id long, text string")
    rows = sorted(tuple(r) for r in decontaminate.contamination(docs, items).select("doc_id", "item_id", "position", "coverage").collect())
    assert rows == [(1, 7, 1, 1.0), (1, 8, 1, 1.0)]


def test_other_operators_keep_all_rows(long):
    assert fingerprints.fingerprints(long).count() == len(LONG)
    assert pii.spans(long, pii.fit(long)).count() == len(LONG)
    counts = {r["doc_id"]: r["n_words"] for r in token_counts.token_counts(long, P.path("piece_bpe_32k.model")).collect()}
    assert counts[0] == 1 and counts[2] == 200_000 and counts[3] == counts[4] == 0
    packed = packing.pack_documents(long, P.path("word_bpe_49k.json"))
    assert {r["doc_id"] for r in packed.collect()} == set(range(len(LONG)))
