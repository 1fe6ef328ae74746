import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from tessera.llm import bpe, token_counts, token_files
from tessera.llm.queries import QUERIES

RANKS, JSON, PIECES = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
STRANGE = st.text(alphabet="ab' \n\t\r\x1c\x85\xa0 sStTlLrRé日🎉0129!?-<|>", max_size=60)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    return t


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.get(k) for k in keys) == list(range(3000))
    assert all(h.get(f"other{i}".encode()) == -1 for i in range(3000))


@settings(max_examples=300, deadline=None)
@given(STRANGE)
def test_ids_equal_tiktoken(encoding, text):
    mine = bpe.load(RANKS, P.PATTERN)
    coded = mine.encode(text)
    assert np.frombuffer(coded, "<u4").tolist() == encoding.encode_ordinary(text)
    assert mine.decode(coded) == text.encode()


@settings(max_examples=300, deadline=None)
@given(STRANGE)
def test_ids_equal_library(library, text):
    got = token_files.library(JSON, P.PATTERN).encode([text], 2)[0]
    assert got.tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


def test_added_tokens_and_newer_characters():
    library, mine = Tokenizer.from_file(JSON), token_files.library(JSON, P.PATTERN)
    texts = ["some text <|endoftext|> more", "<|endoftext|>", "no <|endoftex|> here", "ab<|endoftext|><|endoftext|>\n\n x"]
    chars = "".join(chr(c) for c in range(128, 0x110000, 61) if not 0xD800 <= c < 0xE000) + "\ua7ce\u0c5c\x85\x1c\u200b\u180e"
    texts += [f"it's a{c}b 1{c}2 !{c}? {c} {c}" for c in chars]
    assert [x.tolist() for x in mine.encode(texts, None)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_piece(encoding):
    text = "ab" * 4000 + "é" * 500
    assert np.frombuffer(bpe.load(RANKS, P.PATTERN).encode(text), "<u4").tolist() == encoding.encode_ordinary(text)


def test_bpe_query(spark, small, texts, encoding):
    got = {r["doc_id"]: r for r in QUERIES["op8_byte_bpe"](spark, small).collect()}
    for d, t in texts:
        ids = encoding.encode_ordinary(t)
        assert got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_bpe_odd_rows(odd, empty):
    rows = bpe.encode_decode(odd, RANKS, P.PATTERN, ids=True).collect()
    assert len(rows) == odd.count()
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 6)} == {0}
    assert bpe.encode_decode(empty, RANKS, P.PATTERN).collect() == []


def test_token_files_query(spark, small, texts, library):
    got = sorted(QUERIES["op9_token_files"](spark, small).collect())
    start = 0
    for r, (d, t) in zip(got, texts, strict=True):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (d, start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_files_odd_rows(odd, empty):
    rows = token_files.token_files(odd, JSON, P.PATTERN).collect()
    assert len(rows) == odd.count()
    assert sum(r["n_tokens"] == 1 for r in rows) == 2
    ordered = sorted(rows, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in ordered])[:-1]]).tolist()
    assert ordered[0]["doc_id"] is None
    assert token_files.token_files(empty, JSON, P.PATTERN).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700))
def test_elias_fano(values):
    values.sort()
    ef = token_files.EliasFano.encode(np.array(values, np.uint64))
    sizes, raw = ef.parts()
    back = token_files.EliasFano.read(sizes, raw)
    assert back.decode().tolist() == values
    for i in range(0, len(values), 7):
        assert back.select(i) == values[i]


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000))
    sizes, raw = token_files.EliasFano.encode(ends).parts()
    assert len(raw) * 8 < 13.0 * len(ends)


def test_token_file_cut_short():
    with pytest.raises(ValueError, match="cut short"):
        token_files.TokenFile(b"TEF1....")


def plain_pieces(word, first, later):
    n, at = 0, 0
    while at < len(word):
        known = later if at else first
        end = len(word)
        while end > at and word[at:end] not in known:
            end -= 1
        if end == at:
            return 0
        n, at = n + 1, end
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=4), min_size=1), st.sets(st.text("abc", min_size=1, max_size=4)), st.lists(st.text("abcd", min_size=1, max_size=14), max_size=30))
def test_longest_match(first, later, words):
    automaton = token_counts.LongestMatch(sorted(first), sorted(later))
    assert [automaton.count(w) for w in words] == [plain_pieces(w, first, later) for w in words]


def test_token_counts_query(spark, small, texts):
    first, later = token_counts.pieces_of(PIECES)
    names = {p: i for i, p in enumerate([*first, *("##" + p for p in later), "[UNK]"])}
    model = models.WordPiece(names, unk_token="[UNK]", max_input_chars_per_word=10**9)
    words = regex.compile(token_counts.WORD)
    got = {r["doc_id"]: r for r in QUERIES["op10_token_counts"](spark, small).collect()}
    assert len(got) == len(texts)
    for d, t in texts:
        parts = [model.tokenize(w) for w in words.findall(t)]
        assert (got[d]["n_words"], got[d]["n_tokens"]) == (len(parts), sum(map(len, parts)))
        assert got[d]["n_unknown"] == sum(p[0].value == "[UNK]" for p in parts)


def test_token_counts_odd_rows(odd, empty):
    rows = token_counts.token_counts(odd, PIECES).collect()
    assert len(rows) == odd.count()
    assert {(r["n_words"], r["n_tokens"]) for r in rows if r["doc_id"] in (3, 6, 9)} == {(0, 0)}
    assert token_counts.token_counts(empty, PIECES).collect() == []


def test_clashing_columns(spark):
    """Input columns with names that operators use inside, or that results have."""
    rows = spark.createDataFrame([(1, "some text of a@b.org", "x", "y", "z", 4)], "doc_id long, text string, _t string, _text string, _row string, n_tokens int")
    from tessera.llm import jaccard, pii

    coded = bpe.encode_decode(rows, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert coded.columns[:4] == ["doc_id", "_t", "_text", "_row"] and coded.first()["_t"] == "x" and coded.first()["n_tokens"] > 4
    counted = token_counts.token_counts(rows, P.path("piece_bpe_32k.model"))
    assert counted.first()["_t"] == "x" and counted.first()["n_words"] > 0
    found = pii.spans(rows, pii.fit(rows))
    assert found.first()["_t"] == "x" and found.first()["n_email"] == 1
    assert jaccard.deduplicate(rows.unionByName(rows)).collect() == rows.collect()
    files = token_files.token_files(rows, P.path("byte_bpe_50k.json"), P.PATTERN)
    assert [r["doc_id"] for r in files.collect()] == [1]


def test_folder_without_a_scheme(spark, tmp_path):
    rows = spark.createDataFrame([(2, "two"), (1, "one"), (None, "none")], "doc_id long, text string")
    got = token_files.token_files(rows, P.path("byte_bpe_50k.json"), P.PATTERN, str(tmp_path / "ids"))
    assert sorted((r["doc_id"] or 0, r["start"], r["n_tokens"]) for r in got.collect()) == [(0, 0, 2), (1, 2, 2), (2, 4, 2)]
    assert token_files.qualified(spark, str(tmp_path)).startswith("file:///")
