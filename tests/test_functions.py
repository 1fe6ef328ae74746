import math
import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import lengths, text as tx
from tessera.operators import chat


def one(spark, values, kind, f):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[1] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        (lengths.whisper, {0: 0, 1: 1, 2: 1, 99: 50, 100: 50, 101: 51, 3000: 1500}),
        (lengths.audio_v25, {0: 0, 1: 0, 2: 0, 99: 25, 100: 25, 101: 25, 150: 37, 3000: 750}),
        (lengths.audio_v3, {0: 0, 1: 1, 2: 1, 99: 13, 100: 13, 101: 14, 150: 20, 200: 26, 3000: 390}),
    ],
)
def test_encoder_lengths(spark, rule, want):
    assert one(spark, list(want), "long", rule) == list(want.values())


def test_length_errors(spark):
    with pytest.raises(ValueError, match="unknown encoder"):
        lengths.audio_tokens(F.lit(1), "nope")
    with pytest.raises(ValueError, match="positive"):
        lengths.audio_tokens(F.lit(1), "whisper", 0)
    with pytest.raises(Exception, match="unknown encoder"):
        one(spark, [5], "long", lambda c: lengths.audio_tokens_by_name(c, F.lit("nope"), F.lit(2)))


def test_half_even(spark):
    assert one(spark, [0.2, 0.12, 0.04, 0.28], "double", lengths.estimated_audio_tokens) == [2, 2, 0, 4]


def python_answer(s):
    s = s.strip().lower().rstrip(string.punctuation)
    return re.sub(r"\s+", " ", s).strip()


ANSWERS = ["Train.", "Train . .", "...", " A\t b ", "", "\xa0NBSP  x　", "train.\n", "a\x1cb", "x y.", "Ends?!"]


def test_normalize_answer(spark):
    assert one(spark, ANSWERS, "string", tx.normalize_answer) == [python_answer(s) for s in ANSWERS]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\xa0　\x1cabC.,!?'-é", max_size=12), min_size=1, max_size=30))
def test_normalize_answer_property(spark, values):
    assert one(spark, values, "string", tx.normalize_answer) == [python_answer(s) for s in values]


def test_match(spark):
    pairs = [("A train", "a"), ("trains", "train"), ("x", "..."), ("", "a"), ("The answer is Train.", "train"), (None, "a"), ("a", None)]
    df = spark.createDataFrame(pairs, "h string, r string")
    got = [r[0] for r in df.select(tx.tolerant_match(F.col("h"), F.col("r"))).collect()]
    assert got == [True, True, False, False, True, False, False]


def test_match_is_the_three_tier_rule(spark):
    def tiers(h, r):
        h, r = python_answer(h), python_answer(r)
        if not r:
            return False
        return h == r or r in h or (len(r.split()) == 1 and re.search(r"\b" + re.escape(r) + r"\b", h) is not None)

    values = ["", "a", "A train", "train.", "in", "the train, a", "...", "x y"]
    pairs = [(h, r) for h in values for r in values]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, h string, r string").orderBy("i")
    got = [r[0] for r in df.select(tx.tolerant_match(F.col("h"), F.col("r")).alias("m"), "i").orderBy("i").collect()]
    assert got == [tiers(*p) for p in pairs]


def test_normalize_text(spark):
    got = one(spark, ["Élan (x) vital [y]!  Ça-va?", "ß æ", None], "string", tx.normalize_text)
    assert got == ["elan vital ca va", "ß æ", None]


def test_tokens(spark):
    assert one(spark, ["  a b!<|audio|>é ", "", "  "], "string", tx.token_count) == [5, 0, 0]
    assert one(spark, ["a b c d", "a b"], "string", lambda c: tx.truncate_tokens(c, 3)) == ["a b c", "a b"]


def test_strip_last_assistant(spark):
    head = tx.ASSISTANT_HEADER
    got = one(spark, ["hi", f"q{head}one{head}two", head], "string", chat.strip_last_assistant)
    assert got == ["hi" + head, f"q{head}one{head}", head]


def test_render(spark):
    conv = chat.build_conversation(F.lit("a.wav"), F.lit("Trading."), F.lit("Please transcribe."), F.lit(None).cast("string"))
    got = spark.range(1).select(chat.render(conv), chat.render(chat.build_conversation(F.lit("a"), F.lit("r"), F.lit(""), F.lit("s"))), chat.normalize_parts(conv)[0]["content"]).first()
    assert got[0] == "<|im_start|>user\n<|audio|>Please transcribe.<|im_end|>\n<|im_start|>assistant\nTrading.<|im_end|>\n"
    assert got[1] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\n<|audio|><|im_end|>\n<|im_start|>assistant\nr<|im_end|>\n"
    assert got[2] == "<|audio|> Please transcribe."


def test_render_rejects_unknown_part(spark):
    conv = F.array(chat.turn("user", F.struct(F.lit("video").alias("type"), F.lit("v").alias("audio"), F.lit("t").alias("text"))))
    with pytest.raises(Exception, match="unknown content type"):
        spark.range(1).select(chat.render(conv)).collect()


def test_response_of(spark):
    df = spark.sql("SELECT map('answer', 'a') c, 't' t UNION ALL SELECT map('answer', cast(null as string)), 't' UNION ALL SELECT map('x', 'y'), 't' UNION ALL SELECT null, 't'")
    assert [r[0] for r in df.select(chat.response_of(F.col("c"), F.col("t"))).collect()] == ["a", None, "t", "t"]


def test_qa_conversation_requires_question(spark):
    with pytest.raises(Exception, match="question is missing"):
        spark.range(1).select(chat.render(chat.build_qa_conversation(F.lit("a"), F.lit(None).cast("string"), F.lit("x")))).collect()


def test_monotone_lengths(spark):
    got = one(spark, list(range(1, 400)), "long", lengths.audio_v3)
    for i in range(len(got) - 1):
        if (i + 1) // 100 == (i + 2) // 100:
            assert got[i] <= got[i + 1]
    assert one(spark, list(range(300)), "long", lengths.whisper) == [math.ceil(m / 2) for m in range(300)]
