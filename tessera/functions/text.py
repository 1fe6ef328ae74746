"""String functions with Python's rules for white space and punctuation, as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that Python's str.strip and \s know.
SPACE = r"[\s\x1c-\x1f\x85\xa0  -     　]"
#: ASCII punctuation.
PUNCTUATION = r"[!-/:-@\[-\x60{-~]"

BEGIN, END, AUDIO = "<|im_start|>", "<|im_end|>", "<|audio|>"
ASSISTANT_HEADER = BEGIN + "assistant\n"
TRUNCATED = "<|truncated|>"

#: Tokens of the built-in tokenizer: whole markers, runs of word characters, other visible characters.
TOKEN = r"<\|[a-z_]+\|>|[0-9A-Za-z_]+|[^ \t-\r0-9A-Za-z_]"


def py_strip(c: Column) -> Column:
    """``str.strip()``."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def collapse_space(c: Column) -> Column:
    """Each run of white space becomes one space."""
    return F.regexp_replace(c, SPACE + "+", " ")


def normalize_answer(c: Column) -> Column:
    """Strip, lower, drop trailing punctuation once, collapse white space, strip."""
    return py_strip(collapse_space(F.regexp_replace(F.lower(py_strip(c)), PUNCTUATION + r"+\z", "")))


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Characters that canonical decomposition turns into one character and marks; these characters."""
    pairs = []
    for i in range(0xC0, sys.maxunicode + 1):
        if unicodedata.decomposition(chr(i)):
            bare = "".join(x for x in unicodedata.normalize("NFD", chr(i)) if unicodedata.category(x)[0] != "M")
            if len(bare) == 1 and bare != chr(i):
                pairs.append((chr(i), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(c: Column) -> Column:
    """Letters without their marks, composed or not; ASCII texts pass as they are."""
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.regexp_replace(F.translate(c, *_accents()), r"\p{M}+", "")).otherwise(c)


def normalize_text(c: Column) -> Column:
    """Drop (…) and […], accents and case; symbols become spaces; white space collapses."""
    bare = F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", ""), r"\[[^\]]*\]", "")
    return F.trim(F.regexp_replace(F.lower(strip_accents(bare)), r"[^\p{L}\p{N}]+", " "))


def tokens(c: Column) -> Column:
    """Tokens of the built-in tokenizer."""
    return F.regexp_extract_all(c, F.lit(TOKEN), 0)


def token_count(c: Column) -> Column:
    """Number of tokens of the stripped text; none for blank text."""
    return F.regexp_count(py_strip(c), F.lit(TOKEN)).cast("long")


def truncate_tokens(c: Column, limit: int) -> Column:
    """The text as it is up to ``limit`` tokens; else its first tokens, joined by single spaces."""
    found = tokens(c)
    return F.when(F.regexp_count(c, F.lit(TOKEN)) > limit, F.array_join(F.slice(found, 1, limit), " ")).otherwise(c)


def mark_truncated(text: Column, finish_reason: Column) -> Column:
    """Append the marker to responses that were cut by length."""
    return F.when(finish_reason == "length", F.concat(text, F.lit(TRUNCATED))).otherwise(text)


def tolerant_match(hyp: Column, ref: Column) -> Column:
    """True where the normalized reference isn't empty and occurs in the normalized answer.

    Equality and a match at word borders imply containment, so this one test is the whole rule.
    """
    r = normalize_answer(ref)
    return F.coalesce((r != "") & F.contains(normalize_answer(hyp), r), F.lit(False))
