"""Ids of a lower-casing BPE with word ends, asking the tokenizers library once per distinct piece.

Such a vocabulary drops white space and encodes each match of its pattern by itself, so pieces that
were seen before are looked up. New ones go to the library together, joined by spaces; the tokens
that end a word show where each piece's ids end. The short cut is for texts, or single words between
white space, of ASCII and Latin-1 letters, for which this module's pattern is the library's; other
words are encoded by the library one by one, and texts with an added token, or with a control
character that Python takes for white space, as a whole.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import filterfalse

import numpy as np

from tessera.llm.common import remember

#: Remembered pieces and words (about 200 bytes each), and pieces that the library gets at once.
ENTRIES, TOGETHER = 900_000, 200

_LETTERS = "a-zß-öø-ÿ"
_PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s0-9{_LETTERS}]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Fixed value: the pattern of the vocabulary's pre-tokenizer, for which ``_PIECES`` stands.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """Ids as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if PATTERN not in str(self.library.pre_tokenizer).replace("\\\\", "\\") or "Lowercase" not in str(self.library.normalizer):
            raise ValueError("a lower-casing tokenizer with the known pattern is needed")
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        suffix = self.library.model.end_of_word_suffix
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}

    def _ask(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, pieces: list[str]) -> None:
        for i in range(0, len(pieces), TOGETHER):
            some = pieces[i : i + TOGETHER]
            ids = self._ask(" ".join(some))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and (not len(ids) or cuts[-1] == len(ids)):
                raw, at = ids.tobytes(), 0
                for p, cut in zip(some, (cuts * 4).tolist(), strict=True):
                    self.known[p] = raw[at:cut]
                    at = cut
            else:
                self.known.update((p, self._ask(p).tobytes()) for p in some)

    def _words(self, text: str) -> list[str]:
        """Keys whose ids end to end are the text's; those that hold other than plain characters are whole words."""
        if _PLAIN.fullmatch(text):
            return _PIECES.findall(text.lower())
        out: list[str] = []
        for word in text.split():
            if _PLAIN.fullmatch(word):
                out += _PIECES.findall(word.lower())
            else:
                out.append(word)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as the library gives them without special tokens."""
        apart = [any(token in t for token in self.added) or bool(_ODD_SPACE.search(t)) for t in texts]
        keys = [[] if a else self._words(t) for a, t in zip(apart, texts, strict=True)]
        if len(self.known) > ENTRIES:
            self.known.clear()
        new = set(filterfalse(self.known.__contains__, set().union(*keys)))
        plain = [k for k in new if _PLAIN.fullmatch(k)]
        self._learn(plain)
        for k in new.difference(plain):
            self.known[k] = self._ask(k).tobytes()
        get = self.known.__getitem__
        return [self._ask(t).tobytes() if a else b"".join(map(get, ks)) for a, t, ks in zip(apart, texts, keys, strict=True)]


@lru_cache(maxsize=1)
def load(path: str) -> WordEncoder:
    remember("word_ids", load.cache_clear)
    return WordEncoder(path)
