"""Greedy word-piece lengths from a linear longest-match automaton.

A word's pieces are the longest vocabulary entry at its start, then the longest continuation entry
at each later point. Pieces are not built: a trie over the vocabulary carries, per node, a failure
link and the number of pieces that leave when the link is followed, so each character is looked at
once and a word's count is a sum along its path.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import bound_batches, remember, spare_name, strings, text_batches

MEMO_ENTRIES = 1_000_000
MEMO_KEY_CHARS = 48


class LongestMatch:
    """Trie of word-initial and continuation pieces with failure links and popped counts.

    Nodes: 0 is the root for word starts, 1 the root for continuations. ``fail[v]`` is -1 where a
    word that leaves the trie at ``v`` has no segmentation; else ``popped[v]`` pieces are complete
    and the rest of the characters since then lead to node ``fail[v]``.
    """

    def __init__(self, first: list[str], later: list[str]):
        self.edges: list[dict[str, int]] = [{}, {}]
        entry = [False, False]
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                v = root
                for c in piece:
                    nxt = self.edges[v].get(c)
                    if nxt is None:
                        nxt = self.edges[v][c] = len(self.edges)
                        self.edges.append({})
                        entry.append(False)
                    v = nxt
                entry[v] = True
        entry[0] = entry[1] = False
        n = len(self.edges)
        self.fail, self.popped = [-1] * n, [0] * n
        level = [0, 1]
        while level:
            after = []
            for u in level:
                for c, v in self.edges[u].items():
                    after.append(v)
                    if entry[v]:
                        self.fail[v], self.popped[v] = 1, 1
                        continue
                    z, count = self.fail[u], self.popped[u]
                    while z >= 0 and c not in self.edges[z]:
                        count += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.edges[z][c], count
            level = after

    def count(self, word: str) -> int:
        """Number of pieces of ``word``; 0 where it can't be segmented."""
        edges, fail, popped = self.edges, self.fail, self.popped
        u, n = 0, 0
        for c in word:
            while (v := edges[u].get(c)) is None:
                if fail[u] < 0:
                    return 0
                n += popped[u]
                u = fail[u]
            u = v
        while u != 1:
            if fail[u] < 0:
                return 0
            n += popped[u]
            u = fail[u]
        return n


def pieces_of(path: str) -> tuple[list[str], list[str]]:
    """Word-initial and continuation pieces of a sentencepiece model: with and without the word mark.

    Control pieces and byte pieces are left out; so a word with a character outside the vocabulary
    has no segmentation and counts as one unknown piece.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    names = [model.id_to_piece(i) for i in ids]
    mark = "▁"
    first = [p[1:] for p in names if p.startswith(mark) and len(p) > 1 and mark not in p[1:]]
    return first, [p for p in names if mark not in p]


class _Counter(dict):
    """word -> (pieces, 1 if unknown); bounded."""

    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(word)
        code = n << 1 if n else 3  # an unknown word is one piece, and its low bit is set
        if len(word) <= MEMO_KEY_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[word] = code
        return code


@lru_cache(maxsize=4)
def load(path: str) -> _Counter:
    remember("token_counts", load.cache_clear)
    return _Counter(LongestMatch(*pieces_of(path)))


WORD = r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]"


def token_counts(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Count greedy word pieces of each whole text; one narrow stage, no shuffle.

    Words are runs of letters, marks and digits, or single other characters that are no white
    space. Returns the input columns other than ``text``, then n_words, n_tokens, n_unknown (long).
    A word that no piece covers counts as one token and as unknown. Null, empty and blank texts
    count 0. Input columns that clash with the results give way. Repeated rows stay.
    """
    bound_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != text and c not in ("n_words", "n_tokens", "n_unknown")]
    src = docs.select(*[docs[c] for c in keep], docs[text].cast("string").alias(spare_name("text", keep)))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), "n_words long, n_tokens long, n_unknown long"])

    def run(batches):
        words = regex.compile(WORD).findall
        for part in text_batches(batches, owner="token_counts"):
            memo = load(model_path)
            n_words, n_tokens, n_unknown = [], [], []
            for t in strings(part.column(part.num_columns - 1)):
                codes = [memo[w] for w in words(t)]
                unknown = sum([c & 1 for c in codes])
                n_words.append(len(codes))
                n_unknown.append(unknown)
                n_tokens.append((sum(codes) - unknown) >> 1)
            cols = [*part.columns[:-1], *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_unknown))]
            yield pa.RecordBatch.from_arrays(cols, names=[*part.schema.names[:-1], "n_words", "n_tokens", "n_unknown"])

    return src.mapInArrow(run, schema)
