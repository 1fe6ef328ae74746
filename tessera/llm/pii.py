"""Personal data spans by weak supervision.

Fixed patterns give the base spans, which always count. Looser patterns propose further
candidates. Labelers (pattern, gazetteer, context, shape, validity, exclusion) vote on every
candidate: for, against or not at all. Expectation-maximisation over the counts of vote patterns,
which Spark sums over the whole table, estimates how far each labeler can be trusted; a logistic
classifier trained on the resulting posteriors then decides on the candidates that are not base.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, spare_name, strings, text_batches

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4  # the first four kinds have base patterns
LABELERS = ("pattern", "gazetteer", "context", "shape", "validity", "exclusion")
THRESHOLD = 0.5

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_RUN = re.compile(r"(?<![A-Za-z0-9._%+-])" + _EMAIL.pattern)
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_LOOSE_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:@| ?[(\[]at[)\]] ?| at )[A-Za-z0-9-]{1,63}(?:(?:\.| ?[(\[]dot[)\]] ?| dot )[A-Za-z0-9-]{1,63})+")
_LOOSE_IP = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_LOOSE_CARD = re.compile(r"(?<![0-9A-Za-z-])[0-9]{4}(?:[ -]?[0-9]{4}){2,3}[ -]?[0-9]{1,4}(?![0-9A-Za-z-])")
_LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:00[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z-])")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])[0-9][0-9.:-]*[0-9]|(?<![0-9A-Za-z])[0-9]")
_DATE = re.compile(r"(?:1[5-9]|20)[0-9]{2}([./-])[01]?[0-9]\1[0-3]?[0-9]|[0-3]?[0-9]([./-])[0-3]?[0-9]\2(?:1[5-9]|20)[0-9]{2}")
_KEY = re.compile(r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")
_SECRET = re.compile(r"(?<![A-Za-z])(?:password|passwd|pwd|token|secret|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9+/_=-]{8,})", re.I)
_SECRET_WORD = re.compile(r"passw|pwd|token|secret|api[_-]?key", re.I)

#: Top-level domains seen most, words near a kind, and words that speak against it.
DOMAINS = frozenset("com org net edu gov mil int info biz name io co us uk de fr es it nl be ch at eu ca au jp cn in br mx ru pl se no dk fi pt gr cz ie nz za kr".split())
CUES = {
    "email": ("mail", "contact", "write to", "reach"),
    "ip": ("ip", "address", "host", "server", "from"),
    "card": ("card", "visa", "credit", "payment", "iban", "account"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "contact", "dial"),
    "secret": ("password", "passwd", "pwd", "token", "secret", "key", "akia"),
}
AGAINST = ("version", "license", "section", "isbn", "figure", "table", "chapter", "page")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start: leftmost non-overlapping matches a kind,
    those that fail the kind's test dropped."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        at = 0
        # a match that starts inside a run of local characters could also start at the run's
        # beginning, so only those places (and the end of the last match) are tried
        while (m := _EMAIL.match(text, at) or _EMAIL_RUN.search(text, at)) is not None:
            out.append((0, m.start(), m.end()))
            at = m.end()
    if _DIGIT.search(text):
        if "." in text:
            out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _octets(m[0])]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def loose_spans(text: str, digit: bool) -> list[tuple[int, int, int]]:
    """Further candidates, of any kind; they may overlap base spans."""
    out: list[tuple[int, int, int]] = []
    if "@" in text or " dot " in text or "[at]" in text or "(at)" in text:
        out += [(0, m.start(), m.end()) for m in _LOOSE_EMAIL.finditer(text)]
    if digit:
        if ":" in text:
            out += [(1, m.start(), m.end()) for m in _LOOSE_IP.finditer(text)]
        out += [(2, m.start(), m.end()) for m in _LOOSE_CARD.finditer(text)]
        out += [(3, m.start(), m.end()) for m in _LOOSE_PHONE.finditer(text)]
        if "AKIA" in text:
            out += [(4, m.start(), m.end()) for m in _KEY.finditer(text)]
        # anything else with digits is a candidate too, mostly a false one: the votes need both
        for m in _NUMBER.finditer(text):
            d = sum(c.isdigit() for c in m[0])
            out.append((2 if d >= 12 else 3 if d >= 7 else 1, m.start(), m.end()))
    if ("=" in text or ":" in text) and _SECRET_WORD.search(text):
        out += [(4, m.start(1), m.end(1)) for m in _SECRET.finditer(text)]
    return out


def votes(text: str, kind: int, start: int, end: int, base: bool) -> tuple[int, ...]:
    """One vote a labeler: 1 for, -1 against, 0 none."""
    name, span = KINDS[kind], text[start:end]
    left = text[max(0, start - 24) : start].lower()
    digits = _digits(span)
    strict = base or (kind == 4 and (span.startswith("AKIA") or len(span) >= 12))
    bare = _NUMBER.fullmatch(span) and not (kind == 3 and _LOOSE_PHONE.fullmatch(span))
    pattern = 1 if strict else -1 if bare else 0
    if kind == 0:
        gazetteer = 1 if re.split(r"[^A-Za-z0-9]+", span)[-1].lower() in DOMAINS else -1
    elif kind == 2:
        gazetteer = 1 if digits[:1] in ("3", "4", "5", "6") else -1
    elif kind == 4:
        gazetteer = 1 if any(c in left + span[:4].lower() for c in CUES[name]) else 0
    else:
        gazetteer = 0
    context = 1 if any(c in left for c in CUES[name]) else 0
    before, after = text[start - 1 : start], text[end : end + 1]
    shape = -1 if before.isalnum() or after.isalnum() else 1
    if kind == 0:
        validity = 1 if "@" in span or "at)" in span or "at]" in span else -1
    elif kind == 1:
        validity = 1 if base or (span.count(":") == 7 or "::" in span) and len(digits) > 1 else -1
    elif kind == 2:
        validity = 1 if luhn(digits) else -1
    elif kind == 3:
        validity = 1 if 8 <= len(digits) <= 15 and len(digits) < len(span) and not _DATE.fullmatch(span) else -1
    else:
        mixed = any(c.isdigit() for c in span) and any(c.isalpha() for c in span)
        validity = 1 if mixed else -1
    exclusion = -1 if any(w in left for w in AGAINST) or not base and _DATE.fullmatch(span) else 0
    return pattern, gazetteer, context, shape, validity, exclusion


@dataclass
class SpanModel:
    """``rates[labeler, class]``: chance that a vote is right on false and on true spans; a prior a kind, and the classifier's weights."""

    rates: np.ndarray
    priors: np.ndarray
    weights: np.ndarray

    def probability(self, kind: int, vote: tuple[int, ...]) -> float:
        z = float(_row(kind, vote) @ self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _row(kind: int, vote: tuple[int, ...]) -> np.ndarray:
    x = np.zeros(1 + len(KINDS) + 2 * len(LABELERS))
    x[0] = x[1 + kind] = 1
    for i, v in enumerate(vote):
        if v:
            x[1 + len(KINDS) + 2 * i + (v < 0)] = 1
    return x


def fit_counts(counts: dict[tuple[int, tuple[int, ...]], int], rounds: int = 200) -> SpanModel:
    """EM over counts of (kind, votes), started from the majority; then the classifier.

    A labeler that votes is right with one chance on true spans and another on false ones, alike
    for all kinds; not voting says nothing. A kind has its own share of true spans. The prior on
    the chances (four right votes to one, worth a twentieth of all votes) ties the two classes to
    the votes' meaning.
    """
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    kinds = np.array([k[0] for k in keys], int)
    v = np.array([k[1] for k in keys], int).reshape(-1, len(LABELERS))
    q = 1 / (1 + np.exp(-1.5 * v.sum(axis=1))) if keys else np.zeros(0)
    rates = np.full((len(LABELERS), 2), 0.8)
    priors = np.full(len(KINDS), 0.5)
    held = 2 + n.sum() / 20
    for _ in range(rounds if keys else 0):
        for i in range(len(LABELERS)):
            for c, share in ((0, 1 - q), (1, q)):
                cast = n * share * (v[:, i] != 0)
                right = cast[v[:, i] == (1 if c else -1)].sum()
                rates[i, c] = (right + 0.8 * held) / (cast.sum() + held)
        yes = np.bincount(kinds, weights=n * q, minlength=len(KINDS))
        priors = (yes + 1) / (np.bincount(kinds, weights=n, minlength=len(KINDS)) + 2)
        log = np.log(priors[kinds]) - np.log(1 - priors[kinds])
        for i in range(len(LABELERS)):
            for_it = np.log(rates[i, 1]) - np.log(1 - rates[i, 0])
            against = np.log(1 - rates[i, 1]) - np.log(rates[i, 0])
            log = log + np.where(v[:, i] > 0, for_it, np.where(v[:, i] < 0, against, 0.0))
        new = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        if np.abs(new - q).max() < 1e-9:
            q = new
            break
        q = new
    x = np.array([_row(k, vote) for k, vote in keys])
    w = np.zeros(1 + len(KINDS) + 2 * len(LABELERS))
    scale = np.sqrt(n) if keys else n  # frequent patterns count more, yet don't drown rare ones
    for _ in range(50 if keys else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (scale * (p - q)) + 0.1 * w
        hess = (x * (scale * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return SpanModel(rates, priors, w)


def _union(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, in order and apart from each other."""
    starts: list[int] = []
    ends: list[int] = []
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and loose ones that overlap no base span."""
    base = base_spans(text)
    loose = loose_spans(text, _DIGIT.search(text) is not None)
    if loose and base:
        starts, ends = _union(base)
        # the last stretch that begins before the span's end is the only one that may reach into it
        loose = [s for s in loose if (i := bisect_left(starts, s[2])) == 0 or ends[i - 1] <= s[1]]
    out, end = [], -1
    for s in sorted(set(loose), key=lambda s: (s[1], -s[2], s[0])):
        if s[1] >= end:  # of overlapping candidates the first, then the longest
            out.append(s)
            end = s[2]
    return base, out


def fit(docs: DataFrame, text: str = "text") -> SpanModel:
    """Count vote patterns over every whole text and fit; at most kinds x 3^labelers counts move."""

    bound_batches(docs.sparkSession)
    def run(batches):
        seen: Counter = Counter()
        for part in text_batches(batches):
            for t in strings(part.column(0)):
                base, loose = _candidates(t)
                for spans, is_base in ((base, True), (loose, False)):
                    for k, s, e in spans:
                        seen[k, votes(t, k, s, e, is_base)] += 1
        keys = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([list(v) for _, v in keys], pa.list_(pa.int32())), pa.array([seen[k] for k in keys], pa.int64())], names=["kind", "votes", "n"])

    rows = docs.select(docs[text].cast("string").alias("text")).mapInArrow(run, "kind int, votes array<int>, n long")
    got = rows.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()
    return fit_counts({(r["kind"], tuple(r["votes"])): r["n"] for r in got})


def find(text: str, model: SpanModel, memo: dict | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: base ones plus accepted candidates that overlap none before them."""
    base, loose = _candidates(text)
    memo = {} if memo is None else memo
    end, more = -1, []
    for k, s, e in loose:
        vote = votes(text, k, s, e, False)
        p = memo.get((k, vote))
        if p is None:
            p = memo[k, vote] = model.probability(k, vote)
        if p >= THRESHOLD and s >= end:
            more.append((k, s, e))
            end = e
    return base, sorted(base + more) if more else base


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def spans(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """Counts and spans of personal data in every whole text; one narrow stage.

    Returns the input columns other than ``text``, then n_email, n_ip, n_card, n_phone (base spans,
    long), base_sha256 (hex of ``kind:start:end`` joined by commas, by kind then start; offsets in
    code points, end exclusive), spans (all spans, joined likewise) and n_added. Null text counts as
    empty. Clashing input columns give way; repeated rows stay; an empty table gives an empty one.
    """
    bound_batches(docs.sparkSession)
    made = {"n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"}
    keep = [c for c in docs.columns if c != text and c not in made]
    src = docs.select(*[docs[c] for c in keep], docs[text].cast("string").alias(spare_name("text", keep)))
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"])

    def run(batches):
        memo: dict = {}
        for part in text_batches(batches):
            counts = [[] for _ in range(BASE)]
            hashed, listed, added = [], [], []
            for t in strings(part.column(part.num_columns - 1)):
                base, every = find(t, model, memo)
                for k in range(BASE):
                    counts[k].append(sum(1 for s in base if s[0] == k))
                hashed.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                listed.append(_joined(every))
                added.append(len(every) - len(base))
            made = [*(pa.array(c, pa.int64()) for c in counts), pa.array(hashed, pa.string()), pa.array(listed, pa.string()), pa.array(added, pa.int64())]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*part.schema.names[:-1], *names])

    return src.mapInArrow(run, schema)


def masked(text: str, model: SpanModel, memo: dict | None = None) -> str:
    """The text with every span replaced by ``<KIND>``; of overlapping spans the union is one."""
    _, every = find(text, model, memo)
    if not every:
        return text
    out, at = [], 0
    for k, s, e in sorted(every, key=lambda x: (x[1], -x[2], x[0])):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """``docs`` with the spans in ``text`` masked; other columns and rows as they are (null stays)."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches):
        memo: dict = {}
        for part in text_batches(batches):
            new = [None if t is None else masked(t, model, memo) for t in part.column(at).to_pylist()]
            cols = list(part.columns)
            cols[at] = pa.array(new, part.schema.types[at])
            yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

    return docs.mapInArrow(run, docs.schema)
