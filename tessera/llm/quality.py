"""Text quality from compressed sizes.

Two zstandard dictionaries are built, one from texts labelled good and one from texts labelled bad.
A text is compressed with each; the difference of the sizes over their sum says which dictionary
knows it better. A logistic calibrator, fitted on labelled texts that neither dictionary has seen,
turns that difference and the compressed size per byte into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, strings, text_batches

#: Labelled rows a class that are looked at, in hash order, and their bytes: the fit's bound.
SAMPLE_ROWS = 3_000
SAMPLE_BYTES = 12_000_000
DICTIONARY_BYTES = 32_768
PIECE_BYTES = 2_000
LEVEL = 3


def held_out(doc_id: Column) -> Column:
    """True for the third of ids that no fit may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def build_dictionary(texts: list[bytes]) -> bytes:
    """Dictionary from samples cut in pieces; with too few samples, their last bytes as they are."""
    pieces = [t[i : i + PIECE_BYTES] for t in texts for i in range(0, len(t), PIECE_BYTES)]
    if len(pieces) >= 100 and sum(map(len, pieces)) >= 10 * DICTIONARY_BYTES:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    return b"".join(pieces)[-DICTIONARY_BYTES:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL, **plain)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), **plain)


def features(texts: list[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """Per text: intercept, difference of sizes over their sum, log size per byte, their terms."""
    g, b = _compressor(good), _compressor(bad)
    sizes = np.array([(len(g.compress(t)), len(b.compress(t)), len(t)) for t in texts], float).reshape(-1, 3)
    diff = 10 * (sizes[:, 1] - sizes[:, 0]) / (sizes[:, 0] + sizes[:, 1])
    ratio = np.log(np.minimum(sizes[:, 0], sizes[:, 1]) / np.maximum(sizes[:, 2], 1))
    ratio = np.where(sizes[:, 2] == 0, 0.0, np.clip(ratio, -6, 2))
    low = np.maximum(-1.5 - ratio, 0)  # far below what prose needs: repetition
    short = 1 / np.sqrt(1 + sizes[:, 2] / 50)
    return np.column_stack([np.ones(len(sizes)), diff, low, short, diff * short, np.maximum(diff, 0)])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Newton's method with row weights and a small ridge; the intercept is free of it."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * w
        hess = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: np.ndarray

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1, 0 to 1."""
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(features(texts, self.good, self.bad) @ self.weights, -30, 30)))


def fit_texts(texts: list[bytes], labels: list[int], counts: dict[int, int] | None = None) -> QualityModel:
    """Even places build the dictionaries, odd ones calibrate (all, where a class is too small).

    ``counts``: labelled rows a class outside the sample too; the calibrator weights the sample's
    classes to those shares. Without rows of both classes the score is a constant: the share of label 1, or 0.5.
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        w = np.zeros(6)
        w[0] = np.log((share + 0.01) / (1.01 - share))
        return QualityModel(b"", b"", w)
    rank = np.zeros(len(y), int)
    for c in (0, 1):
        at = np.flatnonzero(y == c)
        rank[at] = np.arange(len(at))
    few = min(int((y == 0).sum()), int((y == 1).sum())) < 20
    build = rank % 2 == 0
    good = build_dictionary([t for t, c, u in zip(texts, y, build, strict=True) if c == 1 and u])
    bad = build_dictionary([t for t, c, u in zip(texts, y, build, strict=True) if c == 0 and u])
    fit = ~build if not few else np.ones(len(y), bool)
    own = [t for t, u in zip(texts, fit, strict=True) if u]
    weight = np.ones(int(fit.sum()))
    for c in (0, 1):
        at = y[fit] == c
        if counts and at.any():
            weight[at] = counts.get(c, 0) / sum(counts.values()) * len(weight) / at.sum()
    return QualityModel(good, bad, fit_logistic(features(own, good, bad), y[fit], weight, ridge=0.05 if not few else 1.0))


def _within(rows: list, size: int) -> list[tuple[int, int]]:
    """Of (id, class, bytes) in order, those that fit into ``size`` bytes a class; a text that doesn't
    fit is passed over. If none of a class does, its smallest stands alone."""
    taken, left = [], {}
    for i, y, n in rows:
        if n <= left.setdefault(y, size):
            left[y] -= n
            taken.append((i, y))
    for y in left.keys() - {y for _, y in taken}:
        taken.append(min((n, i, y) for i, c, n in rows if c == y)[1:])
    return taken


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> QualityModel:
    """Fit on at most ``rows`` labelled rows and ``size`` bytes of text a class, taken in hash order.

    Only rows outside the held-out third are used. Two bounded lists reach the driver: ids, and the
    texts of those that fit into ``size`` bytes; a text that doesn't fit is passed over. Rows with null label, id or text are passed over;
    of repeated labels the smallest counts.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).cast("long").alias("_id")).agg(F.min(label).cast("int").alias("_y"))
    counts = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    wanted = None
    for y in (0, 1):
        some = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(rows)
        wanted = some if wanted is None else wanted.unionByName(some)
    texts = docs.select(docs[doc_id].cast("long").alias("_id"), docs[text].cast("string").alias("_t")).where("_t IS NOT NULL")
    found = texts.join(F.broadcast(wanted), "_id")  # at most 2 * rows ids
    sizes = found.select("_id", "_y", F.octet_length("_t").alias("_n")).groupBy("_id", "_y").agg(F.max("_n").alias("_n"))
    ids = docs.sparkSession.createDataFrame(_within(sizes.orderBy(F.xxhash64("_id"), "_id").collect(), size), "_id long, _y int")
    picked = texts.join(F.broadcast(ids), "_id").groupBy("_id", "_y").agg(F.max("_t").alias("_t"))
    got = picked.orderBy("_y", F.xxhash64("_id"), "_id").collect()
    return fit_texts([r["_t"].encode("utf-8") for r in got], [r["_y"] for r in got], counts)


def score(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= 0.5) to each row.

    One narrow stage; inputs of a score are the bytes of the text alone. Null text counts as empty,
    and an empty text has the score that its features give. Columns of those names in the input
    give way; repeated rows stay; an empty table gives an empty one.
    """
    bound_batches(docs.sparkSession)
    made = ("held_out", "score", "predicted")
    keep = [c for c in docs.columns if c not in made]
    src = docs.select(*keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields), "score double"])
    at = keep.index(text)

    def run(batches):
        for part in text_batches(batches):
            s = model.score([t.encode("utf-8", "surrogatepass") for t in strings(part.column(at))])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], names=[*part.schema.names, "score"])

    out = src.mapInArrow(run, schema)
    return out.withColumns({"held_out": held_out(F.col(doc_id)), "predicted": (F.col("score") >= 0.5).cast("int")})
