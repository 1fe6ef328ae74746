"""Waveforms and log-mel features of clips over Arrow batches, and frames of supervisions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import signals


def _added(df: DataFrame, names: list[str], kinds: str, make: Callable[[pa.RecordBatch], list[pa.Array]], rows: int) -> DataFrame:
    """``df`` with further columns made of slices of at most ``rows`` rows; columns of these names give way."""
    keep = [c for c in df.columns if c not in names]
    src = df.select(*keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields), kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays([*part.columns, *make(part)], names=[*part.schema.names, *names])

    return src.mapInArrow(run, schema)


def decode(files: DataFrame, content: str = "content", target: int | None = None, rows: int = 64) -> DataFrame:
    """Add rate, samples (channel 0) and error; with ``target`` the samples are resampled to that rate.

    A file that can't be read has null samples and says why in ``error`` (split with
    :func:`tessera.operators.guards.split_failed` on it); null content is such a file.
    """
    at = [c for c in files.columns if c not in ("rate", "samples", "error")].index(content)

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        rates, samples, errors = [], [], []
        for raw in part.column(at).to_pylist():
            try:
                if raw is None:
                    raise ValueError("no content")
                rate, x = signals.decode_wav(raw)
                if target:
                    rate, x = target, signals.resample(x, rate, target)
            except ValueError as e:
                rate, x, e_text = None, None, str(e)
            else:
                e_text = None
            rates.append(rate)
            samples.append(x)
            errors.append(e_text)
        return [pa.array(rates, pa.int32()), pa.array(samples, pa.list_(pa.float64())), pa.array(errors, pa.string())]

    return _added(files, ["rate", "samples", "error"], "rate int, samples array<double>, error string", make, rows)


def read_audio(spark: SparkSession, path: str, target: int | None = None) -> DataFrame:
    """path, rate, samples and error of the WAV files under a path."""
    return decode(spark.read.format("binaryFile").load(path).select("path", "content"), target=target).drop("content")


def resample(df: DataFrame, samples: str, rate: str, target: int, name: str = "resampled", rows: int = 64) -> DataFrame:
    """Add samples at the target rate; null where samples or rate are null or the rate isn't positive."""
    keep = [c for c in df.columns if c != name]
    at, by = keep.index(samples), keep.index(rate)

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        pairs = zip(part.column(at).to_pylist(), part.column(by).to_pylist(), strict=True)
        return [pa.array([None if x is None or not r or r < 0 else signals.resample(np.array(x, float), int(r), target) for x, r in pairs], pa.list_(pa.float64()))]

    return _added(df, [name], f"`{name}` array<double>", make, rows)


def log_mel(df: DataFrame, samples: str, rate: int = 16_000, n_fft: int = 400, hop: int = 160, bands: int = 80, rows: int = 64) -> DataFrame:
    """Add features (frames of band energies) and feature_len (frames); null samples have none and null."""
    keep = [c for c in df.columns if c not in ("features", "feature_len")]
    at = keep.index(samples)

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        found = [None if x is None else signals.log_mel(np.array(x, float), rate, n_fft, hop, bands) for x in part.column(at).to_pylist()]
        return [pa.array([None if f is None else f.tolist() for f in found], pa.list_(pa.list_(pa.float64()))), pa.array([0 if f is None else len(f) for f in found], pa.int64())]

    return _added(df, ["features", "feature_len"], "features array<array<double>>, feature_len long", make, rows)


def pad_batch(df: DataFrame, batch: str, features: str = "features", length: str = "feature_len", fill: float = 0.0) -> DataFrame:
    """Features filled with frames of ``fill`` up to the longest of their batch; true lengths stay."""
    from tessera.operators.ordering import with_totals

    bands = F.coalesce(F.size(F.get(features, F.lit(0))), F.lit(0))
    widest = df.groupBy(batch).agg(F.max(length).alias("_most"), F.max(bands).alias("_bands"))
    frame = F.array_repeat(F.lit(fill).cast("double"), F.col("_bands"))
    more = F.array_repeat(frame, (F.col("_most") - F.col(length)).cast("int"))
    return with_totals(df, widest, [batch]).withColumn(features, F.concat(F.coalesce(F.col(features), F.array().cast("array<array<double>>")), more)).drop("_most", "_bands")


def supervision_frames(start: Column, duration: Column, shift: float, frames: Column) -> Column:
    """(first, n) of the frames whose centre, (i + 0.5) shift, lies in [start, start + duration)."""
    low = F.greatest(F.ceil(start / shift - 0.5), F.lit(0))
    high = F.least(F.ceil((start + duration) / shift - 0.5), frames)
    return F.struct(low.cast("long").alias("first"), F.greatest(high - low, F.lit(0)).cast("long").alias("n"))
