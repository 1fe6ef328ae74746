import cmath
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import signals
from tessera.operators import guards, signals as ops


def riff(code, bits, channels, data, rate=8000, extra=b"", extensible=False):
    block = channels * bits // 8
    fmt = struct.pack("<HHIIHH", 0xFFFE if extensible else code, channels, rate, rate * block, block, bits)
    if extensible:
        fmt += struct.pack("<HHIH", 22, bits, 0, code) + b"\0" * 14
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + extra + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def test_wav_formats():
    x = [0, 1, -1, 100, -128 * 256, 127 * 256]
    pairs = [v for s in x for v in (s, 7)]  # the second channel is left out
    got = {
        "16": riff(1, 16, 2, struct.pack(f"<{len(pairs)}h", *pairs)),
        "32": riff(1, 32, 2, struct.pack(f"<{len(pairs)}i", *(p << 16 for p in pairs)), extra=b"LIST\x03\0\0\0abc\0"),
        "24": riff(1, 24, 2, b"".join((p << 8).to_bytes(3, "little", signed=True) for p in pairs), extensible=True),
        "float": riff(3, 32, 1, struct.pack(f"<{len(x)}f", *(v / 32768 for v in x))),
        "double": riff(3, 64, 1, struct.pack(f"<{len(x)}d", *(v / 32768 for v in x))),
    }
    for name, raw in got.items():
        rate, samples = signals.decode_wav(raw)
        assert rate == 8000 and samples.tolist() == [v / 32768 for v in x], name
    assert signals.decode_wav(riff(1, 8, 1, bytes([0, 128, 255])))[1].tolist() == [-1.0, 0.0, 127 / 128]
    rate, samples = signals.decode_wav(signals.encode_wav(np.array(x) / 32768, 44_100))
    assert rate == 44_100 and (samples * 32768).tolist() == x


@pytest.mark.parametrize("raw", [b"", b"RIFF", riff(1, 16, 1, b"\0\0" * 9)[:50], riff(1, 12, 1, b"\0\0"), riff(7, 8, 1, b"\0"), riff(1, 16, 0, b""), b"RIFF\x04\0\0\0WAVE", b"RIFF\0\0\0\0WAVEdata\0\0\0\0"])
def test_broken_files_raise(raw):
    with pytest.raises(ValueError):
        signals.decode_wav(raw)


@pytest.mark.parametrize(("rate", "target", "n"), [(16_000, 8000, 400), (8000, 16_000, 301), (44_100, 16_000, 500), (3, 7, 1), (6400, 9600, 64), (5, 5, 9), (2, 1, 0)])
def test_resampling_equals_direct_convolution(rate, target, n):
    x = np.random.default_rng(n).normal(size=n)
    g = math.gcd(rate, target)
    up, down = target // g, rate // g
    got = signals.resample(x, rate, target, block=37)
    assert len(got) == -(-n * up // down)
    if up == down or not n:
        assert (got == x).all()
        return
    taps = signals.filter_taps(up, down)
    half = len(taps) // 2
    at = np.arange(len(got))[:, None] * down - np.arange(n)[None, :] * up  # from each input to each output, at the high rate
    want = (np.where(np.abs(at) <= half, taps[np.clip(at + half, 0, 2 * half)], 0.0) * x).sum(axis=1)
    assert np.allclose(got, want, atol=1e-12)


def test_resampling_keeps_a_tone():
    t = np.arange(4000) / 16_000
    got = signals.resample(np.sin(2 * np.pi * 440 * t), 16_000, 11_025)
    want = np.sin(2 * np.pi * 440 * np.arange(len(got)) / 11_025)
    assert np.abs(got - want)[200:-200].max() < 2e-3


def brute_mel(x, rate, n_fft, hop, bands):
    """Sample by sample, by the definition."""
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(rate / 2) * i / (bands + 1) / 2595) - 1) for i in range(bands + 2)]
    out = []
    for i in range((len(x) + hop // 2) // hop):
        first = hop // 2 + i * hop - n_fft // 2
        cut = [(x[first + j] if 0 <= first + j < len(x) else 0.0) * (0.5 - 0.5 * math.cos(2 * math.pi * j / n_fft)) for j in range(n_fft)]
        power = [abs(sum(c * cmath.exp(-2j * math.pi * k * j / n_fft) for j, c in enumerate(cut))) ** 2 for k in range(n_fft // 2 + 1)]
        row = []
        for b in range(bands):
            lo, mid, hi = edges[b : b + 3]
            weights = [max(0, min((k * rate / n_fft - lo) / (mid - lo), (hi - k * rate / n_fft) / (hi - mid))) for k in range(n_fft // 2 + 1)]
            row.append(math.log(max(sum(w * p for w, p in zip(weights, power, strict=True)), 1e-10)))
        out.append(row)
    return out


def test_features_of_the_table_equal_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").limit(12).select("vec_id", F.col("embedding").cast("array<double>").alias("x")).collect()
    df = spark.createDataFrame(rows + [(-1, None), (-2, []), (-3, [0.5])], "vec_id long, x array<double>").withColumn("features", F.lit("gives way"))
    got = {r["vec_id"]: r for r in ops.log_mel(df, "x", 6400, 16, 4, 5, rows=4).collect()}
    assert len(got) == len(rows) + 3
    for r in rows:
        assert got[r["vec_id"]]["feature_len"] == 16
        assert np.allclose(got[r["vec_id"]]["features"], brute_mel(r["x"], 6400, 16, 4, 5), atol=1e-9)
    assert [got[i]["feature_len"] for i in (-1, -2, -3)] == [0, 0, 0] and got[-1]["features"] is None


@pytest.mark.parametrize(("n", "n_fft", "hop", "bands"), [(1000, 400, 160, 8), (50, 64, 20, 3), (7, 4, 6, 2)])
def test_features_of_other_sizes(n, n_fft, hop, bands):
    x = np.random.default_rng(n).normal(size=n)
    assert np.allclose(signals.log_mel(x, 16_000, n_fft, hop, bands), brute_mel(x.tolist(), 16_000, n_fft, hop, bands), atol=1e-9)


def test_files_broken_ones_apart(spark, tmp_path):
    tone = np.sin(np.arange(320) / 5)
    for i in range(6):
        raw = signals.encode_wav(tone / (i + 1), 16_000)
        (tmp_path / f"{i}.wav").write_bytes(raw[: 60 if i == 4 else None])
    (tmp_path / "5.wav").write_bytes(b"text")
    read = ops.read_audio(spark, str(tmp_path), 8000)
    good, bad = guards.split_failed(read, F.col("error").isNotNull())
    assert sorted(r["path"][-5] for r in bad.collect()) == ["4", "5"]
    assert {(len(r["samples"]), r["rate"]) for r in good.collect()} == {(160, 8000)}
    again = ops.resample(good, "samples", "rate", 8000).first()
    assert again["resampled"] == again["samples"]


def test_padding_and_supervision_frames(spark):
    df = spark.createDataFrame([(None, [0.1] * 40), (None, [0.2] * 20), (1, [0.3] * 9), (1, [])], "b long, x array<double>")
    got = ops.pad_batch(ops.log_mel(df, "x", 6400, 16, 4, 3), "b").collect()
    assert sorted((r["feature_len"], len(r["features"])) for r in got) == [(0, 2), (2, 2), (5, 10), (10, 10)]
    assert {len(f) for r in got for f in r["features"]} == {3}
    rng = random.Random(4)
    cases = [(rng.uniform(0, 3), rng.uniform(0, 3), rng.randint(0, 400)) for _ in range(200)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i long, s double, d double, n long")
    for r in rows.withColumn("f", ops.supervision_frames(F.col("s"), F.col("d"), 0.01, F.col("n"))).collect():
        inside = [k for k in range(r["n"]) if r["s"] <= (k + 0.5) * 0.01 < r["s"] + r["d"]]
        assert r["f"]["n"] == len(inside) and (not inside or r["f"]["first"] == inside[0])
