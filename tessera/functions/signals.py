"""Waveforms and features of one clip, with numpy: WAV bytes, resampling, log-mel energies."""

from __future__ import annotations

import math
import struct
from functools import lru_cache

import numpy as np

#: Zero crossings of the resampling filter on each side.
CROSSINGS = 16


def decode_wav(raw: bytes) -> tuple[int, np.ndarray]:
    """(sampling rate, samples of channel 0 in -1..1) of a RIFF file with PCM or float samples.

    Raises ValueError where the file is no such file or is cut short.
    """
    if len(raw) < 12 or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("no RIFF WAVE file")
    at, kind = 12, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        body = at + 8
        if body + size > len(raw):
            raise ValueError(f"chunk {name!r} is cut short")
        if name == b"fmt ":
            if size < 16:
                raise ValueError("format chunk is too small")
            code, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", raw, body)
            if code == 0xFFFE:  # extensible: the true code leads the sub-format
                if size < 26:
                    raise ValueError("format chunk is too small")
                code = struct.unpack_from("<H", raw, body + 24)[0]
            kind = (code, bits)
            if not channels or not rate or block != channels * bits // 8:
                raise ValueError("format chunk contradicts itself")
        elif name == b"data":
            if kind is None:
                raise ValueError("samples before the format chunk")
            data = raw[body : body + size - size % block]
            return rate, _samples(data, *kind, channels)
        at = body + size + size % 2
    raise ValueError("no samples")


def _samples(data: bytes, code: int, bits: int, channels: int) -> np.ndarray:
    if code == 3 and bits in (32, 64):
        return np.frombuffer(data, f"<f{bits // 8}")[::channels].astype(np.float64)
    if code != 1 or bits not in (8, 16, 24, 32):
        raise ValueError(f"sample format {code} with {bits} bits")
    if bits == 8:  # unsigned
        return (np.frombuffer(data, np.uint8)[::channels].astype(np.float64) - 128) / 128
    if bits == 24:
        parts = np.frombuffer(data, np.uint8).reshape(-1, 3)[::channels].astype(np.int32)
        return (((parts[:, 0] << 8) | (parts[:, 1] << 16) | (parts[:, 2] << 24)) >> 8) / float(1 << 23)
    return np.frombuffer(data, f"<i{bits // 8}")[::channels].astype(np.float64) / float(1 << (bits - 1))


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """One channel of 16-bit PCM."""
    data = np.clip(np.rint(np.asarray(samples) * 32768), -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def filter_taps(up: int, down: int) -> np.ndarray:
    """Low-pass filter at the rate ``up`` times the input's: sinc under a Hann window, gain ``up``."""
    half = CROSSINGS * max(up, down)
    t = np.arange(-half, half + 1)
    cut = 1 / max(up, down)
    return up * cut * np.sinc(cut * t) * (0.5 + 0.5 * np.cos(np.pi * t / half))


@lru_cache(maxsize=16)
def _phases(up: int, down: int) -> np.ndarray:
    """Row p: the taps that meet an output whose place at the high rate is p beyond an input sample."""
    taps = filter_taps(up, down)
    half = len(taps) // 2
    reach = half // up + 1
    t = np.arange(up)[:, None] + up * np.arange(-reach, reach + 1)[None, :]
    return np.where(np.abs(t) <= half, taps[np.clip(t + half, 0, 2 * half)], 0.0)


def resample(samples: np.ndarray, rate: int, target: int, block: int = 65_536) -> np.ndarray:
    """Samples at the target rate, ceil(n * target / rate) of them; silence is taken beyond both ends.

    Polyphase: no zeros are put between samples, each output meets its own phase of the filter.
    """
    if rate <= 0 or target <= 0:
        raise ValueError("rates must be positive")
    common = math.gcd(rate, target)
    up, down = target // common, rate // common
    x = np.asarray(samples, np.float64)
    if up == down or not len(x):
        return x.copy()
    phases = _phases(up, down)
    reach = phases.shape[1] // 2
    padded = np.concatenate([np.zeros(reach), x, np.zeros(reach + 1)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1)
    out = np.empty(-(-len(x) * up // down))
    for a in range(0, len(out), block):
        at = np.arange(a, min(a + block, len(out))) * down
        # the filter is symmetric: sample k0 + j lies j * up - phase from the output
        out[a : a + block] = np.einsum("ij,ij->i", windows[at // up][:, ::-1], phases[at % up])
    return out


def mel_filters(rate: int, n_fft: int, bands: int) -> np.ndarray:
    """Triangular filters (bands, n_fft / 2 + 1), evenly spaced on the mel scale from 0 to rate / 2."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.arange(bands + 2) * top / (bands + 1) / 2595) - 1)
    f = np.arange(n_fft // 2 + 1) * rate / n_fft
    rise = (f[None, :] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - f[None, :]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall))


def frame_count(samples: int, hop: int) -> int:
    """One frame a hop; a rest of half a hop or more makes one too."""
    return (samples + hop // 2) // hop


def log_mel(samples: np.ndarray, rate: int = 16_000, n_fft: int = 400, hop: int = 160, bands: int = 80, floor: float = 1e-10) -> np.ndarray:
    """Natural log of mel band energies, (frames, bands); frame i is centred on sample (i + 0.5) hop.

    Silence is taken beyond both ends. Frames are windowed by a periodic Hann window.
    """
    x = np.asarray(samples, np.float64)
    frames = frame_count(len(x), hop)
    if not frames:
        return np.zeros((0, bands))
    first = hop // 2 - n_fft // 2
    before, after = max(0, -first), max(0, first + (frames - 1) * hop + n_fft - len(x))
    padded = np.concatenate([np.zeros(before), x, np.zeros(after)])
    at = first + before + hop * np.arange(frames)
    cut = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[at]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    power = np.abs(np.fft.rfft(cut * window, axis=1)) ** 2
    return np.log(np.maximum(power @ mel_filters(rate, n_fft, bands).T, floor))
