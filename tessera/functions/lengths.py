"""Token lengths of audio: encoder output lengths and estimates from durations.

Python floors its integer divisions; halving is a right shift here, as ``div`` truncates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _half_up(c: Column) -> Column:
    """floor((c - 1) / 2) + 1."""
    return F.shiftright(c - 1, 1) + 1


def whisper(mel: Column) -> Column:
    return _half_up(mel)


def audio_v25(mel: Column) -> Column:
    """Two stages; the second is floor((a - 2) / 2) + 1."""
    return F.shiftright(_half_up(mel) - 2, 1) + 1


def audio_v3(mel: Column) -> Column:
    """Thirteen a full hundred frames, and the rest halved three times."""
    return _half_up(_half_up(_half_up(mel % 100))) + F.floor(mel / 100).cast("long") * 13


#: Encoder names; two share a rule.
ENCODERS = {
    "whisper": whisper,
    "qwen2_5_omni_audio_encoder": audio_v25,
    "qwen3_omni_moe_audio_encoder": audio_v3,
    "qwen3_asr_audio_encoder": audio_v3,
}


def audio_tokens(mel: Column, encoder: str, downsample: int = 4) -> Column:
    """Tokens after the encoder and a projector that joins ``downsample`` frames."""
    if encoder not in ENCODERS:
        raise ValueError(f"unknown encoder {encoder!r}; known: {sorted(ENCODERS)}")
    if downsample <= 0:
        raise ValueError("the downsample rate must be positive")
    return F.floor(ENCODERS[encoder](mel) / downsample).cast("long")


def audio_tokens_by_name(mel: Column, encoder: Column, downsample: Column) -> Column:
    """The same with encoder and rate from columns; unknown names and rates below 1 raise."""
    out = F.raise_error(F.concat(F.lit("unknown encoder "), encoder)).cast("long")
    for name, rule in ENCODERS.items():
        out = F.when(encoder == name, rule(mel).cast("long")).otherwise(out)
    rate = F.when(downsample > 0, downsample).otherwise(F.raise_error(F.lit("the downsample rate must be positive")).cast("long"))
    return F.floor(out / rate).cast("long")


def estimated_audio_tokens(duration: Column, rate: float = 12.5) -> Column:
    """Duration times rate, rounded half to even."""
    return F.rint(duration * rate).cast("long")
