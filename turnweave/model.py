"""Parameters and row schemas. Times are whole microseconds (long), so that sums and comparisons are exact."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

SECOND = 1_000_000


@dataclass(frozen=True)
class SliceConfig:
    """How speech spans become chunks for a recogniser."""

    pad_us: int = 50_000
    merge_gap_us: int = 100_000
    target_us: int = 15 * SECOND
    overshoot_us: int = 2 * SECOND
    limit_us: int = 20 * SECOND
    inner_silence_us: int = 750_000
    pack: bool = True
    sample_rate: int = 16_000

    @property
    def speech_cap_us(self) -> int:
        return self.target_us + self.overshoot_us


@dataclass(frozen=True)
class VadConfig:
    """What the pipeline asks of a voice-activity backend."""

    threshold: float = 0.35
    min_speech_ms: int = 100
    min_silence_ms: int = 200
    speech_pad_ms: int = 100
    max_speech_s: float = 17.0
    max_span_us: int = 20 * SECOND


@dataclass(frozen=True)
class DedupConfig:
    """Overlap removal between neighbouring texts of one recording."""

    tail_chars: int = 80
    min_overlap: int = 16
    max_overlap: int = 200
    ratio: float = 0.9
    min_words_per_s: float = 1.0
    min_chars_per_s: float = 3.0


@dataclass(frozen=True)
class PlanConfig:
    """Windows of a dialog for a language model."""

    target_tokens: int = 17_000
    max_tokens: int = 18_000
    overlap: int = 1
    passes: int = 2


DIALOG_GAP_US = 3 * SECOND
SUFFIXES = ("wav", "flac", "mp3", "m4a", "aac", "ogg", "opus")

SPAN = T.StructType([T.StructField("start_us", T.LongType()), T.StructField("end_us", T.LongType())])
SEGMENT = T.StructType(
    [T.StructField("audio", T.StringType()), T.StructField("seg_no", T.LongType()), *SPAN.fields, T.StructField("text", T.StringType())]
)
WAVE = T.StructType([T.StructField("path", T.StringType()), T.StructField("sample_rate", T.IntegerType()), T.StructField("pcm", T.BinaryType())])
