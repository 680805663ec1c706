"""Whole jobs: recordings to segments, turns and punctuated texts, put together from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..backends import EchoRecogniser, EnergyVoiceActivity, Punctuator, Recogniser, RulePunctuator, VoiceActivity, punctuate, recognise, speech_spans
from ..functions.text import recognised, strip
from ..model import DedupConfig, SliceConfig, VadConfig
from ..operators.dialog import merge_turns
from ..operators.intervals import number_segments, slice_speech
from ..operators.overlap import drop_overlaps
from ..sources.audio import cut


def transcribe(
    waves: DataFrame,
    recogniser: Callable[[], Recogniser] = EchoRecogniser,
    voice: Callable[[], VoiceActivity] = EnergyVoiceActivity,
    slicing: SliceConfig = SliceConfig(),
    vad: VadConfig = VadConfig(),
    dedup: DedupConfig = DedupConfig(),
    language: str | None = None,
    profile=None,
) -> DataFrame:
    """Segments of recordings (``sources.audio.waveforms``): ``path, seg_no, start_us, end_us, text, accepted``.

    Speech is found, sliced and recognised chunk by chunk, and what neighbouring chunks share is taken out of the later one. Without
    speech a recording has no segments. ``profile``: a resource profile for the recogniser's tasks.
    """
    chunks = slice_speech(speech_spans(waves, voice, vad), ["path"], slicing, "total_us")
    numbered = number_segments(chunks, ["path"], slicing.sample_rate, keep=("start_sample", "end_sample")).drop("text")
    said = recognise(cut(waves, numbered, "path"), recogniser, slicing.sample_rate, language, profile)
    return drop_overlaps(said.withColumn("text", strip(F.coalesce(recognised(F.col("answer")), F.lit("")))), ["path"], dedup)


def full_texts(segments: DataFrame, key: str = "path") -> DataFrame:
    """Each recording's texts in order, those that are not empty."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "text"))), lambda s: s["text"])
    return segments.groupBy(key).agg(F.array_join(F.filter(texts, lambda t: t != ""), " ").alias("text"))


def process(files: DataFrame, waves: DataFrame, **options) -> DataFrame:
    """Segments with the recording's ``dir`` and, as ``audio``, its file name, ready for ``operators.dialog.merge_turns``; recordings
    are numbered by name within their folder. A recording without segments has a row without times and text."""
    from pyspark.sql import Window

    named = files.select("path", "dir", F.col("file_name").alias("audio"), F.row_number().over(Window.partitionBy("dir").orderBy("file_name", "path")).cast("long").alias("file_no"))
    return named.join(transcribe(waves, **options), "path", "left").select("dir", "audio", "file_no", "seg_no", "start_us", "end_us", F.coalesce("text", F.lit("")).alias("text"))


def punctuated_turns(segments: DataFrame, make: Callable[[], Punctuator] = RulePunctuator, profile=None, **options) -> DataFrame:
    """Turns whose texts the backend has punctuated; where it gives nothing the text stays as it was."""
    turns = merge_turns(segments, **options)
    done = punctuate(turns, make, out="__done", profile=profile)
    return done.withColumn("text", F.coalesce(F.nullif("__done", F.lit("")), F.col("text"))).select(*turns.columns)
