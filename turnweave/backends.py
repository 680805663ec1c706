"""Plug-ins for what needs models: voice activity, recognition, punctuation. Each has a deterministic stand-in; the stand-ins
are stubs for tests and dry runs, not models.

A backend is made on the worker by a factory, once for each task (or process, by ``once``), and fed one recording, chunk or
text at a time. A stage may be given a resource profile, so that models that need a device run where one is.
"""

from __future__ import annotations

import inspect
import json
import re
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import fix_spaces, in_parts, marked
from .model import VadConfig
from .operators.intervals import split_long
from .session import ship
from .sources.audio import from_pcm


class VoiceActivity(Protocol):
    def spans(self, samples: np.ndarray, rate: int) -> Sequence[tuple[float, float]]: ...


class Recogniser(Protocol):
    def transcribe(self, samples: np.ndarray, rate: int) -> object: ...


class Punctuator(Protocol):
    def label(self, text: str) -> Sequence[dict]: ...


class EnergyVoiceActivity:
    """Stub: 20 ms frames above a level, gaps below ``min_silence_ms`` closed, spans below ``min_speech_ms`` left out."""

    def __init__(self, config: VadConfig = VadConfig(), level: float = 0.02):
        self.config, self.level = config, level

    def spans(self, samples, rate):
        frame = rate // 50
        n = len(samples) // frame
        loud = np.sqrt(np.square(samples[: n * frame].reshape(n, frame)).mean(1)) > self.level if n else np.zeros(0, bool)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], loud.astype(np.int8), [0]])))
        found: list[list[float]] = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if found and (a * 0.02 - found[-1][1]) * 1000 < self.config.min_silence_ms:
                found[-1][1] = b * 0.02
            else:
                found.append([a * 0.02, b * 0.02])
        return [(a, b) for a, b in found if (b - a) * 1000 >= self.config.min_speech_ms]


class EchoRecogniser:
    """Stub: says how many milliseconds it heard."""

    def transcribe(self, samples, rate):
        return {"text": f"{len(samples) * 1000 // rate} ms"}


class RulePunctuator:
    """Stub: first word in upper case, the last with a full stop."""

    def label(self, text):
        tokens = text.split()
        shape = lambda k: ("UPPER_" if k == 0 else "LOWER_") + ("PERIOD" if k == len(tokens) - 1 else "O")
        return [{"word": w, "entity_group": shape(k)} for k, w in enumerate(tokens)]


_held: dict[str, object] = {}


def once(name: str, make: Callable[[], object]) -> Callable[[], object]:
    """A factory that makes the backend of that name once a worker process; later tasks there get the same."""

    def held():
        from turnweave import backends  # the worker's own module, not what was sent along

        if name not in backends._held:
            backends._held[name] = make()
        return backends._held[name]

    return held


def on_device(device: str = "gpu", amount: float = 1.0, cores: int | None = None):
    """A profile for stages whose tasks need ``amount`` of a device each; voice activity may do without one."""
    from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests

    needs = TaskResourceRequests().resource(device, amount)
    return ResourceProfileBuilder().require(needs.cpus(cores) if cores else needs).build


def speech_spans(waves: DataFrame, make: Callable[[], VoiceActivity] = EnergyVoiceActivity, config: VadConfig = VadConfig(), key: str = "path", profile=None) -> DataFrame:
    """``key, total_us, start_us, end_us`` of the voice in each recording, spans above the limit split."""
    ship(waves.sparkSession)

    def run(batches):
        backend = make()
        for batch in batches:
            for row in batch.to_pylist():
                spans = [(round(a * 1e6), round(b * 1e6)) for a, b in backend.spans(np.nan_to_num(from_pcm(row["pcm"])), row["sample_rate"])]
                yield pa.RecordBatch.from_pydict({key: pa.array([row[key]] * len(spans), pa.string()), "total_us": pa.array([row["total_us"]] * len(spans), pa.int64()), "start_us": pa.array([s for s, _ in spans], pa.int64()), "end_us": pa.array([e for _, e in spans], pa.int64())})

    found = waves.select(key, "sample_rate", "pcm", "total_us").mapInArrow(run, f"{key} string, total_us long, start_us long, end_us long", profile=profile)
    return split_long(found, config.max_span_us)


def _transcribe(backend, samples, rate, language):
    """The language is passed under the name that the backend takes it by, if it takes it."""
    try:
        known = inspect.signature(backend.transcribe).parameters
    except (TypeError, ValueError):
        known = {}
    name = next((n for n in ("language", "lang") if n in known), None) if language else None
    return backend.transcribe(samples, rate, **({name: language} if name else {}))


def recognise(chunks: DataFrame, make: Callable[[], Recogniser] = EchoRecogniser, rate: int = 16_000, language: str | None = None, profile=None) -> DataFrame:
    """``chunks`` with ``answer``: what the recogniser says of ``pcm``, strings as they are and all else as JSON
    (``functions.text.recognised`` reads either)."""
    ship(chunks.sparkSession)
    kept = [c for c in chunks.columns if c != "pcm"]
    source = chunks.select(*kept, "pcm")
    schema = source.select(*kept, F.lit("").alias("answer")).schema

    def run(batches):
        backend = make()
        for batch in batches:
            said = [_transcribe(backend, np.clip(from_pcm(p.as_py() or b""), -1, 1), rate, language) for p in batch.column(batch.num_columns - 1)]
            said = [s if isinstance(s, str) else json.dumps(s, ensure_ascii=False) if isinstance(s, dict | list) else str(s) for s in said]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(said, pa.string())], names=[*kept, "answer"])

    return source.mapInArrow(run, schema, profile=profile)


def punctuate(texts: DataFrame, make: Callable[[], Punctuator] = RulePunctuator, text: str = "text", out: str = "text_punct", profile=None) -> DataFrame:
    """``texts`` with punctuation and case restored in ``out``: the backend's labels come from Python, the text is put
    together by expressions. A text that it fails on is halved at a blank until it works; if a part can't be halved the
    whole stays as it was. Blank texts stay."""
    ship(texts.sparkSession)
    kept = texts.columns
    source = texts.select(*kept, F.col(text).alias("__text"))
    item = "array<array<struct<word:string,entity_group:string>>>"
    schema = source.select(*kept, F.lit(None).cast(item).alias("__labels")).schema

    def labels(backend, said: str):
        try:
            return [[(p.get("word"), p.get("entity_group")) for p in backend.label(said)]]
        except Exception:  # whatever the model fails on, a shorter text may do
            cut = half(said)
            left, right = said[:cut].rstrip(), said[cut:].lstrip()
            if cut < 0 or not left or not right:
                return None
            parts = labels(backend, left), labels(backend, right)
            return None if None in parts else parts[0] + parts[1]

    def column(backend, said: pa.Array) -> pa.Array:
        words, groups, ends, tops = [], [], [0], []  # flat: an object for each label would take many times the text
        for t in said:
            t = (t.as_py() or "").strip()
            found = labels(backend, t) if t else None
            tops.append(None if found is None else len(ends) - 1)
            for pairs in found or ():
                words.extend(w for w, _ in pairs)
                groups.extend(g for _, g in pairs)
                ends.append(len(words))
        pairs = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(groups, pa.string())], ["word", "entity_group"])
        return pa.ListArray.from_arrays(pa.array([*tops, len(ends) - 1], pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs))

    def run(batches):
        backend = make()
        for batch in batches:
            for start, n in in_parts(batch.column(batch.num_columns - 1)):
                part = batch.slice(start, n)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], column(backend, part.column(part.num_columns - 1))], names=[*kept, "__labels"])

    token = lambda p: marked(F.trim(F.coalesce(p["word"], F.lit(""))), F.coalesce(F.nullif(p["entity_group"], F.lit("")), F.lit("LOWER_O")))
    parts: Column = F.transform("__labels", lambda run: fix_spaces(F.array_join(F.transform(run, token), " ")))
    whole = fix_spaces(F.array_join(parts, " "))
    return source.mapInArrow(run, schema, profile=profile).withColumn(out, F.when(F.col("__labels").isNull(), F.col(text)).otherwise(whole)).select(*[c for c in kept if c != out], out)


def half(text: str) -> int:
    """As ``functions.text.split_index``, for one string."""
    middle = len(text) // 2
    before = [m.start() for m in re.finditer(r"\s", text[:middle])]
    behind = re.search(r"\s", text[middle:])
    return -1 if len(text) < 2 else before[-1] if before else middle + behind.start() if behind else -1
