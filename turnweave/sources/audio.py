"""Recordings: the catalogue, decoding and resampling, a kept table of what is decoded, chunk cutting. PCM wave files are read
here; other codecs by a program that takes bytes in and gives samples out (``piped``)."""

from __future__ import annotations

import io
import subprocess
import wave
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SUFFIXES
from ..session import ship


def catalogue(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """Recordings below ``root``: path, dir, file_name, stem, suffix, length, modificationTime, and their bytes. The suffix filter reaches the
    file listing; without ``content`` no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(_any_case(s) for s in SUFFIXES) + "}").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path",
        F.regexp_replace("path", "/[^/]*$", "").alias("dir"),
        name.alias("file_name"),
        F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("stem"),
        F.lower(F.concat(F.lit("."), F.element_at(F.split(name, r"\."), -1))).alias("suffix"),
        "length",
        "modificationTime",
        *(["content"] if content else []),
    )


def _any_case(suffix: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix)


def low_pass(samples: np.ndarray, cutoff: float, lobes: int = 16) -> np.ndarray:
    """What lies below ``cutoff`` (as a share of the highest frequency), by a windowed sinc; the length stays."""
    half = int(np.ceil(lobes / cutoff))
    at = np.arange(-half, half + 1)
    taps = cutoff * np.sinc(cutoff * at) * np.kaiser(len(at), 8.0)
    return np.convolve(np.pad(samples, half, mode="edge"), taps / taps.sum(), "valid").astype(np.float32)


def resample(samples: np.ndarray, rate: int, target: int) -> np.ndarray:
    """``target`` samples a second, one at least: frequencies that these can't carry are taken out, then values between
    samples are interpolated."""
    if rate == target or not len(samples):
        return samples.astype(np.float32)
    if target < rate:
        samples = low_pass(samples, target / rate)
    n = max(1, round(len(samples) * target / rate))
    at = np.linspace(0, len(samples) - 1, n)
    return np.interp(at, np.arange(len(samples)), samples).astype(np.float32)


class Undecodable(ValueError):
    """A file that a decoder can't read."""


Decoder = Callable[[bytes, int], np.ndarray]


def decode_wave(content: bytes, target: int = 16_000) -> np.ndarray:
    """Mono float32 samples of a PCM wave file."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    except (wave.Error, EOFError) as e:
        raise Undecodable(f"no PCM wave file: {e}") from e
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw[: len(raw) // width * width], f"<i{width}").astype(np.float32) / float(1 << (8 * width - 1))
    x = x[: len(x) // channels * channels].reshape(-1, channels).mean(1)
    return np.nan_to_num(resample(x, rate, target), nan=0.0, posinf=0.0, neginf=0.0)


#: A command line that reads any codec from its input and writes 16-bit mono samples; ``{rate}`` is filled in.
FFMPEG = ("ffmpeg", "-v", "error", "-i", "pipe:0", "-f", "s16le", "-ac", "1", "-ar", "{rate}", "pipe:1")


def piped(command: Sequence[str] = FFMPEG, timeout: float = 600.0) -> Decoder:
    """A decoder that sends what is no PCM wave file through a program, which must be on the executors."""

    def decode(content: bytes, rate: int) -> np.ndarray:
        try:
            return decode_wave(content, rate)
        except Undecodable:
            pass
        try:
            done = subprocess.run([c.format(rate=rate) for c in command], input=content, capture_output=True, timeout=timeout, check=False)
        except (OSError, subprocess.TimeoutExpired) as e:
            raise Undecodable(f"{command[0]}: {e}") from e
        if done.returncode or not done.stdout:
            raise Undecodable(f"{command[0]}: {done.stderr.decode(errors='replace').strip()[:200] or 'no samples'}")
        return from_pcm(done.stdout[: len(done.stdout) // 2 * 2])

    return decode


def to_pcm(samples: np.ndarray) -> bytes:
    return (np.clip(samples, -1.0, 1.0) * 32767).round().astype("<i2").tobytes()


def from_pcm(pcm: bytes) -> np.ndarray:
    return np.frombuffer(pcm, "<i2").astype(np.float32) / 32767


def waveforms(files: DataFrame, rate: int = 16_000, decode: Decoder = decode_wave) -> DataFrame:
    """``path, sample_rate, pcm`` (16-bit mono), ``total_us`` and ``status`` (ok, or why there are no samples) of the files'
    ``content``. Keyed by full path, so files of one stem don't meet."""
    ship(files.sparkSession)

    def read(batches):
        for batch in batches:
            for path, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):  # one recording in memory
                try:
                    x, status = decode(content or b"", rate), "ok"
                except Undecodable as e:
                    x, status = np.zeros(0, np.float32), str(e)
                yield pa.RecordBatch.from_pydict({"path": [path], "sample_rate": pa.array([rate], pa.int32()), "pcm": [to_pcm(x)], "total_us": [len(x) * 1_000_000 // rate], "status": [status]})

    return files.select("path", "content").mapInArrow(read, "path string, sample_rate int, pcm binary, total_us long, status string")


def kept_waveforms(files: DataFrame, table: str, rate: int = 16_000, decode: Decoder = decode_wave) -> DataFrame:
    """``waveforms`` of ``files`` by way of a table at ``table`` (a folder) that jobs share: only files that it doesn't have in this
    version (path, length, time of change, rate) are decoded, and added to it."""
    spark, version = files.sparkSession, ["path", "length", "modificationTime", "sample_rate"]
    known = files.withColumn("sample_rate", F.lit(rate))
    where = spark._jvm.org.apache.hadoop.fs.Path(table)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        known = known.join(spark.read.parquet(table).select(*version), version, "left_anti")
    new = known.select("path", "length", "modificationTime").join(waveforms(known, rate, decode), "path")
    new.write.mode("append").parquet(table)
    held = spark.read.parquet(table).join(files.select("path", "length", "modificationTime"), version[:3], "left_semi").filter(F.col("sample_rate") == rate)
    return held.select("path", "sample_rate", "pcm", "total_us", "status").dropDuplicates(["path"])


def cut(waves: DataFrame, chunks: DataFrame, key: str = "path") -> DataFrame:
    """Each chunk (``start_sample, end_sample``) with its bytes as ``pcm``. No Python: a chunk is a substring of the bytes. The
    chunks are what is hashed; recordings pass by one at a time, and are neither sorted nor broadcast, whatever size Spark takes
    them for. Partitions keep their number: rows' sizes don't tell how much is cut from them, so they would be put together."""
    dealt = chunks.repartition(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    both = dealt.hint("shuffle_hash").join(waves.select(key, F.col("pcm").alias("__pcm")), key)
    first = (2 * F.col("start_sample") + 1).cast("int")
    size = (2 * (F.col("end_sample") - F.col("start_sample"))).cast("int")
    return both.withColumn("pcm", F.substring("__pcm", first, size)).drop("__pcm")
