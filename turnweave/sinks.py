"""Outputs as DataFrames of lines or documents, and their writers. Directories mirror the input; writers overwrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import quoted, squeeze
from .functions.times import format_offset
from .operators.dialog import punctuated_transcripts


def segment_rows(segments: DataFrame, *keys: str) -> DataFrame:
    """``audio, start, end, duration, text`` of all segments, those without text as well; duration in seconds."""
    return segments.select(*keys, "audio", format_offset(F.col("start_us")).alias("start"), format_offset(F.col("end_us")).alias("end"), ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration"), F.coalesce("text", F.lit("")).alias("text"))


def dialog_rows(turns: DataFrame, *keys: str) -> DataFrame:
    """``audio, start, end, text`` of turns."""
    return turns.select(*keys, "audio", format_offset(F.col("start_us")).alias("start"), format_offset(F.col("end_us")).alias("end"), "text")


def quoted_line(speaker: Column, text: Column) -> Column:
    return F.concat(speaker, F.lit(": "), quoted(text))


def clean_line(speaker: Column, text: Column) -> Column:
    """``speaker: text`` with single blanks; without text, no blank at the end."""
    flat = squeeze(F.coalesce(text, F.lit("")))
    return F.concat(speaker, F.lit(":"), F.when(flat != "", F.concat(F.lit(" "), flat)).otherwise(""))


def transcript_json(transcripts: DataFrame, key: str = "dir", name: str = "audio", order: str = "first_turn") -> DataFrame:
    """One JSON object per session: recordings by first appearance, indented by two."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct(order, name, "text"))), lambda x: F.concat(F.lit("  "), quoted(x[name]), F.lit(": "), quoted(x["text"])))
    return transcripts.groupBy(key).agg(F.concat(F.lit("{\n"), F.array_join(pairs, ",\n"), F.lit("\n}")).alias("json"))


def transcript_text(transcripts: DataFrame) -> DataFrame:
    return transcripts.withColumn("block", F.concat("audio", F.lit("\n"), "text", F.lit("\n\n")))


def punctuated(segments: DataFrame, text: str = "text_punct") -> DataFrame:
    """JSON lines: the objects as they were read (``raw``), with ``text_punct`` behind their fields."""
    body = F.regexp_replace(F.regexp_replace("raw", r"\s*\}\s*$", ""), r"^\s+", "")
    comma = F.when(body.rlike(r"^\{\s*$"), F.lit("")).otherwise(F.lit(", "))
    return segments.withColumn("line", F.concat(body, comma, F.lit(f'"{text}": '), quoted(F.col(text)), F.lit("}")))


def merged_json(segments: DataFrame, text: str = "text_punct") -> DataFrame:
    """All recordings' punctuated texts as one JSON object, recordings by where they first say something."""
    said = segments.filter(F.coalesce(F.col(text).rlike(r"\S"), F.lit(False))).groupBy(F.coalesce("audio", F.lit("UNKNOWN")).alias("audio")).agg(F.min("line_no").alias("first_turn"))
    return transcript_json(punctuated_transcripts(segments, text).join(said, "audio").withColumn("dir", F.lit(""))).select("json")


def write_text(rows: DataFrame, path: str, text: str, by: tuple[str, ...] = ()) -> None:
    """A document a row as text files, one folder for each value of ``by``; what was there is replaced."""
    rows.select(*by, F.col(text).alias("value")).write.mode("overwrite").partitionBy(*by).text(path)


def write_lines(rows: DataFrame, path: str, line: str = "line", by: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> None:
    """Lines as text files, one folder for each value of ``by``, in ``order`` within them."""
    rows = rows.select(*by, *[F.col(c).alias(f"__{c}") for c in order], F.col(line).alias("value"))
    if by:
        rows = rows.repartition(*by)
    rows = rows.sortWithinPartitions(*by, *[f"__{c}" for c in order]).select(*by, "value")
    rows.write.mode("overwrite").partitionBy(*by).text(path)


def write_json(rows: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    rows.write.mode("overwrite").partitionBy(*by).json(path)
