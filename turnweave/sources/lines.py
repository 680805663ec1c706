"""Line-based inputs: dialogs as JSON lines or ``speaker: text``, segment JSON lines, small text and key files."""

from __future__ import annotations

import configparser
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.times import parse_offset
from ..model import PlanConfig
from ..operators.planning import token_sizes


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, line`` of text files; the number is the line's place, whatever the file's splits."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", r"\r\n|\n|\r").alias("lines"))
    return files.select("path", F.posexplode("lines").alias("line_no", "line"))


def parse_dialog(lines: DataFrame, keys: Sequence[str], order: str = "line_no", line: str = "line") -> DataFrame:
    """Accepted lines: ``keys, order, index`` (from 1 by dialog), ``speaker, text, audio, start, end``.

    A JSON object gives its ``text`` (a non-blank string, else the line is left out) and as speaker the first of
    ``speaker`` and ``audio`` that isn't empty, Unknown if that is no string. A line that isn't JSON is cut at its first
    colon; one pair of quotes around its text goes. JSON that is no object is left out.
    """
    raw = lines.select(*keys, order, strip(F.coalesce(F.col(line), F.lit(""))).alias("raw"))
    # each part is taken out once; as SQL text, as hundreds of column objects take the driver longer than the job
    rows = raw.withColumn("v", F.try_parse_json("raw"))
    parts = rows.selectExpr(*[f"`{k}`" for k in (*keys, order)], "raw", "v IS NULL AS plain", "coalesce(schema_of_variant(v) LIKE 'OBJECT%', false) AS object", *[f"schema_of_variant(try_variant_get(v, '$.{k}', 'variant')) AS {k}_kind" for k in ("text", "speaker", "audio")], *[f"try_variant_get(v, '$.{k}', 'string') AS {k}" for k in ("text", "speaker", "audio", "start", "end")])
    empty = lambda k: F.expr(f"coalesce({k}_kind = 'VOID', true) OR coalesce({k} IN ('', 'false', '[]', '{{}}'), true) OR coalesce({k}_kind <> 'STRING' AND try_cast({k} AS double) = 0, false)")
    name = lambda k: F.when(F.col(f"{k}_kind") == "STRING", F.coalesce(F.nullif(strip(F.col(k)), F.lit("")), F.lit("Unknown"))).otherwise("Unknown")
    speaker = F.when(~empty("speaker"), name("speaker")).when(~empty("audio"), name("audio")).otherwise("Unknown")
    said = strip(F.regexp_replace("raw", r"(?s)^[^:]*:", ""))
    bare = F.when(said.startswith('"') & said.endswith('"'), F.when(F.length(said) > 1, said.substr(F.lit(2), F.length(said) - 2)).otherwise("")).otherwise(said)
    found = parts.select(
        *keys,
        order,
        F.when(F.col("plain"), F.coalesce(F.nullif(strip(F.substring_index("raw", ":", 1)), F.lit("")), F.lit("Unknown"))).otherwise(speaker).alias("speaker"),
        F.when(F.col("plain") & F.col("raw").contains(":"), strip(bare)).when(F.col("object") & (F.col("text_kind") == "STRING"), strip(F.col("text"))).alias("text"),
        *[F.when(~F.col("plain"), F.col(k)).alias(k) for k in ("audio", "start", "end")],
    )
    # accepted lines are counted before the others go: a filter below the window would have all of this put into the scan twice
    window = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    index = F.count_if(F.coalesce(F.col("text") != "", F.lit(False))).over(window).cast("int")
    return found.withColumn("index", index).filter("text <> ''").select(*keys, order, "index", "speaker", "text", "audio", "start", "end")


def read_segments(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Segment JSON lines with times as ``HH:MM:SS.mmm`` or seconds: ``audio, start_us, end_us, text, line_no, raw``. A
    malformed line ends the job, or is left out if not ``strict``. ``raw`` keeps all fields for ``sinks.punctuated``."""
    lines = read_lines(spark, path).filter(F.col("line").rlike(r"\S"))
    v = (F.parse_json if strict else F.try_parse_json)(F.col("line"))
    rows = lines.select("path", "line_no", F.col("line").alias("raw"), v.alias("v")).filter("v IS NOT NULL")
    text = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    return rows.select("path", "line_no", F.coalesce(text("audio"), F.lit("UNKNOWN")).alias("audio"), F.coalesce(parse_offset(text("start")), F.lit(0)).alias("start_us"), parse_offset(text("end")).alias("end_us"), F.coalesce(text("text"), F.lit("")).alias("text"), "raw")


def dialog_tokens(spark: SparkSession, path: str, config: PlanConfig = PlanConfig()) -> DataFrame:
    """Of each dialog file ``path, n_segments, tokens`` and the ``chunks`` that a plan asks for."""
    return token_sizes(parse_dialog(read_lines(spark, path), ["path"]), ["path"], config)


def read_note(spark: SparkSession, path: str | None) -> str:
    """A small text file in one piece, stripped; no path: empty; a missing file is an error."""
    if not path:
        return ""
    return spark.read.text(path, wholetext=True).first()[0].strip()


def read_key(path: str, section: str, key: str) -> str | None:
    """A value of an INI file on the driver; None where the file, section or key is missing or empty."""
    parser = configparser.ConfigParser()
    try:
        if not parser.read(path, encoding="utf-8"):
            return None
    except configparser.Error as e:
        raise RuntimeError(f"{path} cannot be read") from e
    return (parser.get(section, key, fallback="") or "").strip() or None
