"""The engine's inputs as views of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import day, epoch_us
from ..session import table


def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as segments: a day is a session, an event type a speaker; an event lasts ``value`` seconds; each tenth is silent."""
    e = table(spark, sf_dir, "events")
    start = epoch_us(F.col("ts"), dict(e.dtypes)["ts"])
    return e.select(
        day(start).alias("dir"),
        F.col("event_type").alias("audio"),
        "user_id",
        start.alias("start_us"),
        (start + F.round(F.col("value") * 1000).cast("long") * 1000).alias("end_us"),
        F.lit(0).cast("long").alias("file_no"),
        F.col("event_id").alias("seg_no"),
        F.when(F.col("event_id") % 10 == 0, "").otherwise(F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("text"),
    )


EVENT_SQL = """s AS (
  SELECT strftime(ts, '%Y-%m-%d') AS dir, event_type AS audio, user_id, epoch_us(ts) AS start_us,
    epoch_us(ts) + CAST(round(value * 1000) AS BIGINT) * 1000 AS end_us, event_id AS seg_no,
    CASE WHEN event_id % 10 = 0 THEN '' ELSE 'e' || event_id END AS text FROM events
)"""


def user_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as speech spans of their users, a hundred times as long."""
    s = event_segments(spark, sf_dir)
    return s.select("user_id", "start_us", (F.col("start_us") + 100 * (F.col("end_us") - F.col("start_us"))).alias("end_us"))


SPAN_SQL = EVENT_SQL + """, u AS (SELECT user_id, start_us, start_us + 100 * (end_us - start_us) AS end_us FROM s)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as dialog segments: ``conv_id, index, speaker, text``."""
    return table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("index"), F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))


TURN_SQL = "t AS (SELECT conv_id, turn + 1 AS idx, role AS speaker, coalesce(text, '') AS text FROM conversations)"
