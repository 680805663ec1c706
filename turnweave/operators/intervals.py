"""Interval algebra over speech spans: ``start_us`` and ``end_us`` per recording (``keys``)."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.numbers import div
from ..functions.times import one_decimal, to_samples
from ..model import SliceConfig
from ..session import ship


def pad(spans: DataFrame, by_us: int, total: str | None = None) -> DataFrame:
    """Spans widened on both sides, not below zero nor beyond the column ``total`` (the recording's length)."""
    if by_us <= 0:
        return spans
    end = F.col("end_us") + by_us
    return spans.withColumns({"start_us": F.greatest(F.lit(0).cast("long"), F.col("start_us") - by_us), "end_us": F.least(F.col(total), end) if total else end})


def merge_close(spans: DataFrame, keys: Sequence[str], gap_us: int, slice_us: int | None = None) -> DataFrame:
    """Spans less than ``gap_us`` apart become one: ``keys, start_us, end_us``. One shuffle; the group-by reuses the
    window's partitioning.

    A recording is one window partition. With ``slice_us`` it is cut into slices of time: the spans of a slice are merged
    by themselves, and only each slice's merged spans meet by recording, so a hot recording's rows don't meet in one task.
    Merging what is merged gives the same spans, as a gap within a slice is judged again with the reach of earlier ones.
    """
    if slice_us:
        cut = spans.select(*keys, "start_us", "end_us", F.floor(F.col("start_us") / F.lit(slice_us)).alias("__slice"))
        spans = _merged(cut, [*keys, "__slice"], gap_us)
    return _merged(spans, keys, gap_us)


def _merged(spans: DataFrame, keys: Sequence[str], gap_us: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("start_us", "end_us")
    reach = F.max("end_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start_us") - reach >= gap_us), 1).otherwise(0)
    flagged = spans.select(*keys, "start_us", "end_us", opens.alias("__opens"))
    island = F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = flagged.withColumn("__island", island).groupBy(*keys, "__island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    return merged.select(*keys, "start_us", "end_us")


def split_long(spans: DataFrame, limit_us: int, width_us: int | None = None) -> DataFrame:
    """Spans longer than ``limit_us`` are cut into pieces of ``width_us`` (the limit if not given) and a rest. No shuffle."""
    width = width_us or limit_us
    rest = [c for c in spans.columns if c not in ("start_us", "end_us")]
    starts = F.when(F.col("end_us") - F.col("start_us") > limit_us, F.sequence(F.col("start_us"), F.col("end_us") - 1, F.lit(width).cast("long"))).otherwise(F.array("start_us"))
    long = (F.col("end_us") - F.col("start_us")) > limit_us
    cut = spans.select(*rest, F.col("end_us").alias("__end"), long.alias("__long"), F.explode(starts).alias("start_us"))
    end = F.when(F.col("__long"), F.least(F.col("start_us") + width, F.col("__end"))).otherwise(F.col("__end"))
    return cut.select(*rest, "start_us", end.alias("end_us"))


def spans_to_samples(spans: DataFrame, rate: int = 16_000) -> DataFrame:
    """``start_sample`` and ``end_sample`` (half-open, one sample at least) in place of the times."""
    rest = [c for c in spans.columns if c not in ("start_us", "end_us")]
    first = F.greatest(F.lit(0).cast("long"), to_samples(F.col("start_us"), rate))
    return spans.select(*rest, first.alias("start_sample"), F.greatest(first + 1, to_samples(F.col("end_us"), rate)).alias("end_sample"))


def pack_bins(spans: DataFrame, keys: Sequence[str], config: SliceConfig = SliceConfig()) -> DataFrame:
    """Consecutive spans packed into bins, none cut: ``keys, start_us, end_us, speech_us, n_spans``.

    A bin closes where the silence before the next span is above ``inner_silence_us``, where its speech would get above
    the cap, or its length above the limit. The silence rule depends on neighbours alone, so it splits each recording into
    islands by a window; the other two rules are a fold within islands, over columns of Arrow batches in the window's own
    partitioning and order: one shuffle, and no recording is held in memory by the fold.
    """
    order = Window.partitionBy(*keys).orderBy("start_us", "end_us")
    gap = F.col("start_us") - F.lag("end_us").over(order)
    rows = spans.select(*keys, "start_us", "end_us", F.coalesce((gap > config.inner_silence_us).cast("int"), F.lit(0)).alias("__cut"))
    rows = rows.withColumn("__first", F.lag("start_us").over(order).isNull().cast("int"))
    schema = T.StructType([f for f in rows.schema.fields if f.name in keys] + [T.StructField(c, T.LongType()) for c in ("start_us", "end_us", "speech_us", "n_spans")])
    columns = [f.name for f in schema.fields]
    arrow, cap, limit = to_arrow_schema(schema), config.speech_cap_us, config.limit_us
    ship(spans.sparkSession)

    def pack(batches):
        open_ = None  # key values, start, end, speech, spans of the bin that may go on in the next batch
        for batch in batches:
            by = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            own = list(zip(*[by[k] for k in keys], strict=True))
            out = []
            for key, a, b, cut, first in zip(own, by["start_us"], by["end_us"], by["__cut"], by["__first"], strict=True):
                if open_ is not None and not (first or cut or open_[3] + b - a > cap or b - open_[1] > limit):
                    open_[2], open_[3], open_[4] = b, open_[3] + b - a, open_[4] + 1
                else:
                    if open_ is not None:
                        out.append(open_)
                    open_ = [key, a, b, b - a, 1]
            yield _bins(out)
        yield _bins([open_] if open_ is not None else [])

    def _bins(found):
        values = [list(v) for v in zip(*[b[0] for b in found], strict=True)] if found else [[] for _ in keys]
        values += [[b[k] for b in found] for k in (1, 2, 3, 4)]
        named = dict(zip([*keys, "start_us", "end_us", "speech_us", "n_spans"], values, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(named[c], f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.sortWithinPartitions(*keys, "start_us", "end_us").mapInArrow(pack, schema)


def clamp_samples(chunks: DataFrame, limit_us: int = 20_000_000, rate: int = 16_000) -> DataFrame:
    """Chunks of at most ``limit_us`` worth of samples each."""
    limit = limit_us * rate // 1_000_000
    rest = [c for c in chunks.columns if c not in ("start_sample", "end_sample")]
    cut = chunks.select(*rest, F.col("end_sample").alias("__end"), F.explode(F.sequence(F.col("start_sample"), F.col("end_sample") - 1, F.lit(limit).cast("long"))).alias("start_sample"))
    return cut.select(*rest, "start_sample", F.least(F.col("start_sample") + limit, F.col("__end")).alias("end_sample"))


def slice_speech(spans: DataFrame, keys: Sequence[str], config: SliceConfig = SliceConfig(), total: str | None = None) -> DataFrame:
    """Voice-activity spans to chunks (``start_sample, end_sample``): padded, merged, split, packed, in samples, clamped."""
    cut = speech_spans(spans, keys, config, total)
    if config.pack:
        cut = pack_bins(cut, keys, config).select(*keys, "start_us", "end_us")
    return clamp_samples(spans_to_samples(cut, config.sample_rate), config.limit_us, config.sample_rate)


def speech_spans(spans: DataFrame, keys: Sequence[str], config: SliceConfig = SliceConfig(), total: str | None = None) -> DataFrame:
    """The spans as ``slice_speech`` packs them."""
    return split_long(merge_close(pad(spans, config.pad_us, total), keys, config.merge_gap_us), config.limit_us, config.target_us)


def report(spans: DataFrame, word: str = "Голос") -> DataFrame:
    """A line for each span, as seconds with one decimal."""
    return spans.withColumn("line", F.concat(one_decimal(F.col("start_us")), F.lit("-"), one_decimal(F.col("end_us")), F.lit(f" {word}")))


def number_segments(chunks: DataFrame, keys: Sequence[str], rate: int = 16_000, keep: Sequence[str] = ()) -> DataFrame:
    """Segments (``seg_no`` from 1, times, empty text, columns to ``keep``) of chunks in samples; 16 kHz samples are exact in
    microseconds."""
    order = Window.partitionBy(*keys).orderBy("start_sample", "end_sample")
    common = gcd(rate, 1_000_000)
    us = lambda c: div(F.col(c) * (1_000_000 // common), rate // common)
    return chunks.select(*keys, F.row_number().over(order).cast("long").alias("seg_no"), us("start_sample").alias("start_us"), us("end_sample").alias("end_us"), F.lit("").alias("text"), *keep)
