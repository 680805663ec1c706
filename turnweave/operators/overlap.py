"""Removal of text that neighbouring chunks of a recording both have."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from difflib import SequenceMatcher

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import DedupConfig
from .fold import ordered_fold

_WORD = re.compile(r"\w+\b")


def plain_tokens(text: str) -> list[str]:
    return re.sub(r"[^\w\s]", "", unicodedata.normalize("NFKC", text)).lower().split()


def without_overlap(tail: str, text: str, config: DedupConfig = DedupConfig()) -> str:
    """``text`` without the words that ``tail`` ends with: the longest run of at least ``min_overlap`` tokens that is alike
    by ``ratio``. The words cut from ``text`` are counted as it is written."""
    before, now = plain_tokens(tail), plain_tokens(text)
    longest = min(len(before), len(now), config.max_overlap)
    alike = (k for k in range(longest, config.min_overlap - 1, -1) if SequenceMatcher(None, before[-k:], now[:k]).ratio() >= config.ratio)
    k = next(alike, 0)
    if not k:
        return text
    ends = [m.end() for m in _WORD.finditer(text)]
    return text[ends[k - 1] :].lstrip() if k < len(ends) else ""


def dense(text: str, duration_us: int, config: DedupConfig = DedupConfig()) -> bool:
    us = max(duration_us, 0.001)
    return bool(text) and (len(text.split()) * 1e6 >= config.min_words_per_s * us or len(text) * 1e6 >= config.min_chars_per_s * us)


def drop_overlaps(segments: DataFrame, keys: Sequence[str], config: DedupConfig = DedupConfig()) -> DataFrame:
    """``segments`` (keys, seg_no, start_us, end_us, text) with texts cut against what was accepted before in the recording;
    a text that is empty or sparse then becomes empty and isn't looked at by the next. ``accepted`` tells them.

    The state is the accepted texts' last ``tail_chars`` characters, glued without a blank.
    """

    def step(s, row):
        text = without_overlap(s["tail"], row["text"] or "", config)
        ok = dense(text, row["end_us"] - row["start_us"], config)
        if ok:
            s["tail"] = (s["tail"] + text)[-config.tail_chars :]
        yield row | {"text": text if ok else "", "accepted": ok}

    rows = segments.select(*keys, "seg_no", "start_us", "end_us", F.col("text").cast("string").alias("text"))
    schema = T.StructType([*rows.schema.fields, T.StructField("accepted", T.BooleanType())])
    return ordered_fold(rows, keys, ["seg_no", "start_us", "text"], schema, lambda key: {"tail": ""}, step, lambda s: ())
