"""Turn assembly over a stream of segments (an extension: the survey's engine is batch only).

The rules are those of ``operators.dialog.merge_turns``. Segments may come out of order within the watermark's delay: they
wait in the session's state until the watermark has passed their start, and are then taken in order. A turn is emitted when
a segment that doesn't go on with it is taken, or when the watermark has passed its end by more than the gap. State is what
waits and one open turn; a session without either has none.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import DIALOG_GAP_US
from ..session import ship

COLUMNS = ("start_us", "file_no", "seg_no", "end_us", "audio", "text")


def merge_turns(segments: DataFrame, gap_us: int = DIALOG_GAP_US, delay: str = "1 minute", key: str = "dir") -> DataFrame:
    """Turns of a streaming ``segments`` (string ``key``): ``key, audio, start_us, end_us, text, n_segments``, append mode.
    Segments later than the watermark are left out."""
    ship(segments.sparkSession)
    said = segments.filter(F.length("text") > 0).withColumn("__time", F.timestamp_micros("start_us")).withWatermark("__time", delay)

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, turn = json.loads(state.get[0]) if state.exists else ([], None)
        for frame in frames:
            waiting += [list(r) for r in frame[list(COLUMNS)].astype(object).itertuples(index=False, name=None)]
        passed = state.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda r: r[:3])
        done = []
        while waiting and waiting[0][0] < passed:
            start, _, _, end, audio, text = waiting.pop(0)
            if turn and turn[0] == audio and start - turn[2] <= gap_us:
                turn = [audio, turn[1], end, f"{turn[3]} {text}", turn[4] + 1]
            else:
                done += [turn] if turn else []
                turn = [audio, start, end, text, 1]
        if turn and not waiting and passed > turn[2] + gap_us:
            done.append(turn)
            turn = None
        if waiting or turn:
            state.update((json.dumps([waiting, turn]),))
            due = min([waiting[0][0]] if waiting else [turn[2] + gap_us])
            state.setTimeoutTimestamp(max(due, passed) // 1000 + 2)
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame([[name[0], *t] for t in done], columns=[key, "audio", "start_us", "end_us", "text", "n_segments"])

    schema = f"`{key}` string, audio string, start_us long, end_us long, text string, n_segments long"
    return said.groupBy(key).applyInPandasWithState(step, schema, "state string", "append", GroupStateTimeout.EventTimeTimeout)
