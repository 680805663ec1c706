"""Ordered folds that Spark's windows cannot express: one shuffle by key, rows streamed in order through a state.

A group is never held in memory, so one of any size runs; what a fold keeps is its own state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], schema: T.StructType, start: Callable[[tuple], object], step: Callable[[object, dict], Iterable[dict]], finish: Callable[[object], Iterable[dict]], rows: int = 4096) -> DataFrame:
    """For each group of ``keys``: ``start(key)`` makes a state, ``step(state, row)`` takes the rows by ``order`` and
    ``finish(state)`` ends the group; what the two give is the output. Null keys are keys."""
    ship(df.sparkSession)
    arrow = to_arrow_schema(schema)
    keys = list(keys)

    def run(batches):
        at, state, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                now = tuple(row[k] for k in keys)
                if state is None or now != at:
                    if state is not None:
                        out += finish(state)
                    at, state = now, start(now)
                out += step(state, row)
                if len(out) >= rows:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        if state is not None:
            out += finish(state)
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
