"""Records of integers packed into compressed blobs, so that millions of them are shuffled as a few rows.

A row is (bucket, kind, blob). Columns of a blob are stored byte by byte (all lowest bytes first), ascending ones as
differences, and compressed: ids and positions shrink to about a byte each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

SCHEMA = "bucket int, kind int, blob binary"
FIELDS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def pack(*columns: np.ndarray) -> bytes:
    """Each column as (values) whose dtype fixes its width; the first is stored as it is, the others as differences."""
    n, raw = len(columns[0]), []
    for k, c in enumerate(columns):
        if k and n:
            c = np.concatenate([c[:1], c[1:] - c[:-1]])
        raw.append(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(n, -1).T).tobytes() if n else b"")
    return n.to_bytes(4, "little") + pa.compress(b"".join(raw), codec="zstd", asbytes=True)


def unpack(blob: bytes, *dtypes) -> list[np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    widths = [np.dtype(d).itemsize for d in dtypes]
    raw = np.frombuffer(pa.decompress(memoryview(blob)[4:], n * sum(widths), codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    out, at = [], 0
    for k, (d, w) in enumerate(zip(dtypes, widths, strict=True)):
        c = np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(d).reshape(n)
        out.append(np.cumsum(c, dtype=d) if k else c)
        at += n * w
    return out


def unpack_all(blobs, *dtypes) -> list[np.ndarray]:
    parts = [unpack(b.as_buffer().to_pybytes() if hasattr(b, "as_buffer") else b, *dtypes) for b in blobs]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, d) for k, d in enumerate(dtypes)]


def dealt(bucket: np.ndarray, kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket that has records."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1 if len(bucket) else np.zeros(0, np.int64)
    bounds = [0, *cuts.tolist(), len(bucket)] if len(bucket) else [0]
    columns = [c[order] for c in columns]
    blobs = [pack(*[c[a:b] for c in columns]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[bounds[:-1]].astype(np.int32) if len(bucket) else [], pa.int32()), pa.array(np.full(len(blobs), kind, np.int32)), pa.array(blobs, pa.binary())], schema=FIELDS
    )


def id_bucket(uid: np.ndarray, buckets: int) -> np.ndarray:
    """As ``id_bucket_column``: a multiplicative hash that neither side overflows on."""
    return (np.mod(uid, 2147483629) * 48271 % 2147483647) % buckets


def id_bucket_column(uid: Column, buckets: int) -> Column:
    return ((F.pmod(uid, F.lit(2147483629).cast("long")) * F.lit(48271) % F.lit(2147483647)) % F.lit(buckets)).cast("int")


def with_uid(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(uid, doc_id, text as binary). uid is the id itself where ids are unique and not null; else rows are numbered
    once, in a table in the shared folder."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    shared = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL")
    if shared.isEmpty():
        return rows.select(F.col("doc_id").alias("uid"), "doc_id", "text")
    return materialise(rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text"), "numbered")


def _sorted(values: np.ndarray, more: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the values (with ``more`` behind them, if given), and which equal the one before."""
    order = np.argsort(values, kind="stable") if more is None else np.lexsort((more, values))
    v = values[order]
    same = v[1:] == v[:-1]
    if more is not None:
        w = more[order]
        same &= w[1:] == w[:-1]
    return order, same


def first_and_repeats(values: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices to send on, and those that repeat right here. Of values that stand here twice or more two are sent, so
    that whoever counts them knows; how often one stands here then doesn't matter."""
    order, same = _sorted(values, more)
    before, after = np.concatenate([[False], same]), np.concatenate([same, [False]])
    third = before.copy()
    third[1:] &= before[:-1]
    third[:1] = False
    return np.sort(order[~third[: len(order)]]), np.sort(order[(before | after)[: len(order)]])


def repeated(values: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
    """Flags of values that occur twice or more."""
    order, same = _sorted(values, more)
    out = np.zeros(len(values), bool)
    out[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(values) else False
    return out
