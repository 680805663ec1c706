"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: 48 hash bits make the uniform number of a key and shard; they are exact in a double.
_BITS = float(2**48)
#: Offset rows (shards x buckets) up to which the slot offsets are broadcast: about 8 MB.
BROADCAST_ROWS = 1 << 18


def _tagged(key: Column) -> Column:
    return F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("n"))


def score(key: Column, shard: int, weight: float) -> Column:
    """-ln(u)/w with u uniform by the hash of key and shard: the smallest score wins, with odds as the weights."""
    u = (F.conv(F.substring(F.md5(F.concat(_tagged(key), F.lit(f"/{shard}")).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(_BITS)
    return -F.log(u) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard number (0-based int) of a key; shards of weight 0 get nothing. A null key is one key of its own.

    Only the key and each shard's own number and weight enter its score, so adding a shard moves rows into that
    shard alone and raising a weight moves rows only towards it.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must be >= 0 with at least one > 0")
    scores = F.array(*[score(key, i, w) if w > 0 else F.lit(float("inf")) for i, w in enumerate(weights)])
    return (F.array_position(scores, F.array_min(scores)) - 1).cast("int")


def assign_shards(df: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 16, shard: str = "shard") -> DataFrame:
    """``df`` with its rows' shard as column ``shard`` (an old column of that name is replaced). No shuffle.

    Nulls: a null key is hashed as one more key. Ties and repeated rows: equal keys share a shard. Empty tables stay
    empty, other columns are untouched.
    """
    return df.withColumn(shard, rendezvous(F.col(f"`{key}`"), weights))


def number_slots(df: DataFrame, shard: str, order: Sequence[str], slot: str = "slot", buckets: int = 4096, n_shards: int | None = None) -> DataFrame:
    """Gapless 0-based numbers per shard without a task per shard.

    Rows of a shard are dealt to hash buckets of the ``order`` columns; counts by (shard, bucket) give each bucket's
    first number, and a window within the bucket gives the rest. Rows equal in all ``order`` columns are
    interchangeable. ``df`` is read twice, so pass a table or something cheap.
    """
    bucket = "__bucket"
    text = F.concat_ws("/", *[_tagged(F.col(f"`{c}`")) for c in order])
    df = df.withColumn(bucket, F.substring(F.md5(text.cast("binary")), 1, 3) if buckets == 4096 else F.pmod(F.xxhash64(text), F.lit(buckets)))
    counts = df.groupBy(shard, bucket).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(shard).alias("__s"), F.col(bucket).alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    if n_shards and n_shards * buckets <= BROADCAST_ROWS:  # the bound is shards x buckets, whatever the input
        starts = F.broadcast(starts)
    within = Window.partitionBy(shard, bucket).orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in order])
    return (
        df.withColumn("__r", F.row_number().over(within).cast("long") - 1)
        .join(starts, (F.col(shard) == F.col("__s")) & (F.col(bucket) == F.col("__b")))
        .withColumn(slot, F.col("__first") + F.col("__r"))
        .drop("__s", "__b", "__first", "__r", bucket)
    )


def shard_documents(docs: DataFrame, n_shards: int = 16, weights: Sequence[float] | None = None) -> DataFrame:
    """One row per document: size, checksum, shard, slot and the shard with one more shard of mean weight.

    Null text: size 1, checksum 0. Null doc_id: one key. Repeated rows each get a slot. Empty table: no rows.
    """
    weights = list(weights or [1.0] * n_shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    extra = sum(weights) / len(weights)
    scores = F.array(*[score(F.col("doc_id"), i, w) if w > 0 else F.lit(float("inf")) for i, w in enumerate(weights)])
    shard = (F.array_position(scores, F.array_min(scores)) - 1).cast("int")
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard.alias("shard"),
        F.when(score(F.col("doc_id"), len(weights), extra) < F.array_min(scores), F.lit(len(weights))).otherwise(shard).cast("int").alias("grown_shard"),
    )
    narrow = materialise(narrow, "shards")
    return number_slots(narrow, "shard", ["doc_id", "text_crc32", "size"], n_shards=len(weights)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
