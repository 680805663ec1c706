import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from turnweave.llm import sharding


def plain_score(key, shard, weight=1.0):
    tagged = "n" if key is None else f"k{key}"
    u = (int(hashlib.md5(f"{tagged}/{shard}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
    return -math.log(u) / weight


def plain_shard(key, weights):
    return min((i for i, w in enumerate(weights) if w > 0), key=lambda i: plain_score(key, i, weights[i]))


def test_whole_query_against_a_plain_loop(spark):
    rows = [(i, "é" * (i % 7), "x") for i in range(500)] + [(None, None, "x"), (None, None, "x"), (7, "other", "x"), (7, "é" * 0, "x"), (600, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").withColumn("slot", F.lit(1)).withColumn("size", F.lit("s"))
    found = sharding.shard_documents(docs, 16).collect()
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), plain_shard(i, [1] * 16), plain_shard(i, [1] * 17)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32, r.shard, r.grown_shard) for r in found) == want
    assert all(r.grown_shard in (r.shard, 16) and r.law == "key" for r in found)
    for s in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
    again = {(r.doc_id, r.text_crc32, r.shard) for r in sharding.shard_documents(docs.repartition(7), 16).collect()}
    assert again == {(r.doc_id, r.text_crc32, r.shard) for r in found}


def test_weights_and_growth(spark):
    ids = spark.range(20000).select(F.col("id").alias("doc_id"))
    weights = (1.0, 2.0, 0.0, 1.0)
    counts = {r.shard: r["count"] for r in sharding.assign_shards(ids, weights=weights).groupBy("shard").count().collect()}
    assert set(counts) == {0, 1, 3} and abs(counts[1] / 20000 - 0.5) < 0.02
    moved = sharding.assign_shards(sharding.assign_shards(ids, weights=(1.0,) * 4), weights=(1.0,) * 5, shard="grown")
    assert moved.filter("shard <> grown AND grown <> 4").count() == 0
    assert abs(moved.filter("shard <> grown").count() / 20000 - 0.2) < 0.02
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("doc_id"), (0.0,))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard_documents(docs).count() == 0 and sharding.assign_shards(docs).count() == 0
