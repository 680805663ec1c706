import random

from turnweave.model import SECOND
from turnweave.operators import dialog
from turnweave.streaming import turns

SCHEMA = "dir string, audio string, start_us long, end_us long, file_no long, seg_no long, text string"


def test_stream_gives_the_batch_turns(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for d in ("p", "q"):
        at = 1000
        for i in range(120):
            at += rng.choice([0, 1, 2, 6])
            rows.append((d, rng.choice("AB"), at * SECOND, (at + rng.randrange(4)) * SECOND, 0, i, rng.choice(["", "x", "y", "z"])))
    rows.sort(key=lambda r: r[2] + rng.randrange(20) * SECOND)  # out of order by less than the delay
    for k in range(6):
        part = rows[k * 40 : (k + 1) * 40]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("end", "A", 10**6 * SECOND, 10**6 * SECOND, 0, 0, "x")], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = turns.merge_turns(stream, delay="60 seconds").writeStream.format("memory").queryName("turns").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = dialog.merge_turns(spark.createDataFrame(rows, SCHEMA))
    columns = ["dir", "audio", "start_us", "end_us", "text", "n_segments"]
    assert sorted(map(tuple, spark.table("turns").select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))
