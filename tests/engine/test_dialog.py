import random

from pyspark.sql import functions as F

from turnweave.model import SECOND
from turnweave.operators import dialog as D

SCHEMA = "dir string, audio string, start_us long, end_us long, file_no long, seg_no long, text string"


def segments(spark, *rows, where="d"):
    return spark.createDataFrame([(where, a, round(s * SECOND), round(e * SECOND), 0, i, t) for i, (a, s, e, t) in enumerate(rows)], SCHEMA)


def shown(turns):
    return [(r.audio, r.start_us / SECOND, r.end_us / SECOND, r.text) for r in turns.orderBy("dir", "turn").collect()]


def test_golden_turns(spark):
    rows = segments(spark, ("A", 0, 2, "a"), ("A", 5, 6, "b"), ("B", 5.5, 7, "c"), ("A", 6.5, 8, "d"))
    turns = D.merge_turns(rows)
    assert shown(turns) == [("A", 0, 6, "a b"), ("B", 5.5, 7, "c"), ("A", 6.5, 8, "d")]
    assert [(r.audio, r.text) for r in D.transcripts(turns).orderBy("first_turn").collect()] == [("A", "a b d"), ("B", "c")]
    assert shown(D.merge_turns(segments(spark, ("A", 0, 1, "x"), ("B", 1, 2, ""), ("A", 2, 3, "y")))) == [("A", 0, 3, "x y")]
    assert shown(D.merge_turns(segments(spark, ("A", 0, 10, "x"), ("A", 1, 3, "y"), ("A", 20, 21, None)))) == [("A", 0, 3, "x y")]


def plain_turns(rows, gap):
    out = []
    for a, s, e, t in sorted(rows, key=lambda r: r[1]):
        if not t:
            continue
        if out and out[-1][0] == a and s - out[-1][2] <= gap:
            out[-1][2:] = [e, f"{out[-1][3]} {t}"]
        else:
            out.append([a, s, e, t])
    return [tuple(x) for x in out]


def test_random_turns_against_a_plain_fold(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ABC"), s, s + rng.randrange(9), rng.choice(["", "x", "y", "z"])) for s in (rng.randrange(300) for _ in range(400))]
    assert shown(D.merge_turns(segments(spark, *rows))) == plain_turns(rows, 3)
    frame = segments(spark, *rows).unionByName(segments(spark, *rows[:50], where=None))
    for width in (1, 7, 1000):
        assert sorted(map(str, D.merge_turns(frame, slice_us=width * SECOND).collect())) == sorted(map(str, D.merge_turns(frame).collect()))


def test_empty_sessions(spark):
    rows = segments(spark, ("A", 0, 1, "x")).unionByName(segments(spark, ("A", 0, 1, ""), where="blank"))
    found = {r.dir: r.text for r in D.with_empty_dialogs(rows, D.merge_turns(rows)).collect()}
    assert found == {"d": "x", "blank": None}


def test_speaker_labels(spark):
    labels = {"bob": "Bob", "x.wav": "Ex"}
    cases = {"x/Bob.WAV": "Bob", "zed.wav": "zed", "": "audio", None: "audio", "x.wav": "Ex", ".wav": ".wav", "a.b.c": "a.b", "dir\\bob.mp3": "Bob", "x/a/": "a", "x/bob.wav//": "Bob"}
    frame = spark.createDataFrame([(k,) for k in cases], "audio string")
    for found in (frame.withColumn("speaker", D.speaker_label(F.col("audio"), labels)), D.label_speakers(frame, spark.createDataFrame(list(labels.items()), "key string, label string"))):
        assert {r.audio: r.speaker for r in found.collect()} == cases
    assert frame.select(D.speaker_label(F.col("audio"), {}).alias("s")).filter("s IS NULL").count() == 0


def test_punctuated_transcripts_and_counters(spark):
    rows = spark.createDataFrame([("a", 5, 0, "one ,"), ("a", 1, 1, "two"), ("a", None, 2, "zero"), (None, 0, 3, "u"), ("a", 0, 4, " \t"), ("b", 0, 5, None)], "audio string, start_us long, line_no long, text_punct string")
    assert {r.audio: r.text for r in D.punctuated_transcripts(rows).collect()} == {"a": "zero two one,", "UNKNOWN": "u"}
    assert tuple(D.counters(rows).first()) == (6, 4)


def test_sample_files(spark):
    files = spark.createDataFrame([(d, f"{d}/{i}") for d in "pq" for i in range(10)], "dir string, path string")
    one = sorted(r.path for r in D.sample_files(files, 3).collect())
    assert len(one) == 6 and one == sorted(r.path for r in D.sample_files(files.repartition(5), 3).collect())
    assert D.sample_files(files, 0).count() == 20 and D.sample_files(files, 99).count() == 20
