"""Sources, sinks and backends over files in a temporary folder."""

import json
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnweave import backends, sinks
from turnweave.functions.text import recognised
from turnweave.model import SECOND, DedupConfig, PlanConfig, SliceConfig
from turnweave.operators import dialog, intervals
from turnweave.plans import jobs
from turnweave.sources import audio, lines
from turnweave.summary import fold


def write_wave(path, samples, rate=16_000, channels=1, width=2):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(samples.astype(f"<i{width}").tobytes())


def tone(seconds, rate=16_000):
    return np.sin(np.arange(int(seconds * rate)) * 0.3) * 20000


def test_catalogue_and_decoding(spark, tmp_path):
    write_wave(tmp_path / "in/a/x.WAV", tone(0.5))
    write_wave(tmp_path / "in/b/deep/y.wav", np.repeat(tone(0.5, 8000), 2), rate=8000, channels=2)
    (tmp_path / "in/a/z.mp3").write_bytes(b"not audio")
    (tmp_path / "in/a/notes.txt").write_text("no")
    files = audio.catalogue(spark, str(tmp_path / "in"))
    assert sorted((r.file_name, r.stem, r.suffix) for r in files.collect()) == [("x.WAV", "x", ".wav"), ("y.wav", "y", ".wav"), ("z.mp3", "z", ".mp3")]
    waves = {r.path.rsplit("/", 1)[1]: r for r in audio.waveforms(files).collect()}
    assert {k: r.total_us for k, r in waves.items()} == {"x.WAV": 500_000, "y.wav": 500_000, "z.mp3": 0}
    assert waves["x.WAV"].status == "ok" and "wave" in waves["z.mp3"].status
    assert np.abs(audio.from_pcm(waves["x.WAV"].pcm) - tone(0.5) / 32768).max() < 1e-3


def test_resampling():
    x = np.arange(10, dtype=np.float32)
    assert len(audio.resample(x, 8000, 16000)) == 20 and audio.resample(x, 8000, 16000)[-1] == 9
    assert len(audio.resample(x[:1], 48000, 16000)) == 1 and len(audio.resample(x[:0], 8000, 16000)) == 0
    assert np.array_equal(audio.resample(x, 16000, 16000), x)


def test_resampling_down_keeps_what_fits_and_takes_out_what_does_not():
    at = np.arange(48_000) / 48_000
    low, high = np.sin(2 * np.pi * 1000 * at), np.sin(2 * np.pi * 11_000 * at)
    got = audio.resample((low + high).astype(np.float32), 48_000, 16_000)
    want = np.sin(2 * np.pi * 1000 * np.linspace(0, at[-1], 16_000))
    assert len(got) == 16_000 and np.abs(got - want)[200:-200].max() < 0.02  # interpolation alone would fold 11 kHz onto 5


def test_other_codecs_go_through_a_program(spark, tmp_path):
    program = tmp_path / "decode.sh"
    program.write_text("#!/bin/sh\nif [ \"$1\" = 16000 ]; then read -r kind; [ \"$kind\" = good ] && head -c 32000 /dev/zero || { echo bad input >&2; exit 3; }; fi\n")
    program.chmod(0o755)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.mp3").write_bytes(b"good\n")
    (tmp_path / "in/b.ogg").write_bytes(b"else\n")
    write_wave(tmp_path / "in/c.wav", tone(0.25))
    files = audio.catalogue(spark, str(tmp_path / "in"))
    decode = audio.piped((str(program), "{rate}"))
    waves = {r.path.rsplit("/", 1)[1]: (r.total_us, r.status) for r in audio.waveforms(files, decode=decode).collect()}
    assert waves["a.mp3"] == (1_000_000, "ok") and waves["c.wav"] == (250_000, "ok") and waves["b.ogg"][0] == 0 and "bad input" in waves["b.ogg"][1]
    none = audio.piped((str(tmp_path / "missing"),))
    assert "missing" in {r.path.rsplit("/", 1)[1]: r.status for r in audio.waveforms(files, decode=none).collect()}["a.mp3"]


def test_decoded_recordings_are_kept(spark, tmp_path):
    write_wave(tmp_path / "in/a.wav", tone(0.25))
    table, calls = str(tmp_path / "kept"), tmp_path / "calls"
    calls.mkdir()

    def counted(content, rate, folder=str(calls)):
        import tempfile

        tempfile.mkstemp(dir=folder)
        return audio.decode_wave(content, rate)

    look = lambda: audio.kept_waveforms(audio.catalogue(spark, str(tmp_path / "in")), table, decode=counted)
    assert [(r.total_us, r.status) for r in look().collect()] == [(250_000, "ok")] and len(list(calls.iterdir())) == 1
    assert look().count() == 1 and len(list(calls.iterdir())) == 1
    write_wave(tmp_path / "in/b.wav", tone(0.5))
    assert sorted(r.total_us for r in look().collect()) == [250_000, 500_000] and len(list(calls.iterdir())) == 2


def test_whole_job(spark, tmp_path):
    quiet = np.zeros(16_000)
    write_wave(tmp_path / "s/bob.wav", np.concatenate([quiet, tone(2), quiet, tone(1), quiet]))
    write_wave(tmp_path / "s/amy.wav", quiet)
    files = audio.catalogue(spark, str(tmp_path / "s"))
    waves = audio.waveforms(files)
    slicing, dense = SliceConfig(inner_silence_us=0), DedupConfig(min_words_per_s=0.5)
    segments = jobs.transcribe(waves, slicing=slicing, dedup=dense).orderBy("seg_no").collect()
    assert [(r.path.rsplit("/", 1)[1], r.seg_no, r.text, r.accepted) for r in segments] == [("bob.wav", 1, "2100 ms", True), ("bob.wav", 2, "1100 ms", True)]
    assert [r.text for r in jobs.full_texts(jobs.transcribe(waves, slicing=slicing, dedup=dense)).collect()] == ["2100 ms 1100 ms"]
    rows = jobs.process(files, waves, slicing=slicing, dedup=dense)
    assert sorted((r.audio, r.file_no, r.text) for r in rows.collect()) == [("amy.wav", 1, ""), ("bob.wav", 2, "1100 ms"), ("bob.wav", 2, "2100 ms")]
    assert [(r.audio, r.text, r.n_segments) for r in jobs.punctuated_turns(rows).collect()] == [("bob.wav", "2100 ms 1100 ms.", 2)]

    class Made:
        def __init__(self):
            import tempfile

            tempfile.mkstemp(dir=folder)

        def transcribe(self, samples, rate):
            return "x"

    folder = str(tmp_path / "made")
    (tmp_path / "made").mkdir()
    chunks = audio.cut(waves, intervals.slice_speech(backends.speech_spans(waves), ["path"], slicing, "total_us"), "path")
    for _ in range(3):
        backends.recognise(chunks.coalesce(1), backends.once("made in this test", Made)).count()
    assert len(list((tmp_path / "made").iterdir())) <= 4  # a worker each at most, not a task each
    assert backends.on_device("gpu", 0.5).taskResources["gpu"].amount == 0.5


def test_merged_document_tokens_and_state(spark, tmp_path):
    rows = [{"audio": "z.wav", "start": 2.0, "text": "b"}, {"audio": "a.wav", "start": 1.0, "text": "q"}, {"audio": "z.wav", "start": 1.0, "text": "a"}, {"audio": "n.wav", "text": " "}]
    (tmp_path / "s.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    done = backends.punctuate(lines.read_segments(spark, str(tmp_path / "s.jsonl")))
    document = sinks.merged_json(done)
    assert document.first().json == json.dumps({"z.wav": "A. B.", "a.wav": "Q."}, indent=2)
    sinks.write_text(document, str(tmp_path / "out"), "json")
    assert "".join(f.read_text() for f in (tmp_path / "out").glob("*.txt")) == document.first().json + "\n"
    (tmp_path / "d.txt").write_text("A: abcd\nB: abcde\n\nnothing\n")
    assert [tuple(r)[1:] for r in lines.dialog_tokens(spark, str(tmp_path / "d.txt"), PlanConfig(target_tokens=2, max_tokens=2)).collect()] == [(2, 3, 2)]
    state = spark.createDataFrame([("p", "h", 0, 1, "s1", "done", 1, None), ("p", "h", fold.RECHECK, 0, "s2", "done", 1, None), ("q", "h", 0, 1, "s1", "done", 1, None), ("q", "h", 0, 2, "s1", "limited", 3, "stop")], "dialog string, content_hash string, pass int, chunk int, summary string, status string, attempts int, error string")
    held = fold.write_state(state, str(tmp_path / "state"))
    assert held.count() == 4 and fold.write_state(state.limit(1), str(tmp_path / "state")).count() == 5
    assert {r.dialog for r in fold.open_state(held, ["dialog"]).collect()} == {"q"}
    assert [tuple(r) for r in fold.partial_summaries(state, ["dialog"]).collect()] == [("q", "s1", "limited", "stop", 0, 2)]


def test_recording_to_segments(spark, tmp_path):
    quiet = np.zeros(16_000)
    write_wave(tmp_path / "s/bob.wav", np.concatenate([quiet, tone(2), quiet, tone(1), quiet]))
    waves = audio.waveforms(audio.catalogue(spark, str(tmp_path / "s")))
    spans = backends.speech_spans(waves)
    assert sorted((r.start_us // SECOND, r.end_us // SECOND) for r in spans.collect()) == [(1, 3), (4, 5)]
    chunks = intervals.slice_speech(spans, ["path"], SliceConfig(inner_silence_us=0), "total_us")
    said = backends.recognise(audio.cut(waves, chunks, "path")).withColumn("text", recognised(F.col("answer")))
    assert sorted(r.text for r in said.collect()) == ["1100 ms", "2100 ms"]

    class Echo:
        def transcribe(self, samples, rate, lang=None):
            return lang

    assert backends.recognise(audio.cut(waves, chunks, "path"), Echo, language="ru").first().answer == "ru"


def test_dialog_lines(spark, tmp_path):
    cases = ['{"audio":"a.wav","start":"00:00:00.000","text":" hi "}', 'Bob: "hello"', ": x", "Bob:", "no colon here", "", '{"text":5}', '{"speaker":7,"text":"x"}', 'Bob: "a\\"b"', '{"audio":"a.wav","text":"hi', "42", '{"speaker":"","audio":"z","text":"q"}', '{"speaker":"  ","audio":"z","text":"q"}', '{"speaker":false,"text":"r","end":3.5}', '{"text":"  "}', 'B: "']
    (tmp_path / "d.txt").write_text("\n".join(cases))
    read = lines.read_lines(spark, str(tmp_path / "d.txt"))
    found = [(r["index"], r.speaker, r.text, r.audio, r.start, r.end) for r in lines.parse_dialog(read, ["path"]).orderBy("index").collect()]
    assert found == [
        (1, "a.wav", "hi", "a.wav", "00:00:00.000", None), (2, "Bob", "hello", None, None, None), (3, "Unknown", "x", None, None, None), (4, "Unknown", "x", None, None, None),
        (5, "Bob", 'a\\"b', None, None, None), (6, '{"audio"', '"a.wav","text":"hi', None, None, None), (7, "z", "q", "z", None, None), (8, "Unknown", "q", "z", None, None), (9, "Unknown", "r", None, None, "3.5"),
    ]


def test_segment_lines_and_punctuation(spark, tmp_path):
    rows = [{"audio": "a.wav", "start": 1.5, "end": 2.0, "text": "b c", "extra": [1]}, {"audio": "a.wav", "start": "00:00:00.250", "end": "00:00:01.000", "text": "a"}, {"text": ""}]
    (tmp_path / "s.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")
    read = lines.read_segments(spark, str(tmp_path / "s.jsonl"))
    assert [(r.audio, r.start_us, r.end_us) for r in read.orderBy("line_no").collect()] == [("a.wav", 1_500_000, 2_000_000), ("a.wav", 250_000, 1_000_000), ("UNKNOWN", 0, None)]
    done = backends.punctuate(read)
    out = [json.loads(r.line) for r in sinks.punctuated(done).orderBy("line_no").collect()]
    assert out == [rows[0] | {"text_punct": "B c."}, rows[1] | {"text_punct": "A."}, rows[2] | {"text_punct": ""}]
    assert {r.audio: r.text for r in dialog.punctuated_transcripts(done).collect()} == {"a.wav": "A. B c."}
    (tmp_path / "bad.jsonl").write_text("{")
    assert lines.read_segments(spark, str(tmp_path / "bad.jsonl"), strict=False).count() == 0
    with pytest.raises(Exception, match="MALFORMED|parse"):
        lines.read_segments(spark, str(tmp_path / "bad.jsonl")).collect()


def test_punctuation_falls_back_to_halves(spark):
    class Short(backends.RulePunctuator):
        def label(self, text):
            if len(text.split()) > 2:
                raise RuntimeError("too long")
            return super().label(text)

    class Never:
        def label(self, text):
            raise RuntimeError("no")

    frame = spark.createDataFrame([("aa bb cc dd",), ("one",), (" ",), (None,)], "text string")
    assert [r.text_punct for r in backends.punctuate(frame, Short).collect()] == ["Aa. Bb. Cc dd.", "One.", " ", None]
    assert [r.text_punct for r in backends.punctuate(frame, Never).collect()] == ["aa bb cc dd", "one", " ", None]


def test_sinks(spark, tmp_path):
    turns = spark.createDataFrame([("d", 1, "a.wav", 0, 1_500_000, 'say "x"\nnow', 1), ("d", 2, "b.wav", 2_000_000, 3_000_000, "y", 1)], "dir string, turn long, audio string, start_us long, end_us long, text string, n_segments long")
    lines_ = turns.withColumn("line", sinks.quoted_line(F.col("audio"), F.col("text"))).withColumn("clean", sinks.clean_line(F.col("audio"), F.col("text")))
    sinks.write_lines(lines_, str(tmp_path / "q"), by=("dir",), order=("turn",))
    sinks.write_lines(lines_, str(tmp_path / "c"), line="clean", by=("dir",), order=("turn",))
    text = lambda p: "".join(f.read_text() for f in sorted((tmp_path / p).glob("dir=d/*.txt")))
    assert text("q") == 'a.wav: "say \\"x\\"\\nnow"\nb.wav: "y"\n'
    assert text("c") == 'a.wav: say "x" now\nb.wav: y\n'
    assert spark.range(1).select(sinks.clean_line(F.lit("s"), F.lit(None).cast("string"))).first()[0] == "s:"
    whole = sinks.transcript_json(dialog.transcripts(turns)).first().json
    assert list(json.loads(whole).items()) == [("a.wav", 'say "x"\nnow'), ("b.wav", "y")] and whole == json.dumps(json.loads(whole), indent=2)
    sinks.write_json(sinks.segment_rows(turns, "dir"), str(tmp_path / "j"), by=("dir",))
    back = sorted((json.loads(x) for f in (tmp_path / "j").glob("dir=d/*.json") for x in f.read_text().splitlines()), key=lambda r: r["start"])
    assert back[0] == {"audio": "a.wav", "start": "00:00:00.000", "end": "00:00:01.500", "duration": 1.5, "text": 'say "x"\nnow'}
    assert sinks.dialog_rows(turns).columns == ["audio", "start", "end", "text"]
    assert sinks.transcript_text(dialog.transcripts(turns)).filter("audio = 'b.wav'").first().block == "b.wav\ny\n\n"


def test_notes_and_keys(spark, tmp_path):
    (tmp_path / "n.txt").write_text("\n a\nb \n")
    assert lines.read_note(spark, str(tmp_path / "n.txt")) == "a\nb" and lines.read_note(spark, "") == ""
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        lines.read_note(spark, str(tmp_path / "none.txt"))
    (tmp_path / "k.ini").write_text("[gemini]\napi_key = abc \n[empty]\napi_key =\n")
    assert [lines.read_key(str(tmp_path / f), s, "api_key") for f, s in (("k.ini", "gemini"), ("k.ini", "empty"), ("k.ini", "no"), ("no.ini", "x"))] == ["abc", None, None, None]
    (tmp_path / "bad.ini").write_text("api_key = 1")
    with pytest.raises(RuntimeError):
        lines.read_key(str(tmp_path / "bad.ini"), "a", "b")


def test_cut_never_broadcasts_the_recordings(spark):
    """Spark takes bytes that are made on the way for a few; a broadcast of them went to the driver and failed."""
    size = 200_000
    waves = spark.range(12).select(F.col("id").alias("path"), F.repeat(F.unhex(F.lpad(F.hex(F.col("id") + 1), 2, "0")).cast("string"), size).cast("binary").alias("pcm"))
    chunks = spark.range(4000).select((F.col("id") % 13).alias("path"), (F.col("id") * 7 % 90_000).alias("start_sample"), (F.col("id") * 7 % 90_000 + F.col("id") % 20_000).alias("end_sample"))
    done = audio.cut(waves.repartition(3, "path"), chunks.repartition(3, "path"))
    found = done.select("path", "start_sample", "end_sample", F.octet_length("pcm").alias("n"), F.hex(F.substring("pcm", -1, 1)).alias("last")).collect()
    want = [(k % 13, k * 7 % 90_000, k * 7 % 90_000 + k % 20_000) for k in range(4000) if k % 13 < 12]
    want = [(p, a, z, n, f"{p + 1:02X}" if n else "") for p, a, z in want for n in [max(0, min(2 * z, size) - min(2 * a, size))]]
    assert sorted(map(tuple, found)) == sorted(want)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan


def test_punctuate_answers_in_parts_of_bounded_size(spark, monkeypatch):
    """A batch of 10,000 rows had the labels of all its words in memory at once."""
    texts = ["one  two three " * 1500, None, " ", "", "x"] * 40 + ["y " * 200_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    done = backends.punctuate(frame)
    assert [r.text_punct for r in done.orderBy("i").collect()] == [t if not t or not t.strip() else ("O" + " ".join(t.split())[1:] if t[0] == "o" else t.strip()[0].upper() + t.rstrip()[1:]) + "." for t in texts]

    held = []
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, run, *a, f=type(frame).mapInArrow, **b: held.append(run) or f(self, run, *a, **b))
    backends.punctuate(frame)
    batch = pa.RecordBatch.from_pydict({"i": list(range(len(texts))), "text": texts, "__text": texts})
    out = list(held[0](iter([batch])))
    assert [i for b in out for i in b.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column(1).to_pylist()) <= 1 << 18 for b in out) and len(out) > 4
    said = [x for b in out for x in b.column(2).to_pylist()]
    assert [x and [[p["word"] for p in run] for run in x] for x in said] == [[t.split()] if t and t.strip() else None for t in texts]
