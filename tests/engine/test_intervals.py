"""Golden cases in seconds, and each operator against a plain fold."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnweave.model import SECOND, SliceConfig
from turnweave.operators import intervals as I


def spans(spark, *pairs, key="a", **extra):
    rows = [(key, round(a * SECOND), round(b * SECOND), *extra.values()) for a, b in pairs]
    return spark.createDataFrame(rows, "k string, start_us long, end_us long" + "".join(f", {c} long" for c in extra))


def seconds(df, *columns):
    columns = columns or ("start_us", "end_us")
    return sorted(tuple(r[c] / SECOND for c in columns) for r in df.collect())


def samples(df):
    return sorted((r.start_sample, r.end_sample) for r in df.collect())


def test_pad_clamps_at_both_ends(spark):
    assert seconds(I.pad(spans(spark, (0.02, 1.0), (9.0, 9.98), total=10 * SECOND), 50_000, "total")) == [(0.0, 1.05), (8.95, 10.0)]
    assert seconds(I.pad(spans(spark, (1, 2)), 0)) == [(1, 2)]


@pytest.mark.parametrize(
    "given_, merged",
    [
        ([(2.5, 3), (0, 1), (1.05, 2)], [(0, 2), (2.5, 3)]),
        ([(0, 5), (1, 2), (5.05, 6)], [(0, 6)]),
        ([(0, 1), (1.1, 2)], [(0, 1), (1.1, 2)]),
    ],
)
def test_merge_close(spark, given_, merged):
    assert seconds(I.merge_close(spans(spark, *given_), ["k"], 100_000)) == merged


def test_split_long(spark):
    assert seconds(I.split_long(spans(spark, (0, 20)), 20 * SECOND, 15 * SECOND)) == [(0, 20)]
    assert seconds(I.split_long(spans(spark, (0, 31.05)), 20 * SECOND, 15 * SECOND)) == [(0, 15), (15, 30), (30, 31.05)]
    assert seconds(I.split_long(spans(spark, (0, 31)), 20 * SECOND)) == [(0, 20), (20, 31)]


@pytest.mark.parametrize(
    "given_, bins",
    [
        ([(0, 5), (5.5, 10), (11, 12)], [(0, 10), (11, 12)]),
        ([(0, 1), (1.75, 2)], [(0, 2)]),
        ([(0, 9), (9.5, 17.5)], [(0, 17.5)]),
        ([(0, 9), (9.5, 18)], [(0, 9), (9.5, 18)]),
        ([(2.75 * i, 2.75 * i + 2) for i in range(8)], [(0, 18.5), (19.25, 21.25)]),
        ([(0, 1), (1.1, 19.1), (19.2, 20)], [(0, 1), (1.1, 19.1), (19.2, 20)]),
    ],
)
def test_pack_bins(spark, given_, bins):
    assert seconds(I.pack_bins(spans(spark, *given_), ["k"])) == bins


def test_slicing_a_recording(spark):
    cut = I.split_long(spans(spark, (0, 31), total=40 * SECOND), 20 * SECOND)
    assert samples(I.slice_speech(cut, ["k"], SliceConfig(), "total")) == [(0, 240000), (240000, 496800)]
    assert samples(I.slice_speech(cut, ["k"], SliceConfig(pack=False), "total")) == [(0, 240000), (240000, 480000), (480000, 496800)]


def test_samples(spark):
    frame = spark.createDataFrame([("a", 0, 650000)], "k string, start_sample long, end_sample long")
    assert samples(I.clamp_samples(frame)) == [(0, 320000), (320000, 640000), (640000, 650000)]
    assert samples(I.spans_to_samples(spans(spark, (1.0, 1.0)))) == [(16000, 16001)]
    numbered = I.number_segments(I.clamp_samples(frame), ["k"]).orderBy("seg_no").collect()
    assert [(r.seg_no, r.start_us, r.end_us, r.text) for r in numbered] == [(1, 0, 20_000_000, ""), (2, 20_000_000, 40_000_000, ""), (3, 40_000_000, 40_625_000, "")]


def plain_merge(rows, gap):
    out = []
    for a, b in sorted(rows):
        if out and a - out[-1][1] < gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def plain_pack(rows, silence, cap, limit):
    out = []
    for a, b in sorted(rows):
        if out and a - out[-1][1] <= silence and out[-1][2] + b - a <= cap and b - out[-1][0] <= limit:
            out[-1][1:] = [b, out[-1][2] + b - a]
        else:
            out.append([a, b, b - a])
    return [tuple(x) for x in out]


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 2**32))
def test_random_spans_against_plain_folds(spark, seed):
    rng = random.Random(seed)
    rows = [(k, s, s + rng.randrange(40)) for k in ("a", "b", None) for s in (rng.randrange(400) for _ in range(rng.randrange(60)))]
    frame = spark.createDataFrame(rows, "k string, start_us long, end_us long")
    merged = I.merge_close(frame, ["k"], 5)
    packed = I.pack_bins(merged, ["k"], SliceConfig(target_us=50, overshoot_us=10, limit_us=70, inner_silence_us=8))
    got, bins = merged.collect(), packed.collect()
    assert sorted(map(str, I.merge_close(frame, ["k"], 5, slice_us=rng.choice([1, 9, 60, 999])).collect())) == sorted(map(str, got))
    for k in ("a", "b", None):
        want = plain_merge([(s, e) for n, s, e in rows if n == k], 5)
        assert sorted((r.start_us, r.end_us) for r in got if r.k == k) == want
        assert sorted((r.start_us, r.end_us, r.speech_us) for r in bins if r.k == k) == plain_pack(want, 8, 60, 70)


def test_empty(spark):
    none = spans(spark, (0, 1)).limit(0)
    assert I.slice_speech(none, ["k"]).count() == 0 and I.report(none).count() == 0
    assert I.report(spans(spark, (0, 1.26))).collect()[0].line.startswith("0.0-1.3 ")
