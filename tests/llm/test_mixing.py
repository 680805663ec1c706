import hashlib
import random
from fractions import Fraction

from hypothesis import given
from hypothesis import strategies as st

from turnweave.llm import mixing


def plain_targets(sizes, weights):
    """Raised a little at a time: the level at which shares by weight, cut at twice the size, add up to the whole."""
    total, caps = Fraction(3, 2) * sum(sizes), [Fraction(2 * s) for s in sizes]
    for cut in sorted({c / w for c, w in zip(caps, weights, strict=True)}):
        if sum(min(c, w * cut) for c, w in zip(caps, weights, strict=True)) >= total:
            fixed = [c / w < cut for c, w in zip(caps, weights, strict=True)]
            free = sum(w for w, f in zip(weights, fixed, strict=True) if not f)
            level = (total - sum(c for c, f in zip(caps, fixed, strict=True) if f)) / free
            return [c if f else w * level for c, w, f in zip(caps, weights, fixed, strict=True)]
    return caps


def exact_targets(sizes, weights):
    return plain_targets(sizes, [Fraction(w) for w in weights]) if sum(sizes) else [Fraction(0)] * len(sizes)


def test_targets(spark):
    rng = random.Random(8)
    for case in range(8):
        sizes = [rng.choice([0, 1, rng.randint(0, 50), rng.randint(0, 10**6)]) for _ in range(rng.randint(1, 30))]
        weights = [(5, 2, 1), (0.3, 1.5), (1,)][case % 3]
        sums = spark.createDataFrame([(f"s{k:03}", n) for k, n in enumerate(sizes)], "source string, n long")
        planned, n = mixing._sources(sums, weights, 1.5, 2)
        assert n == len(sizes)
        own = [Fraction(weights[i % len(weights)]).limit_denominator(1000) for i in range(len(sizes))]
        rows = planned.orderBy("no").collect()
        assert [r.source_size for r in rows] == sizes
        for r, t in zip(rows, exact_targets(sizes, own), strict=True):
            assert r.target == float(t) and r["__want"] == round(t)


@given(st.lists(st.integers(0, 500), min_size=1, max_size=6), st.integers(1, 9), st.integers(0, 99))
def test_quotas_are_split_exactly(quotas, shards, seed):
    rows = mixing.split_quotas(quotas, shards, seed)
    assert [sum(c) for c in zip(*rows, strict=True)] == quotas and len(rows) == shards
    assert max(map(sum, rows)) - min(map(sum, rows)) <= 1 and min(min(r) for r in rows) >= 0


def test_hypergeometric_has_its_distribution():
    rng, n = random.Random(1), 20000
    draws = [mixing.hypergeometric(6, 9, 5, rng) for _ in range(n)]
    from math import comb

    for k in range(6):
        assert abs(draws.count(k) / n - comb(6, k) * comb(9, 5 - k) / comb(15, 5)) < 0.015


def plain_mix(docs, seed=0):
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, (s or "").encode()))
    size = lambda t: len((t or "").split())
    sizes = [sum(size(t) for _, t, s in docs if s == x) for x in sources]
    want = exact_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))])
    out = []
    for x, n, target in zip(sources, sizes, want, strict=True):
        key = lambda d: stream_key(d, seed)
        at = 0
        for d in sorted((d for d in docs if d[2] == x), key=key):
            taken = sum(max(0, min(size(d[1]), round(target) - at - k * n)) for k in range(2))
            out.append((str(d[0]), size(d[1]), n, float(target), taken))
            at += size(d[1])
    return sorted(out)


def test_whole_query_against_a_plain_loop(spark):
    rng = random.Random(4)
    docs = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 60))), rng.choice(["b", "a", "é", None, "hot", "hot", "hot"])) for i in range(300)]
    docs += [(400, None, "a"), (401, "", "only"), (402, " \t", "only"), (None, "x y", "a"), (None, "x y", "a"), (7, "dup id", "b"), (403, "long " * 20000, "hot")]
    frame = spark.createDataFrame([(*d, "c", 1) for d in docs], "doc_id long, text string, source string, size string, target int")
    found = mixing.mix(frame.repartition(5), block_words=64)
    rows = found.collect()
    assert sorted((str(r.doc_id), r["size"], r.source_size, r.target, r.taken) for r in rows) == plain_mix(docs)
    assert all(r.taken <= 2 * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(frame.repartition(2), block_words=64).collect()))  # reruns agree
    # each shard's blocks of each source are the quota that the tree drew for it, one run of the stream
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, (s or "").encode()))
    wanted = {r.source: round(Fraction(r.target)) for r in rows}
    quotas = mixing.split_quotas([-(-wanted[s] // 64) for s in sources], 16)
    for k, s in enumerate(sources):
        own = sorted((r for r in rows if r.source == s), key=lambda r: stream_key((r.doc_id, dict_text(docs, r)), 0))
        ends = [sum(q[k] for q in quotas[: j + 1]) for j in range(16)]
        at = 0
        for r in own:
            if r["size"] and r.doc_id not in (None, 7):
                for begin, shard in ((at, r.shard_1), (at + r.source_size, r.shard_2)):
                    assert shard == (next(j for j in range(16) if begin // 64 < ends[j]) if begin < wanted[s] else None)
            at += r["size"]
    mixed = mixing.mix_rows(frame, block_words=64)
    assert mixed.columns == frame.columns
    times = {}
    for r in mixed.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    starts = {}
    for r in rows:
        starts[r.doc_id] = starts.get(r.doc_id, 0) + (r.shard_1 is not None) + (r.shard_2 is not None)
    assert times == {k: v for k, v in starts.items() if v}
    # rows of a partition stand by shard and by its own order
    shard = {(r.doc_id, k): (s, o) for r in rows for k, (s, o) in enumerate(((r.shard_1, r.order_1), (r.shard_2, r.order_2))) if s is not None}
    for part in mixed.rdd.glom().map(lambda p: [r.doc_id for r in p]).collect():
        held = [sorted(v for (i, _), v in shard.items() if i == d) for d in part if d not in (None, 7)]
        at = (-1, 0)
        for options in held:
            at = min((o for o in options if o >= at), default=None)
            assert at is not None


def dict_text(docs, row):
    return next(t for i, t, s in docs if i == row.doc_id and s == row.source and len((t or "").split()) == row["size"])


def stream_key(row, seed):
    return hashlib.md5(f"{seed}/{'n' if row[0] is None else row[0]}/{hashlib.md5((row[1] or '').encode()).hexdigest()}".encode()).hexdigest()


def test_rows_that_repeat_whole_come_near_the_target(spark):
    docs = [(1, "a b c d", "x", k) for k in range(2000)] + [(10 + k, "e f", "y", k) for k in range(100)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, n int")
    target = {r.source: r.target for r in mixing.mix(frame).select("source", "target").distinct().collect()}
    got = {r.source: r["sum(size)"] for r in mixing.mix_rows(frame).selectExpr("source", "size(split(text, ' ')) AS size").groupBy("source").sum("size").collect()}
    assert all(abs(got[s] - t) <= 0.05 * t for s, t in target.items()), (got, target)


def test_sources_in_groups(spark, monkeypatch):
    rng = random.Random(6)
    docs = [(k, "w " * rng.randint(0, 40), None if k % 37 == 0 else f"s{rng.randrange(60)}") for k in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "GROUP", 7)
    rows = mixing.mix(frame, block_words=8, shards=4).collect()
    assert sorted((str(r.doc_id), r["size"], r.source_size, r.target, r.taken) for r in rows) == plain_mix(docs)
    copies = [s for r in rows for s in (r.shard_1, r.shard_2) if s is not None]
    assert set(copies) == {0, 1, 2, 3}
    assert mixing.mix_rows(frame, block_words=8, shards=4).count() == len(copies)


def test_empty_table_and_one_shard(spark):
    frame = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id long, text string, source string")
    assert mixing.mix(frame.limit(0)).count() == 0 and mixing.mix_rows(frame.limit(0)).count() == 0
    assert mixing.mix_rows(frame, shards=1).count() == mixing.mix(frame, shards=1).selectExpr("sum(int(shard_1 is not null) + int(shard_2 is not null))").first()[0]
