import hashlib
import random
import time

import numpy as np

from turnweave.llm import substrings


def brute(rows, width=50):
    texts = [(d, (t or "").encode()) for d, t in rows]
    key = lambda d: 2**62 if d is None else d
    least = {}
    for d, t in texts:
        for i in range(len(t) - width + 1):
            w = t[i : i + width]
            least[w] = min(least.get(w, 2**63), key(d))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if least[t[i : i + width]] < key(d):
                gone[i : i + width] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdeé fgh\n") for _ in range(n))
    passages = [text(n) for n in (48, 50, 52, 70, 400)]
    rows = []
    for i in range(80):
        t = text(rng.randrange(300))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(t) + 1)
            p = rng.choice(passages)
            t = t[:at] + p[rng.randrange(4) : len(p) - rng.randrange(4)] + t[at:]
        rows.append((i, t))
    rows += [(100, None), (101, ""), (102, "z" * 500), (103, "y" + "z" * 49), (104, "z" * 70), (105, rows[3][1]), (106, rows[4][1]), (107, "ab" * 300), (108, "b" + "ab" * 40)]
    rng.shuffle(rows)
    return rows


def test_whole_query_against_brute_force(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, owner string")
    assert sorted(map(tuple, substrings.remove_repeats(docs).collect()), key=str) == brute(rows)


def test_repeated_and_null_ids_and_empty_table(spark):
    rows = corpus(2)[:20]
    rows += [(rows[0][0], rows[1][1]), (None, rows[2][1]), (None, rows[2][1]), rows[4], rows[4]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substrings.remove_repeats(docs).collect()), key=str) == brute(rows)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_pieces_too_many_to_merge_give_the_same(monkeypatch):
    rng = random.Random(3)
    core = bytes(rng.randrange(256) for _ in range(60))
    texts = [bytes(rng.randrange(256) for _ in range(8)) + core[rng.randrange(5) :] for _ in range(50)]
    least = np.array([rng.randrange(99) for _ in texts])
    h, source = np.zeros(len(texts), np.uint64), np.arange(len(texts))
    merged = substrings._resolve(texts, h, least, source, 50)
    monkeypatch.setattr(substrings, "MERGE_BYTES", 500)
    other = substrings._resolve(texts, h, least, source, 50)
    assert all((merged[k] == other[k]).all() for k in range(len(texts)))
    want = lambda k, i: min(int(o) for t, o in zip(texts, least, strict=True) if texts[k][i : i + 50] in t)
    assert all(other[k][i] == want(k, i) for k in range(len(texts)) for i in range(len(texts[k]) - 49))


def test_a_minimizer_of_any_many_bytes_takes_linear_time():
    rng = random.Random(8)
    core = bytes(rng.randrange(256) for _ in range(200))
    texts = [bytes(rng.randrange(256) for _ in range(30)) + core[: 26 + k % 150] for k in range(20_000)] + [b"z" * n for n in range(50, 400)]
    least = np.arange(len(texts))[::-1].copy()
    begun = time.perf_counter()
    found = substrings._resolve(texts, np.zeros(len(texts), np.uint64), least, np.arange(len(texts)), 50)
    assert time.perf_counter() - begun < 30 and len(found) == len(texts)
    for k in rng.sample(range(len(texts)), 30):
        for i in range(0, len(texts[k]) - 49, 7):
            w = texts[k][i : i + 50]
            assert found[k][i] == min(int(o) for t, o in zip(texts, least, strict=True) if w in t)


def test_pieces_cover_every_window_once_whatever_the_step(monkeypatch):
    rng = random.Random(6)
    data = np.array([rng.choice(b"abc") for _ in range(3000)], np.uint8)
    offsets = np.array([0, 0, 10, 500, 549, 600, 2900, 3000, 3000])
    want = {t + i for t, e in zip(offsets[:-1], offsets[1:]) for i in range(e - t - 49)}
    whole = substrings.pieces(data, offsets, 50, substrings._table(50))
    monkeypatch.setattr(substrings, "_STEP", 64)
    for h, at, n in (whole, substrings.pieces(data, offsets, 50, substrings._table(50))):
        assert [w for a, k in zip(at, n, strict=True) for w in range(a, a + k)] == sorted(want)
        assert (h == whole[0]).all()
