import hashlib
import random
import re
from collections import Counter

from turnweave.llm import anchors, packed


def brute(rows, width=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "bé", "c", "dd", "e "]) + str(rng.randrange(300))
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 50, 120)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(150))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            p = rng.choice(passages)
            w[at:at] = p[rng.randrange(3) :]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(100, None), (101, ""), (102, " \n"), (103, "x " * 80), (104, "one " * 35), (105, rows[3][1]), (106, rows[3][1])]
    return rows


def test_whole_query_against_brute_force(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, uid int")
    found = anchors.remove_repeats(docs)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_repeated_ids_null_ids_and_empty_table(spark):
    rows = corpus(2)[:12]
    rows += [(rows[0][0], rows[1][1]), (None, rows[2][1]), (None, "short one"), rows[4], rows[4]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, anchors.remove_repeats(docs).collect()), key=str) == brute(rows)
    assert anchors.remove_repeats(docs.limit(0)).count() == 0


def test_packed_records_come_back():
    import numpy as np

    h, uid, pos = np.array([5, 2**64 - 1, 0], np.uint64), np.array([-4, 9, 7], np.int64), np.array([1, 0, 2**31 - 1], np.int32)
    for got, want in zip(packed.unpack(packed.pack(h, uid, pos), np.uint64, np.int64, np.int32), (h, uid, pos), strict=True):
        assert (got == want).all()
