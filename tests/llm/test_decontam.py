import hashlib
import random
import re

import numpy as np

from turnweave.llm import decontam

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, width=13):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(min(len(w), 1), len(w) - width + 1)):
            windows.setdefault(tuple(w[k : k + width]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                if k + n <= len(w) and (own := windows.get(tuple(w[k : k + n]))):
                    hit |= set(range(k, k + n))
                    names |= own
        out.append((str(d), len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_whole_query_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(["Alpha", "beta,", "GAMMA-3", "délta", "ε", "x1"]) for _ in range(n))
    items = [(i, say(rng.randint(14, 30))) for i in range(12)] + [(20, "Only three words"), (21, None), (22, " ... "), (None, "no name item here"), (20, "only three WORDS"), (30, "lonely")]
    docs = [(i, f"{say(20)} {rng.choice(items)[1] or ''} {say(5)}") for i in range(60)]
    docs += [(100, None), (101, ""), (102, "-- \n"), (103, "only three words"), (104, "only three. WORDS only three words"), (None, items[0][1]), (105, items[3][1]), (105, items[3][1]), (106, "LONELY x lonely"), (107, say(5000) + " " + items[1][1])]
    frame = spark.createDataFrame([(d, t, 1, "c") for d, t in docs], "doc_id long, text string, N_words int, contaminated string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontam.BLOCK_BYTES, 200):  # one block of queries, or many
        monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
        found = decontam.decontaminate(frame.repartition(3), bench).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found) == plain(docs, items)
    kept = decontam.decontaminate(frame, bench, keep=True)
    assert kept.columns == ["doc_id", "text", "N_words", "contaminated", "n_words_", "n_hit", "n_items", "items_sha256", "contaminated_"]
    clean = decontam.drop_contaminated(frame, bench)
    assert clean.columns == frame.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, t in docs if not leaks(t, items))


def leaks(text, items, width=13):
    """Holds a whole window; or windows of shorter items are a twentieth of it."""
    w, own, hit = words(text), [words(t) for _, t in items], set()
    at = {tuple(w[k : k + n]): None for n in range(1, width + 1) for k in range(len(w) - n + 1)}
    if any(tuple(x[k : k + width]) in at for x in own for k in range(len(x) - width + 1)):
        return True
    for x in own:
        for k in range(len(w) - len(x) + 1 if 0 < len(x) < width else 0):
            if w[k : k + len(x)] == x:
                hit |= set(range(k, k + len(x)))
    return len(hit) > 0 and 20 * len(hit) >= len(w)


def test_passages_of_long_documents_go_and_clean_ones_stay(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    items = [(i, " ".join(f"q{i}x{k}" for k in range(35))) for i in range(30)] + [(99, "w1 w2")]
    docs = [(i, f"{say(rng.randint(500, 20_000))} {t} {say(1000)}") for i, t in items[:30]] + [(100 + i, say(1000) + " w1 w2") for i in range(30)] + [(None, None), (None, say(3) + " " + items[0][1]), (200, "")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(str(r.doc_id) for r in decontam.drop_contaminated(frame, bench).collect()) == sorted(["None", "200", *(str(100 + i) for i in range(30))])


def test_many_items_in_a_run_and_exact_places(spark):
    rng = random.Random(5)
    items = [(i, " ".join(f"t{rng.randrange(60)}" for _ in range(rng.randint(1, 30)))) for i in range(3000)]
    docs = [(i, " ".join([f"t{rng.randrange(60)}" for _ in range(40)] + rng.choice(items)[1].split())) for i in range(30)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index = decontam.build_index(frame)
    got = sorted((r.doc.doc_id, r.item_id, r.position, r.n_words, r.exact) for r in decontam.matches(index, bench).collect())
    want = set()
    windows = {}
    for i, t in items:
        w = t.split()
        for k in range(max(1, len(w) - 12)):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    for d, t in docs:
        w = t.split()
        want |= {(d, i, k, n, True) for n in range(1, 14) for k in range(len(w) - n + 1) for i in windows.get(tuple(w[k : k + n]), ())}
    assert got == sorted(want)
    found = decontam.search(index, bench).collect()
    assert {(r.doc.doc_id, r.n_words) for r in found} == {(d, len(t.split())) for d, t in docs}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0
    row = decontam.decontaminate(docs, bench.limit(0)).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (3, 0, 0, False)


def test_proximity(spark):
    words_ = np.array([10, 99, 20, 30, 10, 20, 30], np.uint64)
    index = decontam.PositionalIndex.of(words_, np.array([0, 7]))
    phrase = index.numbers(np.array([[10, 20, 30]], np.uint64).ravel())[None, :]
    assert index.phrases(phrase)[1].tolist() == [4]
    assert sorted(index.phrases(phrase, slack=1)[1].tolist()) == [0, 4]
    docs = spark.createDataFrame([(1, "a x b c. a b c"), (2, "a b"), (3, "c"), (4, "a c b")], "doc_id long, text string")
    found = decontam.matches(decontam.build_index(docs), spark.createDataFrame([(7, "a b c")], "item_id long, text string"), slack=1).collect()
    assert sorted((r.doc.doc_id, r.item_id, r.position, r.exact) for r in found) == [(1, "7", 0, False), (1, "7", 4, True), (4, "7", 0, False)]
