import hashlib
import random
from math import comb

from pyspark.sql import functions as F

from turnweave.llm import quality

SYMBOLS = set("#*$%&|<>")


def plain_measure(text):
    text = text or ""
    split = lambda t: [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
    w = split(text)
    lines = [x for x in text.split("\n") if split(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    repeat = {p for i, v in enumerate(windows) if windows.count(v) > 1 for p in range(i, i + 5)}
    dup = len(lines) - len(set(lines))
    failed = len(w) < 10 or 100 * len(repeat) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in SYMBOLS for c in text), len(lines), dup, len(repeat), failed)


def measured(row):
    return tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed"))


def test_measures_against_a_plain_loop(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "a b c d e a b c d e", "x x x x x x x", "é ü  # * \n# *\n \n# *", "a b c d e f g h i j", "a\x0bb\x0cc\rd", "l\nl\n\nl ", "\U0001f600 |<>"]
    texts += [" ".join(rng.choice("abc") for _ in range(n)) for n in range(4, 60, 5)]
    texts += ["".join(rng.choice("ab \n#$é") for _ in range(200)) for _ in range(20)] + [" ".join(f"w{i % 4000}" for i in range(9000))]
    frame = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "doc_id int, text string, N_WORDS string").withColumn("row", F.lit(1))
    found = {r.doc_id: measured(r) for r in quality.measure(frame).collect()}
    small = {i: plain_measure(t) for i, t in enumerate(texts[:-1])}
    assert {i: found[i] for i in small} == small
    assert found[len(texts) - 1][5:] == (9000 - 0, True)
    assert quality.measure(frame.limit(0)).count() == 0


def plain_cutoffs(rows, labels, strata_of, texts):
    """Cutoffs by stratum from exact binomials. rows: id -> measure."""
    values = {
        "symbols": lambda m: m[2] / m[0], "word_length": lambda m: m[1] / m[0], "lines": lambda m: m[4] / max(m[3], 1), "windows": lambda m: m[5] / m[0],
    }
    hold = lambda i: hashlib.md5(f"holdout/{texts[i]}".encode()).hexdigest()[0] < "8"
    known = {i: q for i, q in labels.items() if i in rows and not rows[i][6]}
    strata = sorted({strata_of[i] for i in known})
    a, found = quality.MAX_REJECTION, {}
    for s in strata:
        own = {i: q for i, q in known.items() if strata_of[i] == s}
        over = lambda c, ids: [i for i in ids if values[c[0]](rows[i]) > c[1]]
        half = [[i for i, q in own.items() if hold(i) == h and (q == 1) == g] for h, g in ((False, True), (False, False), (True, True))]
        cells = [(r, cut) for r, (_, grid) in quality.RULES.items() for cut in grid]
        chain = sorted((c for c in cells if over(c, half[1])), key=lambda c: (len(over(c, half[0])), -len(over(c, half[1])), cells.index(c)))
        best = None
        for end in range(1, len(chain) + 1):
            gone = [{i for c in chain[:end] for i in over(c, ids)} for ids in half]
            k, n = len(gone[2]), len(half[2])
            if sum(comb(n, j) * a**j * (1 - a) ** (n - j) for j in range(k + 1)) > quality.DELTA / len(strata):
                break
            gain = len(gone[1]) - quality.COST * len(gone[0])
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, end)
        for rule in quality.RULES:
            found[s, rule] = min((c for r, c in chain[: best[1] if best else 0] if r == rule), default=None)
    return found, values


def test_verdicts_against_exact_binomials(spark):
    rng = random.Random(2)
    docs, labels, strata = [], {}, {}
    for i in range(5000):
        bad, lang = i % 5 == 0, "en" if i % 10 else "few" if i % 100 == 0 else None
        words = [rng.choice("abcdefgh") * rng.randint(2, 5) + str(rng.randrange(99)) for _ in range(rng.randint(12, 30))]
        if bad:
            words = [w + "#*$" for w in words]
        docs.append((i, " ".join(words), lang))
        labels[i], strata[i] = int(not bad), lang or ""
    docs += [(9000, None, "en"), (9001, "too short", "en"), (9002, "a#*$ " * 3 + " ".join(f"{k}#*$#" for k in range(12)), "unknown"), (None, " ".join(f"{k}##*$#" for k in range(12)), "en"), (0, docs[0][1], None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("kept", F.lit("clash"))
    marks = spark.createDataFrame([(i, q, 0) for i, q in labels.items()] + [(5, 1, 0), (None, 1, 0), (3, None, 0), (77777, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {i: plain_measure(t) for i, t, _ in docs if i is not None and i < 9000}
    cuts, values = plain_cutoffs(rows, labels, strata, {i: t for i, t, _ in reversed(docs)})
    assert any(cuts["en", r] for r in quality.RULES) and not any(cuts["few", r] for r in quality.RULES)  # too few labels to certify anything
    want = []
    for i, t, lang in docs:
        m = plain_measure(t)
        over = any(c is not None and m[0] and values[r](m) > c for (s, r), c in cuts.items() if s == (lang or ""))
        want.append((str(i), not m[6] and not over))
    found = [(str(r.doc_id), r.kept) for r in quality.judge(frame, marks).collect()]
    assert sorted(found) == sorted(want)
    kept = quality.keep_good(frame, marks)
    assert kept.columns == frame.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(i for i, k in want if k)
    assert {r.doc_id for r in quality.judge(frame, marks.limit(0)).filter("kept").collect()} >= {0, 9002}
    assert quality.judge(frame.limit(0), marks).count() == 0 and quality.keep_good(frame.limit(0), marks).count() == 0


def test_binomial_tail(spark):
    cases = [(k, n) for n in (1, 5, 40, 400, 3000) for k in (0, 1, 3, n // 100, n // 81) if k < n * 0.0125]
    frame = spark.createDataFrame(cases, "k long, n long")
    for r in frame.withColumn("p", quality.binomial_tail(F.col("k"), F.col("n"), 0.0125)).collect():
        exact = sum(comb(r.n, j) * 0.0125**j * 0.9875 ** (r.n - j) for j in range(r.k + 1))
        assert abs(r.p - exact) < 1e-8 * exact + 1e-300
