import random
import re
import time
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from turnweave.backends import half
from turnweave.functions import text as X
from turnweave.functions.numbers import half_even
from turnweave.functions.times import format_offset, one_decimal, parse_offset
from turnweave.model import SECOND
from turnweave.operators.overlap import plain_tokens

ODD = ["", " ", "a", "ab cd ef", "abcdef", "a , b", "a —b", "a—b", "x  —  y", " Straße naïve x ", "ﬁne ｆｕｌｌ ①", "été été", "a\x1cb\x85c", "Привет, мир!", "semi_colon-hy-phen", "one\n\ntwo"]


def column(spark, values, *exprs, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [tuple(r)[1:] if len(exprs) > 1 else r[1] for r in frame.select("i", *exprs).orderBy("i").collect()]


def test_format_offset(spark):
    us = [-SECOND, 500, 2500, 3661 * SECOND + 500_000, 360000 * SECOND]
    assert column(spark, us, format_offset(F.col("v")), kind="long") == ["00:00:00.000", "00:00:00.000", "00:00:00.002", "01:01:01.500", "100:00:00.000"]
    assert column(spark, ["01:01:01.500", "22.33", "0", "x", "1:2", "1:2:3:4"], parse_offset(F.col("v"))) == [3661_500_000, 22_330_000, 0, None, 62_000_000, None]


def test_one_decimal(spark):
    values = [*range(0, 3_000_000, 50_000), *(10**15 + k * 50_000 for k in range(60)), 49_999, 50_001, 123_456_749_999_999, 61_050_000]
    assert column(spark, values, one_decimal(F.col("v")), kind="long") == [f"{v / 1e6:.1f}" for v in values]


def test_half_even(spark):
    values = [*range(-30, 31), 10**15 + 5, -(10**15) - 5]
    assert column(spark, values, half_even(F.col("v"), 10), kind="long") == [round(v / 10) for v in values]


def test_density(spark):
    frame = spark.createDataFrame([("ab", 1.0), ("ab", 2.0), ("abcdef", 2.0), ("", 1.0), (None, 1.0), ("a", 0.0)], "t string, s double")
    got = frame.select(X.is_dense(F.col("t"), F.col("s") * SECOND).alias("d")).collect()
    assert [r.d for r in got] == [True, False, True, False, False, True]


def test_white_space_is_that_of_unicode(spark):
    assert column(spark, ODD, X.squeeze(F.col("v"))) == [" ".join(t.split()) for t in ODD]
    assert column(spark, ODD, X.strip(F.col("v"))) == [t.strip() for t in ODD]
    assert column(spark, ODD, X.words(F.col("v"))) == [t.split() for t in ODD]


def test_norm_tokens(spark):
    assert column(spark, ODD, X.norm_tokens(F.col("v"))) == [plain_tokens(t) for t in ODD]
    assert unicodedata.normalize("NFKC", "ﬁ") == "fi"


def test_token_case(spark):
    cases = [("мир", "UPPER_COMMA", "Мир,"), ("a", "LOWER_TIRE", "a—"), ("a", "UPPER_TIRE", "A —"), ("fOO", "UPPER_O", "Foo"), ("x", "?", "x"), ("ß", "UPPER_O", "Ss"), ("ab", "UPPER_TOTAL_QUESTIONVOSKL", "AB?!"), ("", "UPPER_PERIOD", "."), ("x", None, "x"), ("x", "LOWER_NONE", "x")]
    frame = spark.createDataFrame(cases, "token string, label string, want string")
    assert [r.got for r in frame.select(X.marked(F.col("token"), F.col("label")).alias("got")).collect()] == [c[2] for c in cases]


def test_fix_spaces(spark):
    given = ["a , b", "a —b", "a—b", "x  —  y", " a ! ", "", "one  two …"]
    assert column(spark, given, X.fix_spaces(F.col("v"))) == ["a, b", "a — b", "a—b", "x — y", "a!", "", "one two…"]


def test_split_index(spark):
    given = [*ODD, "ab cd", "abcd ef", " a", "a "]
    assert column(spark, given, X.split_index(F.col("v"))) == [half(t) for t in given]
    assert [half(t) for t in ("ab cd ef", "abcdef", "a")] == [2, -1, -1]


def test_tokens_and_chunks(spark):
    assert column(spark, ["", "abcd", "abcde"], X.token_count(F.col("v"))) == [1, 1, 2]
    frame = spark.createDataFrame([(c,) for c in "abcde"], "v string")
    assert frame.agg(X.token_count_of_parts(F.col("v"))).first()[0] == 2
    assert frame.limit(0).agg(X.token_count_of_parts(F.col("v"))).first()[0] == 1

    def plain(total, target, most):
        c = max(1, -(-total // max(1, target)))
        while total / c > most and c < total:
            c += 1
        return c

    for target, most in ((17000, 18000), (50, 20), (10, 10), (3, 1)):
        totals = [1, 2, 3, 9, 10, 11, 99, 100, 101, 17000, 17001, 40000]
        assert column(spark, totals, X.chunk_count(F.col("v"), target, most), kind="long") == [plain(t, target, most) for t in totals]


def test_recognised_and_quoted(spark):
    given = ['{"transcription":"","text":"t"}', '{"transcript":"x"}', "{}", '["a",{"text":"b"},"c"]', "plain text", ""]
    assert column(spark, given, X.recognised(F.col("v"))) == ["t", "x", "", "a b c", "plain text", ""]
    assert column(spark, ['a"b\\c\nd', "é"], X.quoted(F.col("v"))) == ['"a\\"b\\\\c\\nd"', '"é"']


def test_spaces_against_plain_rules_and_in_linear_time(spark):
    white = "[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "]"

    def plain(t):
        t = re.sub(white + "+([,.;:!?…])", r"\1", t.strip())
        t = re.sub(f"{white}+—{white}*", " — ", t)
        return re.sub(white + "{2,}", " ", t).strip()

    rng = random.Random(1)
    texts = ["".join(rng.choice("ab,.!?…— \t\n\u2003\xa0 — ,") for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [None]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.fix_spaces(F.col("t")).alias("f"), X.word_count(F.col("t")).alias("n"), X.words(F.col("t")).alias("w")).collect()
    for r in found:
        assert r.f == (r.t and plain(r.t)) if r.t is None or r.t else r.f == ""
        assert r.t is None or (r.n, r.w) == (len(r.t.split()), r.t.split())
    blanks = spark.createDataFrame([("a" + " " * 1_000_000 + ", b" + " " * 1_000_000 + "— c" + "\n" * 1_000_000,)], "t string")
    begun = time.perf_counter()
    assert blanks.select(X.fix_spaces(F.col("t"))).first()[0] == "a, b — c"
    assert time.perf_counter() - begun < 20  # seconds for a run of this many; it took hours by backing up


def test_texts_that_skip_python_are_their_own_compatibility_form():
    stable = re.compile(X.STABLE.replace("*+$", "$"))
    held = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and stable.match(chr(c))]
    assert len(held) > 20_000 and all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in held)


def test_norm_tokens_of_compatibility_characters(spark):
    texts = ["ﬁne Ⅳ x²", "e\u0301té été", "ａｂｃ １２", "plain, text!", "日本 ｶﾞ", None, ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.norm_tokens(F.col("t")).alias("w"))
    for r in frame.collect():
        assert r.w is None if r.t is None else r.w == plain_tokens(r.t)


def test_norm_text_sends_only_texts_that_may_change_to_python(spark, monkeypatch):
    """Spark called Python for every row, as it does for a call in any branch."""
    stable = re.compile(X.STABLE)

    def picky(form, text, of=unicodedata.normalize):
        if stable.match(text):
            raise AssertionError(f"sent to Python: {text}")
        return of(form, text)

    monkeypatch.setattr(X, "normalize", picky)
    texts = [*ODD, "plain  text\n only", "ﬁ" * 300_000 + " x", "мир" * 100_000, "№ ½ é", "...", None] * 3
    assert column(spark, texts, X.norm_text(F.col("v"))) == [t if t is None else " ".join(plain_tokens(t)) for t in texts]
    assert column(spark, texts, X.norm_tokens(F.col("v"))) == [t if t is None else plain_tokens(t) for t in texts]


def test_parts_of_a_batch():
    texts = ["é" * 5, None, "", "a" * 50, "b", "c" * 9, None]
    assert list(X.in_parts(pa.array(texts), 10)) == [(0, 3), (3, 1), (4, 3)]
    assert list(X.in_parts(pa.array([], pa.string()))) == []
