import difflib
import os
import re
import unicodedata

import pytest

from turnweave.model import SECOND
from turnweave.operators.overlap import drop_overlaps, without_overlap
from turnweave.plans.catalogue import QUERIES
from turnweave.session import table

SMALL = "/root/testdata/sf0.001"
FIRST = "a b c d e f g h i j k l m n o p"


def run(spark, *texts, seconds=2):
    rows = [("r", i, i * seconds * SECOND, (i + 1) * seconds * SECOND, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "k string, seg_no int, start_us long, end_us long, text string")
    return [(r.text, r.accepted) for r in drop_overlaps(frame, ["k"]).orderBy("seg_no").collect()]


def test_golden(spark):
    assert run(spark, FIRST, FIRST + " q r") == [(FIRST, True), ("q r", True)]
    assert run(spark, FIRST, FIRST + " q r", seconds=10) == [(FIRST, True), ("", False)]
    assert run(spark, FIRST, FIRST) == [(FIRST, True), ("", False)]
    assert run(spark, FIRST, "other words", None, FIRST) == [(FIRST, True), ("other words", True), ("", False), (FIRST, True)]


def test_words_are_cut_as_written():
    tail = " ".join(f"w{i}" for i in range(16))
    assert without_overlap(tail, tail.replace("w1 ", "w1, ") + " - next, please") == "- next, please"
    assert without_overlap(tail, "x-" + tail) == "w15"  # alike enough; x and w0 are two words as written
    hyphens = " ".join(f"a-{i}" for i in range(16))
    assert without_overlap(hyphens, hyphens + " end").endswith("end")
    assert without_overlap("", tail) == tail and without_overlap(tail, "") == ""


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")
def test_whole_query_against_a_plain_loop(spark):
    """Each turn begins with the last turn's last words; what the tail already holds goes, sparse rests are emptied."""
    found = {(r.conv_id, r.seg_no): (r.text, r.accepted) for r in QUERIES["dedup_tail"](spark, SMALL).collect()}
    said: dict = {}
    for r in table(spark, SMALL, "conversations").collect():
        said.setdefault(r.conv_id, []).append((r.turn + 1, r.text or ""))
    tokens = lambda t: re.sub(r"[^\w\s]", "", unicodedata.normalize("NFKC", t)).lower().split()
    n = 0
    for conv, turns in said.items():
        before, tail = "", ""
        for index, text in sorted(turns):
            row = (" ".join(before.split()[-20:]) + " " + text).strip(" ")
            before = text
            old, new, rest = tokens(tail), tokens(row), row
            for k in range(min(len(old), len(new), 200), 15, -1):
                if difflib.SequenceMatcher(None, old[-k:], new[:k]).ratio() >= 0.9:
                    ends = [m.end() for m in re.finditer(r"\w+\b", row)]
                    rest = row[ends[k - 1] :].lstrip() if k < len(ends) else ""
                    break
            ok = bool(rest) and (len(rest.split()) >= 20 or len(rest) >= 60)  # a segment lasts 20 s
            if ok:
                tail = (tail + rest)[-160:]
            assert found[conv, index] == (rest if ok else "", ok)
            n += 1
    assert n == len(found) > 50
