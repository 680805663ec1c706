"""Every registered query of the engine against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from turnweave.functions.text import MARKS
from turnweave.plans.catalogue import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(str([f"{r[k]:.9g}" if isinstance(r[k], float) else r[k] for k in order]) for r in found)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    frame = QUERIES[name](spark, SMALL)
    found = rows(frame.columns, frame.collect())
    assert found[1]
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for p in glob.glob(f"{SMALL}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        result = con.execute(ORACLE_SQL[name])
        assert found == rows([d[0] for d in result.description], result.fetchall())


def test_token_case_takes_all_words_of_the_whole_texts(spark, tmp_path):
    texts = ["Über den Fluß, señor: 12été3 x", "one ONE two-three\n日本 мир ßa", "éa 'q'", "", None, "--- 77"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = {"Über", "den", "Fluß", "señor", "été", "x", "one", "ONE", "two", "three", "日本", "мир", "éa", "q", "ßa"}
    labels = [f"{c}_{m}" for c in ("LOWER", "UPPER", "UPPER_TOTAL") for m in MARKS] + ["OTHER"]
    want = set()
    for w in words:
        label = labels[(len(w) * 5 + ord(w[0])) % len(labels)]
        form, _, mark = label.rpartition("_")
        shaped = w if form in ("", "LOWER") else w.upper() if form == "UPPER_TOTAL" else w.capitalize()
        want.add((w, label, shaped + (" " if mark == "TIRE" and form != "LOWER" else "") + MARKS.get(mark, "")))
    found = [tuple(r) for r in QUERIES["token_case"](spark, str(tmp_path)).collect()]
    assert len(found) == len(set(found)) and set(found) == want
