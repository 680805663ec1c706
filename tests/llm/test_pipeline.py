"""Each stage of the pipeline, on what the one before it kept, against brute force."""

import random

import corpus_pipeline
from test_decontam import leaks
from test_mixing import plain_mix
from test_quality import plain_measure
from test_sharding import plain_shard
from test_simhash import jaccard_groups

from turnweave.llm.common import made


def make(spark, folder):
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice("abcdefghijklm") * rng.randint(1, 4) + str(rng.randrange(40)) for _ in range(n))
    items = [(i, say(20)) for i in range(5)]
    texts = [say(rng.randint(15, 60)) for _ in range(80)]
    docs = [(i, t) for i, t in enumerate(texts)]
    docs += [(100 + i, texts[i]) for i in range(20)]  # exact copies
    docs += [(200 + i, items[i][1] + " " + say(10)) for i in range(5)]  # leaks
    docs += [(210 + i, say(1500) + " " + items[i][1] + " " + say(40 * i)) for i in range(5)]  # leaks in long documents
    docs += [(300, None), (301, ""), (302, "short"), (303, "x y z a b " * 30), (None, say(30)), (None, say(30)), (None, None)]
    docs = [(i, t, rng.choice(["en", None]), rng.choice(["s0", "s1", "s1", None]), len(t or "")) for i, t in docs]
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", items, "item_id long, text string"), ("labels", [(1, 1, 0)], "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return docs, items


def test_stage_by_stage(spark, tmp_path):
    docs, items = make(spark, tmp_path)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = frame.columns, [frame]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept[-1], str(tmp_path))
        assert k == 4 or out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
    rows = [sorted(((r.doc_id, r.text, r.source) for r in f.collect()), key=str) for f in kept]
    good = sorted(((i, t, s) for i, t, _, s, _ in docs if not plain_measure(t)[6]), key=str)
    assert rows[1] == good  # one label certifies no cutoff: the base rules alone decide
    groups = {}
    for g, row in zip(jaccard_groups([(i, t) for i, t, _ in good]), good, strict=True):
        groups.setdefault(g, []).append(row)
    firsts = sorted((min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()), key=str)
    assert [str(r[0]) for r in rows[2]] == [str(r[0]) for r in firsts] and len(rows[2]) < len(rows[1])
    assert rows[3] == [r for r in rows[2] if not leaks(r[1], items)] and len(rows[3]) < len(rows[2])
    want = {}
    for i, size, _, _, taken in plain_mix(rows[3]):
        want[i] = want.get(i, 0) + (taken > 0) + (taken > size)
    got = {}
    for i, _, _ in rows[4]:
        got[str(i)] = got.get(str(i), 0) + 1
    assert got == {k: v for k, v in want.items() if v}
    assert [r[:3] for r in rows[5]] == rows[4] and all(r.shard == plain_shard(r.doc_id, [1] * 16) for r in kept[5].collect())
    assert sorted(str(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(str(r) for r in kept[5].collect())


def test_empty_tables(spark, tmp_path):
    make(spark, tmp_path / "full")
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{tmp_path}/full/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_tables_of_earlier_stages_are_removed(spark, tmp_path):
    make(spark, tmp_path)
    before = set(made())
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0  # what the result reads is there
    left = [p for p in made() if p not in before]
    assert [p.rsplit("/", 1)[1][:16] for p in left if "/stage-" in p] == ["stage-source-mix"] and len(left) < 4
