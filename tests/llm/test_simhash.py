import random

import numpy as np
import pyarrow as pa
import xxhash

from turnweave.llm import bktree, simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    fps = {i: plain_fingerprint(t) for i, t in rows}
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (f"{fps[i]:016x}", label[i]) for i in fps}


def near(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice("xyzuvw") * 3
    return " ".join(words)


def test_whole_query_against_brute_force(spark):
    rng = random.Random(1)
    base = [rng.choice(["alpha", "Beta", "gamma", "délta", "eps"]) + str(rng.randrange(50)) for _ in range(400)]
    rows = [(i, near(rng, base, i % 4)) for i in range(40)] + [(100 + i, " ".join(rng.sample(base, 30))) for i in range(40)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "One"), (204, "one"), (205, "one two"), (206, "a b c"), (207, "a b c")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert found == plain_components(rows)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c in found.values()}


def test_links_with_small_pieces_connect_the_same(spark):
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    values = {s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for s in seeds for _ in range(15)} | {0, 1, 2**64 - 1}
    frame = spark.createDataFrame([(v - (v >> 63 << 64),) for v in values], "fp long")
    for blocks in (4, 5, 6):
        found = simhash.components(simhash.links(frame, 3, blocks=blocks, piece=5)).collect()
        roots = {r.node % 2**64: r.root for r in found}
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= 3 and a != b:
                    assert roots[a] == roots[b]
        linked = {a for a in values if any(a != b and (a ^ b).bit_count() <= 3 for b in values)}
        assert set(roots) == linked


def test_bk_trees_find_all_within_the_radius():
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, (40, 2)).astype(np.uint64)
    bit = lambda: np.uint64(1) << rng.integers(0, 64, (900, 2)).astype(np.uint64)
    values = np.unique(seeds[rng.integers(0, 40, 900)] ^ bit() ^ bit(), axis=0)
    rng.shuffle(values)
    first = np.array([0, 250, 251, len(values)])
    trees = bktree.Trees(values, first)
    roots = np.repeat(first[:-1], np.diff(first))
    all_ = bktree.distance(values[:, None], values[None])
    for radius in (0, 3, 8, 28):
        q, n, d = trees.search(values, roots, radius)
        assert set(zip(q.tolist(), n.tolist(), strict=True)) == set(zip(*[x.tolist() for x in np.nonzero((all_ <= radius) & (roots[:, None] == roots))], strict=True))
        assert (all_[q, n] == d).all()
        once = q > n
        kept = bktree.forest(len(values), q[once], n[once], d[once])
        label = list(range(len(values)))

        def root(x):
            while label[x] != x:
                x = label[x]
            return x

        least = []
        for u, v, w in sorted(zip(q[once].tolist(), n[once].tolist(), d[once].tolist(), strict=True), key=lambda e: e[2]):
            if root(u) != root(v):
                label[root(u)] = root(v)
                least.append(w)
        assert len(kept) == len(least) and d[once][kept].sum() == sum(least)
    nodes = [k for k in range(len(values)) if trees.parent[k] >= 0]
    assert all(all_[k, trees.parent[k]] == trees.edge[k] for k in nodes) and len({(trees.parent[k], trees.edge[k]) for k in nodes}) == len(nodes)


def jaccard_groups(rows, similarity=0.8, width=5):
    """Group of each row number over links of the sets of shingles."""
    sets = []
    for _, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] | sets[b])
            if not both or len(sets[a] & sets[b]) >= similarity * both - 1e-9:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    return label


def test_similar_texts_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for k in range(12):  # each with copies that differ in up to a word in thirty: similarities from 0.7 to 1
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 60, 300, 1200]))]
        rows.append((len(rows), " ".join(base)))
        for n in range(12):
            rows.append((len(rows), near(rng, base, rng.randint(0, max(1, len(base) // 30)))))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", " \n", "one", "ONE", "one two", "a b c d", "A b  c d", "a b c d e f", "x"])]
    rows += [(None, "nobody's text of six words"), (None, "nobody's text of six words"), (rows[0][0], rows[0][1]), (900, rows[1][1].upper())]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, Size int").repartition(3)
    kept = simhash.drop_similar(frame)
    assert kept.columns == frame.columns
    label = jaccard_groups(rows)
    groups = {}
    for (i, t), g in zip(rows, label, strict=True):
        groups.setdefault(g, []).append((i is None, i or 0))
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    want = sorted(min(g) for g in groups.values())
    # links are found by chance: all but a few of those near the threshold
    assert set(want) <= set(got) and len(got) <= len(want) + len(rows) // 50
    assert simhash.drop_similar(frame.limit(0)).count() == 0


def test_no_link_at_the_threshold_is_left_out(spark):
    rng = random.Random(14)
    rows = []
    for _ in range(150):  # texts of 90 shingles of which ten, at one of their ends or both, are another's: similar by 0.8 or less
        base = [f"w{rng.randrange(9000)}" for _ in range(94)]
        for n in (0, 10, 10, 5, 11):
            at = rng.choice([0, n, n // 2])
            rows.append((len(rows), " ".join([rng.choice("xyz") + str(rng.randrange(9000)) for _ in range(at)] + base[at : 94 - n + at] + [f"v{rng.randrange(9000)}" for _ in range(n - at)])))
    kept = simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    first = {}
    for (i, _), g in zip(rows, jaccard_groups(rows), strict=True):
        first.setdefault(g, i)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values())


def test_pairs_that_meet_lose_no_similar_pair(monkeypatch):
    rng = np.random.default_rng(15)
    monkeypatch.setattr(simhash, "MEET", 7)
    sets = []
    for size in (1, 2, 5, 31, 33, 70, 500):
        base = rng.integers(0, 2**63, size).astype(np.uint64)
        for _ in range(15):
            changed = base.copy()
            n = rng.integers(0, size // 8 + 1)
            changed[:n] = rng.integers(0, 2**63, n)
            sets.append(np.unique(np.concatenate([changed[rng.integers(0, size // 10 + 1) :], np.arange(3, dtype=np.uint64)])))
    size = np.array([len(s) for s in sets])
    owner, held = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
    similar = {(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(shared := np.intersect1d(sets[a], sets[b])) >= 4 * (size[a] + size[b] - len(shared))}
    parity = simhash._parities(owner, held, size).to_pylist()
    for common in (None, (np.arange(3), np.array([9, 8, 8]))):
        prefix = simhash._prefixes(owner, held, size, (4, 5), common).to_pylist()
        assert [len(x) for x in prefix] == [n - -(-4 * n // 5) + 1 for n in size]
        rows = sorted((k, a, a, int(size[a]), i) for a, x in enumerate(prefix) for i, k in enumerate(x))
        kinds = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("root", pa.int64()), ("size", pa.int32()), ("pos", pa.int32())])
        table = pa.Table.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=kinds.names).cast(kinds)
        meeting = pa.Table.from_batches(simhash._meeting(table.to_batches(max_chunksize=50))).to_pylist()
        assert max(r["p"] for r in meeting) > 1
        cells = [r | {"c0": min(r["x"], y), "c1": max(r["x"], y), "root": r["node"] % 40, "parity": parity[r["node"]]} for r in meeting for y in range(r["p"])]
        cells.sort(key=lambda r: (r["key"], r["c0"], r["c1"], r["node"]))
        types = {"size": pa.int32(), "pos": pa.int32(), "p": pa.int32(), "x": pa.int32(), "c0": pa.int32(), "c1": pa.int32(), "parity": pa.binary()}
        batches = pa.Table.from_pylist(cells, pa.schema([(c, types.get(c, pa.int64())) for c in cells[0]])).to_batches(max_chunksize=60)
        found = {(r["a"], r["b"]) for r in pa.Table.from_batches(simhash._met((4, 5), False)(batches)).to_pylist()}
        apart = {(a, b) for a, b in similar if a % 40 != b % 40}
        assert apart and apart <= found and len(found) < 2 * len(similar)
        closest = {(r["a"], r["b"]) for r in pa.Table.from_batches(simhash._met((4, 5), True)(batches)).to_pylist()}
        roots = lambda pairs: {tuple(sorted((a % 40, b % 40))) for a, b in pairs}
        assert closest <= found and roots(closest) == roots(found)


def test_a_large_group_of_near_copies_in_pieces(spark, monkeypatch):
    rng = random.Random(10)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    rows = [(k, near(rng, base, 4)) for k in range(300)] + [(1000 + k, " ".join(rng.sample(base, 50))) for k in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").cache()
    marked = simhash.shingled(frame, sets=True).cache()
    for piece, broadcast in ((40, 0), (1024, 100_000)):
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", broadcast)
        found = simhash.similar(frame, marked, piece=piece)
        roots = {r.node: r.root for r in simhash.components(found).collect()}
        assert len(set(roots.values())) == 1 and len(roots) >= 295
        sets = {r.node: set(r.shingles) for r in marked.collect()}
        assert all(5 * len(sets[r.a] & sets[r.b]) >= 4 * len(sets[r.a] | sets[r.b]) for r in found.collect())


def test_shingles_and_fingerprints_of_any_length(spark):
    texts = ["a b c d e f", "A B c d E f", "f e d c b a", "a b c d e f a b c d e", "a", "a b", None, " ", "x " * 50_000 + "y"]
    found = {r.doc_id: r for r in simhash.shingled(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), sets=True).collect()}
    assert [found[k].size for k in range(9)] == [2, 2, 2, 6, 1, 1, 0, 0, 2]
    assert found[0].node == found[1].node != found[2].node and found[6].node == found[7].node and found[4].node != found[5].node
    assert all(sorted(r.shingles) == r.shingles and len(r.shingles) == r.size for r in found.values())


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "zz yy xx ww"), (5, "a b c")], "doc_id long, text string")
    found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert found == {(None, 5), (None, None), (5, 5)}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
