import random

import numpy as np
from pyspark.sql import functions as F

from turnweave.llm import pseudo
from turnweave.llm.pseudo import CLASS, EDGE, VOCABULARY, WINDOW, Network


def plain_log_prob(net, context, token):
    """One token at a time, in float64."""
    w = {k: v.astype(np.float64) for k, v in net.w.items()}
    total = w["bias"] + sum(w["places"][k] * w["vectors"][c] for k, c in enumerate(context))
    hidden = total / (1 + abs(total))
    one = hidden @ w["first"] + w["first_bias"]
    a, b = divmod(token, CLASS)
    two = (hidden + w["given"][a]) @ w["second"] + w["second_bias"][a]
    return one[a] - np.log(np.exp(one).sum()) + two[b] - np.log(np.exp(two).sum())


def test_probabilities_add_up_to_one_and_match_a_plain_loop():
    net, rng = Network(seed=3), np.random.default_rng(1)
    for k in net.w:
        net.w[k] = rng.standard_normal(net.w[k].shape).astype(np.float32) * 0.5
    context = [5, EDGE, 700, 0]
    total = sum(np.exp(plain_log_prob(net, context, t)) for t in range(VOCABULARY))
    assert abs(total - 1) < 1e-9
    stream = np.array([EDGE, EDGE, 4, 9, 1000, 0, EDGE, EDGE], np.int32)
    found = net.log_probs(stream)
    for i, t in enumerate(stream[WINDOW:-WINDOW]):
        around = [*stream[i : i + WINDOW], *stream[i + WINDOW + 1 : i + 2 * WINDOW + 1]]
        assert abs(found[i] - plain_log_prob(net, around, t)) < 1e-4


def test_gradient_matches_differences():
    net, rng = Network(seed=4), np.random.default_rng(2)
    stream = rng.integers(0, VOCABULARY, 60).astype(np.int32)
    stream[[0, 1, 20, 21, 58, 59]] = EDGE
    edges = stream[WINDOW:-WINDOW] == EDGE
    loss = lambda: -net.log_probs(stream).astype(np.float64)[~edges].mean()
    for k, g in net.gradient(stream).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, step = net.w[k][at], np.float32(1e-2)
        net.w[k][at] = old + step
        up = loss()
        net.w[k][at] = old - step
        down = loss()
        net.w[k][at] = old
        assert abs((up - down) / 0.02 - g[at]) < 2e-3 + 0.02 * abs(g[at]), k


def grammar(rng, n):
    """Sentences in which each word is known from its neighbours."""
    out = []
    while len(out) < n:
        k = rng.randrange(20)
        out += [f"the{k}", f"cat{k}", f"sat{k}", f"on{k}", f"mat{k}"]
    return out[:n]


def test_whole_query_against_a_plain_loop_and_shuffled_texts(spark):
    rng = random.Random(5)
    texts = {i: grammar(rng, 300) for i in range(120)}
    for i in range(100, 120):
        rng.shuffle(texts[i])
    rows = [(i, " \n".join(t).upper() if i % 2 else " ".join(t)) for i, t in texts.items()] + [(500, None), (501, ""), (502, " \t"), (None, "the1"), (503, "unseen"), (503, "unseen")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__ids", F.lit(1)).repartition(3)
    found = pseudo.score(docs).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert (by_id[500].n_tokens, by_id[500].log_likelihood, by_id[500].mean_log_prob) == (0, 0.0, None)
    assert by_id[502].n_tokens == 0 and by_id[None].n_tokens == 1
    kept = [by_id[i].mean_log_prob for i in range(100)]
    mixed = [by_id[i].mean_log_prob for i in range(100, 120)]
    assert min(kept) > max(mixed) + 0.5  # held apart by word order alone
    # the same from counts, numbers and weights, one token at a time
    counts = {}
    for _, t in rows:
        for w in (t or "").lower().split():
            counts[w] = counts.get(w, 0) + 1
    assert sorted(r.n for r in pseudo.word_counts(docs).collect()) == sorted(counts.values())
    top = pseudo.word_counts(docs).orderBy(F.desc("n"), "h").collect()
    tokens = pseudo._number(docs, np.array([r.h for r in top], np.int64).view(np.uint64), ["doc_id"], "text")
    net = Network.of(pseudo.train(tokens))
    row = next(r for r in tokens.collect() if r.doc_id == 7)
    ids = [EDGE] * WINDOW + np.frombuffer(row["__ids"], np.uint16).tolist() + [EDGE] * WINDOW
    total = sum(plain_log_prob(net, ids[i - WINDOW : i] + ids[i + 1 : i + 1 + WINDOW], ids[i]) for i in range(WINDOW, len(ids) - WINDOW))
    assert abs(total - by_id[7].log_likelihood) < 1e-2
    assert by_id[7].n_tokens == 300 and by_id[7].n_rare == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pseudo.score(docs).count() == 0


def test_more_digits_add_up_to_one_and_match_differences():
    net, rng = Network(seed=3, size=1500), np.random.default_rng(1)
    for k in net.w:
        net.w[k] = rng.standard_normal(net.w[k].shape).astype(np.float32) * 0.5
    assert net.levels == 3 and len(net.w["vectors"]) == 1501
    around, total = [5, 1500, 1499, 0], 0.0
    net.w["first"][:, 2:], net.w["first_bias"][2:] = 0, -30  # no number has another first digit
    net.w["second"][:, 15:], net.w["second_bias"][1, 15:] = 0, -30
    wide = np.arange(1500)
    streams = np.column_stack([np.tile(around[:2], (1500, 1)), wide, np.tile(around[2:], (1500, 1))])
    total = sum(float(np.exp(net.log_probs(s)[0])) for s in streams)
    assert 0.5 < total < 1 + 1e-4  # what is missing are numbers of a full last digit
    stream = rng.integers(0, 1501, 60).astype(np.int32)
    edges = stream[WINDOW:-WINDOW] == 1500
    loss = lambda: -net.log_probs(stream).astype(np.float64)[~edges].mean()
    for k, g in net.gradient(stream).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, step, both = net.w[k][at], np.float32(1e-2), []
        for move in (step, -step):
            net.w[k][at] = old + move
            both.append(loss())
        net.w[k][at] = old
        assert abs((both[0] - both[1]) / 0.02 - g[at]) < 2e-3 + 0.02 * abs(g[at]), k
    assert np.array_equal(Network.of(net.flat(), 1500).flat(), net.flat())


def plain_spelling(words):
    """ln p of each word, its bytes counted one at a time."""
    triples, pairs, singles = {}, {}, {}
    walk = lambda w: [(("  " + w + " ").encode("latin1")[i : i + 3]) for i in range(len(w) + 1)]
    for w in words:
        for t in walk(w):
            triples[t] = triples.get(t, 0) + 1
            pairs[t[1:]] = pairs.get(t[1:], 0) + 1
            singles[t[2]] = singles.get(t[2], 0) + 1
    of = lambda held, start: sum(n for k, n in held.items() if k[:-1] == start)

    def one(t):
        p = (singles.get(t[2], 0) + 1) / (sum(singles.values()) + 256)
        p = (pairs.get(t[1:], 0) + 32 * p) / (of(pairs, t[1:2]) + 32)
        return np.log((triples.get(t, 0) + 32 * p) / (of(triples, t[:2]) + 32))

    return {w: sum(one(t) for t in walk(w)) for w in words}


def test_vocabulary_grows_and_rare_words_cost_their_own_probability(spark):
    rng = random.Random(9)
    names = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in ("an", "en", "or") for c in "aeioubdfgklmnprstvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]
    names = sorted({n.lower() for n in names})
    names = (names + [n + "s" for n in names])[:2400]
    rows = [(i, " ".join(rng.choices(names, k=200))) for i in range(200)]
    junk = ["".join(rng.choices("qxzjv#%&~^", k=14)) for _ in range(400)]
    rows += [(1000 + i, " ".join(junk[i * 40 : i * 40 + 40])) for i in range(10)]
    rows += [(2000, "panose"), (2001, "q#x%z&j~v^qx#z"), (2002, "panose2 \n panosel")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in pseudo.score(docs).collect()}
    distinct = {w for i in range(200) for w in rows[i][1].split()}
    assert len(distinct) > VOCABULARY + 200
    assert sum(found[i].n_rare for i in range(200)) == 0  # all of them have numbers
    assert max(found[1000 + i].mean_log_prob for i in range(10)) < min(found[i].mean_log_prob for i in range(200)) - 5
    # two rare words in the same place differ by their spelling, and by that only
    rare = [w for i, t in rows[200:] for w in t.split()]
    assert all(n == 1 for n in map(rare.count, rare)) and not distinct & set(rare)
    cost = plain_spelling(rare)
    assert found[2000].n_rare == found[2001].n_rare == 1
    apart = found[2000].log_likelihood - found[2001].log_likelihood
    assert apart > 5 and abs(apart - (cost["panose"] - cost["q#x%z&j~v^qx#z"])) < 1e-3
