import random

import numpy as np

from turnweave.llm import bwt


def test_merged_order_and_common_prefixes_equal_sorting_all_suffixes():
    rng = random.Random(4)
    for depth in (1, 5, 40):
        shards = [[bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 9))] for _ in range(4)]
        shards[2].append(shards[0][0] + b"xyz" * 20)
        shards[1].append(b"xyz" * 20)
        built = [bwt.Shard(s) for s in shards]
        merged = bwt.Merged(built, depth)
        shard, string, offset = merged.places(built)
        suffix = [shards[k][i][o:] for k, i, o in zip(shard, string, offset, strict=True)]
        assert len(suffix) == sum(len(x) + 1 for s in shards for x in s)
        assert [s[:depth] for s in suffix] == sorted(s[:depth] for s in suffix)
        for i in range(1, len(suffix)):
            a, b, k = suffix[i - 1], suffix[i], 0
            while k < min(len(a), len(b), depth) and a[k] == b[k]:
                k += 1
            assert merged.common[i] == k


def test_repeats_are_the_merged_intervals_of_two_rows_or_more():
    rng = random.Random(6)
    for depth in (1, 3, 20, 50):
        word = bytes(rng.choice(b"ab\xff") for _ in range(200))
        shards = [[word[(i := rng.randrange(150)) : i + rng.randrange(90)] + bytes(rng.choice(b"ab") for _ in range(rng.randrange(5))) for _ in range(rng.randrange(9))] for _ in range(4)]
        built = [bwt.Shard(s) for s in shards]
        merged = bwt.Merged(built, depth)
        want, now = set(), []
        for n, k, i, o in zip(merged.interval.tolist(), *[x.tolist() for x in merged.places(built)], strict=True):
            if len(shards[k][i]) - o >= depth:
                now.append((n, k, int(built[k].first[i]) + o))
        for n in {x[0] for x in now}:
            group = frozenset(x[1:] for x in now if x[0] == n)
            if len(group) > 1:
                want.add(group)
        shard, place, first = bwt.repeats(built, depth)
        ends = np.append(first[1:], len(shard))
        assert {frozenset(zip(shard[a:b].tolist(), place[a:b].tolist(), strict=True)) for a, b in zip(first.tolist(), ends.tolist(), strict=True)} == want
        assert len(first) == len(want)


def test_least_owner_against_brute_force():
    rng = random.Random(5)
    word = bytes(rng.randrange(256) for _ in range(90))
    shards = [[bytes(rng.randrange(256) for _ in range(20)) + word[a:b] for a, b in [(0, 80), (5, 90), (30, 85)]], [word, b"", word[:49]], [word[10:70], b"z" * 120]]
    owners = [np.array([7, 5, 9]), np.array([6, 1, 2]), np.array([3, 8])]
    found = bwt.least_owner(shards, owners, 50)
    for k, s in enumerate(shards):
        for i, x in enumerate(s):
            want = [min(owners[q][j] for q, t in enumerate(shards) for j, y in enumerate(t) if x[o : o + 50] in y) for o in range(len(x) - 49)]
            assert found[k][i].tolist() == want
