"""Burrows-Wheeler transforms of shards, merged by iterative interleave refinement.

A shard is a set of strings, each ended by a mark of its own below all bytes. The merge never sorts suffixes: it starts
with the shards' rows one behind the other and, round by round, deals them by the symbol before them (the last-to-first
mapping of each shard). After h rounds all rows stand in the order of their first h symbols; a border that appears between
two neighbours in round h says that they share h - 1 symbols. Rows without a border after ``depth`` rounds share at least
``depth`` symbols: these are the repeated intervals. ``Merged`` keeps all rows and their common prefixes; ``repeats`` follows
only the rows that may still be in such an interval.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


#: Symbols of 9 bits that one sort key holds.
PACKED = 7


class Shard:
    """Strings with their suffix order. ``text`` has symbols 1..256 for bytes and 0 for the mark behind each string."""

    def __init__(self, strings: Sequence[bytes]):
        lengths = np.array([len(s) for s in strings], np.int64)
        self.first = np.concatenate([[0], np.cumsum(lengths + 1)])
        marks = self.first[1:] - 1
        self.text = np.zeros(self.first[-1], np.uint16)
        inside = np.ones(len(self.text), bool)
        inside[marks] = False
        self.text[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1
        self.order = self._sorted(marks)
        self.transform = self.text[self.order - 1]
        self.transform[self.order == 0] = 0

    def _sorted(self, marks: np.ndarray) -> np.ndarray:
        """Suffix array by doubling from ``PACKED`` symbols on; marks rank by their string. Only suffixes that still tie are
        sorted again."""
        n = len(self.text)
        symbol = self.text.astype(np.int64)
        key = np.zeros(n, np.int64)
        for k in range(PACKED):  # symbols up to the mark, which ends the comparison
            key[: n - k] |= symbol[k:] << (9 * (PACKED - 1 - k))
        after = marks[np.searchsorted(marks, np.arange(n))] if n else key
        reach = after - np.arange(n)
        short = reach < PACKED
        key[short] &= -1 << (9 * (PACKED - 1 - reach[short]))
        # a suffix with its mark among the packed symbols is told apart by its string; marks are below all symbols
        order = np.argsort(key, kind="stable")
        tie = np.where(short, np.searchsorted(marks, after), 0)
        own, owner = key[order], tie[order]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])]) if n else np.zeros(0, bool)
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else order
        k = PACKED
        while True:
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, n))
            open_ = np.repeat(size > 1, size)
            if not open_.any():
                return order
            at = np.flatnonzero(open_)
            row = order[at]
            # the suffix k further on exists: rows whose mark is nearer have settled
            pair = rank[row] * n + rank[row + k]
            again = np.argsort(pair, kind="stable")
            row, pair = row[again], pair[again]
            order[at] = row
            first = np.concatenate([[True], pair[1:] != pair[:-1]])
            new[at] = first
            rank[row] = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
            k *= 2

    def back(self) -> np.ndarray:
        """For each row the row of the suffix one symbol longer (-1 at the start of a string)."""
        rows = np.argsort(self.transform, kind="stable")
        out = np.full(len(rows), -1, np.int64)
        starts = int((self.transform == 0).sum())
        marks = len(self.first) - 1
        out[rows[starts:]] = np.arange(marks, len(rows))
        return out


class Merged:
    """Rows of all shards in the order of their first ``depth`` symbols.

    ``row``: number in the concatenation of the shards' rows; ``common``: symbols shared with the row above, ``depth`` for
    that many or more.
    """

    def __init__(self, shards: Sequence[Shard], depth: int):
        base = np.concatenate([[0], np.cumsum([len(s.text) for s in shards])])
        n = int(base[-1])
        symbol = np.concatenate([s.transform for s in shards]) if shards else np.zeros(0, np.uint16)
        back = np.concatenate([np.where(b >= 0, b + o, -1) for b, o in zip((s.back() for s in shards), base, strict=False)]) if shards else np.zeros(0, np.int64)
        mark_rows = np.concatenate([np.arange(len(s.first) - 1) + o for s, o in zip(shards, base, strict=False)]) if shards else np.zeros(0, np.int64)
        m = len(mark_rows)
        row = np.arange(n)
        block = np.zeros(n, np.int32)
        self.common = np.full(n, depth, np.int32)
        border = np.zeros(n, bool)
        for h in range(1, depth + 1):
            before = symbol.take(row)
            order = np.argsort(before, kind="stable")[m:]  # rows at the start of a string have no longer suffix
            row = np.concatenate([mark_rows, back.take(row.take(order))])
            dealt, old = before.take(order), block.take(order)
            now = np.ones(n, bool)
            if n > m:
                now[m + 1 :] = (dealt[1:] != dealt[:-1]) | (old[1:] != old[:-1])
            self.common[now & ~border] = h - 1
            border = now
            block = np.cumsum(now, dtype=np.int32)
            if border.all():
                break
        self.row, self.base = row, base
        self.interval = block - 1 if n else block  # rows with equal numbers share depth symbols
        self.text_at = np.concatenate([s.order for s in shards]) if shards else np.zeros(0, np.int64)

    def places(self, shards: Sequence[Shard]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shard, string and offset of each row in merged order."""
        shard = np.searchsorted(self.base, self.row, "right") - 1
        at = self.text_at[self.row]
        string, offset = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        for k, s in enumerate(shards):
            own = shard == k
            string[own] = np.searchsorted(s.first, at[own], "right") - 1
            offset[own] = at[own] - s.first[string[own]]
        return shard, string, offset


def repeats(shards: Sequence[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The intervals of ``Merged`` with two rows or more, one behind the other: shard and place in its text of each row, and where
    each interval begins.

    A row that shares its first h symbols with no other settles there, and so does, a round later, the row of the suffix one
    symbol longer: a round works on the rows that are left, so merging costs as much as there is repetition.
    """
    base = np.concatenate([[0], np.cumsum([len(s.text) for s in shards])])
    symbol = np.concatenate([s.transform for s in shards])
    back = np.concatenate([s.back() + o for s, o in zip(shards, base, strict=False)])  # behind a symbol 0 it has no meaning
    row, block = np.arange(base[-1]), np.zeros(base[-1], np.int32)
    for _ in range(depth):
        before = symbol.take(row)
        order = np.argsort(before, kind="stable")[np.count_nonzero(before == 0) :]
        row, before, block = back.take(row.take(order)), before.take(order), block.take(order)
        new = np.ones(len(row) + 1, bool)
        new[1:-1] = (before[1:] != before[:-1]) | (block[1:] != block[:-1])
        shared = ~(new[1:] & new[:-1])
        row, block = row[shared], np.cumsum(new[:-1], dtype=np.int32)[shared]
        if not len(row):
            break
    shard = np.searchsorted(base, row, "right") - 1
    place = np.concatenate([s.order for s in shards]).take(row)
    return shard, place, np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(row) else row


def least_owner(shards: Sequence[Sequence[bytes]], owners: Sequence[np.ndarray], width: int) -> list[list[np.ndarray]]:
    """For each string of each shard, the least owner of any string that holds its ``width`` bytes, per offset."""
    built = [Shard(s) for s in shards]
    flat = [np.repeat(np.asarray(o, np.int64), np.diff(s.first)) for s, o in zip(built, owners, strict=True)]
    shard, place, first = repeats(built, width) if built else (np.zeros(0, np.int64),) * 3
    if len(first):
        held = np.empty(len(place), np.int64)
        for k, f in enumerate(flat):
            held[shard == k] = f[place[shard == k]]
        least = np.repeat(np.minimum.reduceat(held, first), np.diff(np.append(first, len(place))))
        for k, f in enumerate(flat):
            f[place[shard == k]] = least[shard == k]
    return [[f[a : max(a, b - width)] for a, b in zip(s.first[:-1], s.first[1:], strict=True)] for s, f in zip(built, flat, strict=True)]
