"""SimHash near-duplicates found by BK-trees.

One tree over everything would visit a growing share of all nodes, so fingerprints are dealt to shards first, and every shard
has trees of its own (``bktree``). A shard of more than ``piece`` fingerprints is cut into pieces; each piece's tree is built
once and sent, as a row of bounded size, to the tasks that search it for the other pieces. A search returns a spanning forest
of the links it finds, the shortest first, which connects the same.

Two ways to deal: ``shard_keys`` cuts the 64 bits into blocks, of which two fingerprints within r bits agree on some choice of
``blocks - r``, so no link is missed. For similarities of word shingles the distances are too wide for that; ``sampled_keys``
then takes so many samples of bits that two texts just similar enough agree on one of them with a stated chance. Links
found so are candidates: each is held against the two texts' whole sets of shingles. What chance or the forest of candidates left
out is found by prefixes: of two similar sets, the first fifths (at 0.8) in any one order share a shingle. Pairs that meet
so and are not connected yet are held against each other, first by bounds that lose none, then by their whole sets.
"""

from __future__ import annotations

import math
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bktree, textbuf
from .common import materialise, ship
from .components import components
from .decontam import runs

#: Distinct fingerprints that one tree holds, and pairs of values of a tree that are looked at in one go.
PIECE, PAIRS = 1024, 1 << 22
#: Chance that two texts just at the similarity share a shard, and the deviations of their distance that a search takes in.
CHANCE, DEVIATIONS = 0.996, 3.5
#: Candidates' rows up to which their keys (some 40 bytes each) are broadcast to fetch their texts.
BROADCAST_ROWS = 100_000
#: Text bytes whose shingles are made at a time, and shingles whose bits are.
CHUNK_BYTES, CHUNK_SHINGLES = 1 << 20, 1 << 17
#: Texts whose shingles' counts give the prefixes' order (any order finds all; a good one lets few meet), the shingles that get a
#: place by their count at most, and rows that meet at one shingle and are compared in one go.
SAMPLE, COMMON, MEET = 8192, 1 << 16, 1 << 14
_WHITE = textbuf.separators("white")


def fingerprint(text: bytes, width: int = 3) -> int:
    """Majority bits of the shingles' hashes; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - width].tolist()]
    h = xxhash.xxh64_intdigest
    found = np.array([h(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(found), 1 << 16):
        part = found[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", width: int = 3) -> DataFrame:
    """``docs`` without its text, with the fingerprint as a signed long ``out``; null or empty text: 0."""
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c != text]
    source = docs.select(*rest, F.col(f"`{text}`").cast("binary").alias("__text"))
    schema = source.select(*rest, F.lit(0).cast("long").alias(out)).schema

    def mark(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = np.array([fingerprint(t.as_py() or b"", width) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*rest, out])

    return source.mapInArrow(mark, schema)


def blocks_for(n: int, radius: int) -> int:
    """Blocks so that a shard of evenly spread fingerprints stays under some hundred rows."""
    for blocks in range(radius + 1, radius + 4):
        if n <= 256 * 2 ** (64 * (blocks - radius) // blocks):
            break
    return blocks


def shard_keys(fp: Column, radius: int, blocks: int) -> Column:
    """The shards' keys: each choice of blocks that must agree, with its bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        keys.append(F.struct(F.lit(number).alias("t"), fp.bitwiseAND(F.lit(_signed(mask))).alias("bits")))
    return F.array(*keys)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def unlike(similarity: float) -> float:
    """Share of bits in which fingerprints of two equally large sets of that Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def sampled_keys(words: list[Column], n: int, similarity: float, seed: int = 0) -> Column:
    """Keys of shards of agreeing samples of bits, some 32 of ``n`` evenly spread fingerprints to a shard. The samples are as
    many as give two fingerprints of ``similarity`` the chance ``CHANCE`` to share one: a power of ``n`` of 0.23 at 0.8."""
    bits = min(48, max(4, round(math.log2(max(n, 1) / 32 + 1))))
    agree = (1 - unlike(similarity)) ** bits
    rng, keys = random.Random(seed), []
    for number in range(math.ceil(math.log(1 - CHANCE) / math.log1p(-agree))):
        chosen = rng.sample(range(64 * len(words)), bits)
        masks = [sum(1 << (c % 64) for c in chosen if c // 64 == k) for k in range(len(words))]
        keys.append(F.struct(F.lit(number).alias("t"), F.xxhash64(*[w.bitwiseAND(F.lit(_signed(m))) for w, m in zip(words, masks, strict=True)]).alias("bits")))
    return F.array(*keys)


_FOUND = "a long, b long, t int, bits long, x int, p int, tree binary"


def _row(a=(), b=(), t=(), bits=(), x=(), p=(), tree=()) -> pa.RecordBatch:
    """Links, or trees; the other's columns are null."""
    n = max(len(a), len(t))
    full = lambda v, kind: pa.array(v, kind) if len(v) else pa.nulls(n, kind)
    columns = [full(a, pa.int64()), full(b, pa.int64()), full(t, pa.int32()), full(bits, pa.int64()), full(x, pa.int32()), full(p, pa.int32()), full(tree, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "t", "bits", "x", "p", "tree"])


class _Shards:
    """Rows of several shards' pieces: node numbers, fingerprints, sizes, and where each piece begins."""

    def __init__(self, node: np.ndarray, values: np.ndarray, size: np.ndarray, first: np.ndarray, parent=None, edge=None):
        self.node, self.size, self.trees = node, size, bktree.Trees(values, first, parent, edge)

    def blob(self, k: int) -> bytes:
        """One piece's tree."""
        a, b = self.trees.first[k : k + 2]
        parent = np.where(self.trees.parent[a:b] >= 0, self.trees.parent[a:b] - a, -1)
        parts = [self.node[a:b], self.size[a:b], parent, self.trees.edge[a:b], self.trees.values[a:b].view(np.int64).ravel()]
        return np.concatenate([[b - a], *parts]).astype(np.int64).tobytes()

    @classmethod
    def of(cls, blob: bytes) -> _Shards:
        data = np.frombuffer(blob, np.int64)
        n = int(data[0])
        node, size, parent, edge = data[1 : 1 + 4 * n].reshape(4, n)
        return cls(node, data[1 + 4 * n :].view(np.uint64).reshape(n, -1), size, np.array([0, n]), parent, edge)

    def links(self, other: _Shards | None, radius: int, ratio: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """A forest of the links within each piece, or from the values of ``other`` to those of the one piece here. ``ratio``: least
        share of the larger size that the smaller must be."""
        mine = other is None
        queries = self if mine else other
        roots = np.repeat(self.trees.first[:-1], np.diff(self.trees.first)) if mine else np.zeros(len(other.node), np.int64)
        q, n, d = self.trees.search(queries.trees.values, roots, radius)
        x, y = queries.size[q], self.size[n]
        fits = ratio[1] * np.minimum(x, y) >= ratio[0] * np.maximum(x, y)
        if mine:
            fits &= q > n
        q, n, d = q[fits], n[fits], d[fits]
        kept = bktree.forest(len(self.node) + (0 if mine else len(other.node)), q if mine else q + len(self.node), n, d)
        return queries.node[q[kept]], self.node[n[kept]]


def _groups(batches, by: tuple[str, ...]):
    """Columns of whole groups, and where each group begins, and the end. Groups come sorted, one behind the other; the last of a
    batch waits for the next batch."""
    held = None
    for batch in batches:
        part = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        held = part if held is None else {n: np.concatenate([held[n], part[n]]) for n in part}
        new = np.zeros(len(held[by[0]]), bool)
        for n in by:
            new[1:] |= held[n][1:] != held[n][:-1]
        cuts = np.flatnonzero(new)
        if len(cuts):
            yield {n: v[: cuts[-1]] for n, v in held.items()}, np.concatenate([[0], cuts])
            held = {n: v[cuts[-1] :] for n, v in held.items()}
    if held is not None and len(held[by[0]]):
        yield held, np.array([0, len(held[by[0]])])


def _grown(words: list[str], radius: int, ratio: tuple[int, int]):
    """Trees and links of shards' pieces."""

    def grow(batches):
        for rows, first in _groups(batches, ("t", "bits", "x")):
            yield from told(rows, first)

    def told(rows, first):
        pairs = np.cumsum(np.diff(first) ** 2)
        i = 0
        while i < len(first) - 1:
            j = max(i + 1, int(np.searchsorted(pairs, (pairs[i - 1] if i else 0) + PAIRS, "right")))
            a, b = first[i], first[j]
            values = np.stack([rows[w][a:b].view(np.uint64) for w in words], 1)
            shards = _Shards(rows["node"][a:b], values, rows["size"][a:b].astype(np.int64), first[i : j + 1] - a)
            x, y = shards.links(None, radius, ratio)
            yield _row(a=x, b=y)
            many = [k for k in range(i, j) if rows["p"][first[k]] > 1]
            if many:
                at = first[many]
                yield _row(t=rows["t"][at], bits=rows["bits"][at], x=rows["x"][at], p=rows["p"][at], tree=[shards.blob(k - i) for k in many])
            i = j

    return grow


def _crossed(radius: int, ratio: tuple[int, int]):
    """Links between two pieces: the second's values are searched in the first's tree."""

    def cross(batches):
        for batch in batches:
            for tree, other in zip(*[batch.column(k) for k in range(2)], strict=True):
                a, b = _Shards.of(tree.as_buffer().to_pybytes()).links(_Shards.of(other.as_buffer().to_pybytes()), radius, ratio)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return cross


def shard_links(rows: DataFrame, words: list[str], keys: Column, radius: int, piece: int = PIECE, ratio: tuple[int, int] = (0, 1)) -> DataFrame:
    """Links (a, b) between the ``node`` numbers of ``rows`` (node, fingerprint ``words``, ``size``) that connect, within each
    shard of ``keys``, what any links of at most ``radius`` bits connect. Nodes are distinct. A shard of n values takes
    n / piece trees, each searched for n values at most. ``rows`` are read twice, so pass a table."""
    ship(rows.sparkSession)
    keyed = rows.select("node", *words, "size", F.explode(keys).alias("k")).select("k.t", "k.bits", "node", *words, "size")
    counts = keyed.groupBy("t", "bits").agg(F.count("*").alias("n")).filter("n > 1").withColumn("p", F.ceil(F.col("n") / piece).cast("int")).drop("n")
    dealt = keyed.join(counts, ["t", "bits"]).withColumn("x", F.pmod(F.xxhash64("node"), F.col("p")).cast("int"))
    shard = ["t", "bits", "x"]
    grown = materialise(dealt.repartition(*shard).sortWithinPartitions(*shard, "node").mapInArrow(_grown(words, radius, ratio), _FOUND), "trees")
    trees = grown.filter("tree IS NOT NULL").select("t", "bits", "x", "p", "tree")
    sent = trees.filter("x < p - 1").select("t", "bits", "tree", F.explode(F.sequence(F.col("x") + 1, F.col("p") - 1)).alias("x"))
    pairs = sent.join(trees.select(*shard, F.col("tree").alias("other")), shard).select("tree", "other")
    across = pairs.mapInArrow(_crossed(radius, ratio), "a long, b long")
    return grown.filter("a IS NOT NULL").select("a", "b").unionByName(across).distinct()


def links(values: DataFrame, radius: int = 3, blocks: int | None = None, piece: int = PIECE) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of column ``fp`` that connect what any two within ``radius`` bits
    connect."""
    blocks = blocks or blocks_for(values.count(), radius)
    return shard_links(values.select(F.col("fp").alias("node"), "fp", F.lit(1).alias("size")), ["fp"], shard_keys(F.col("fp"), radius, blocks), radius, piece)


def _clusters(docs: DataFrame, doc_id: str, text: str, radius: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, body: a hash of the whole text, fp), and for each fp its component's root and smallest doc_id."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("body"), F.col(f"`{text}`").alias("text"))
    marked = materialise(fingerprints(rows, width=width), "fingerprints")
    values = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = materialise(components(links(values, radius)), "roots")
    owned = values.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = owned.join(roots.select(F.col("node").alias("fp")), "fp", "left_semi")
    ids = linked.groupBy("root").agg(F.min("least").alias("linked_id"))
    return marked, materialise(owned.join(ids, "root", "left").select("fp", "root", F.coalesce("linked_id", "least").alias("component_id")), "named")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3, width: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over
    links of at most ``radius`` bits.

    Null or empty texts have fingerprint 0 and link like others. A null doc_id is never the smallest; a component of
    such alone has a null id. Repeated rows stay. Empty table: no rows.
    """
    marked, named = _clusters(docs, doc_id, text, radius, width)
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, sets: bool = False, similarity: tuple[int, int] = (4, 5), common: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Per document: doc_id, ``body`` (hash of the whole text), ``node`` (hash of its set of shingles), the fingerprint of 128 bits
    as ``fp0, fp1``, ``size`` of the set, ``prefix`` (those of the set's shingles that one similar set must share at least one of,
    first of them those not ``common``), ``parity`` (a bit for some shingles each, set if it has an odd number of them) and, with
    ``sets``, the set itself as ``shingles``, ascending 64-bit hashes.

    Shingles are runs of ``width`` words, A-Z lower-cased, each counted once; a text of fewer words is one shingle, one without
    words has none. Null texts have no words.
    """
    ship(docs.sparkSession)
    body = F.col(f"`{text}`")
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(body).alias("body"), body.cast("binary").alias("__text"))
    schema = source.select("doc_id", "body", *[F.lit(0).cast("long").alias(c) for c in ("node", "fp0", "fp1")], F.lit(0).alias("size"), F.array(F.lit(0).cast("long")).alias("prefix"), F.lit(b"").alias("parity"), *[F.array(F.lit(0).cast("long")).alias("shingles")] * sets).schema
    names = schema.fieldNames()

    def mark(batches):
        for batch in batches:
            data, offsets = textbuf.buffer(batch.column(2))
            for i, j in runs(offsets, CHUNK_BYTES):
                owner, held = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                size = np.bincount(owner, minlength=j - i)
                node, full = np.zeros(j - i, np.uint64), size > 0
                if full.any():
                    node[full] = np.add.reduceat(textbuf.mixed(held ^ np.uint64(_SALT[2])), (np.cumsum(size) - size)[full])
                fp = _majority(owner, held, size)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(k).slice(i, j - i) for k in (0, 1)],
                        *[pa.array(x.view(np.int64)) for x in (textbuf.mixed(node), np.ascontiguousarray(fp[:, 0]), np.ascontiguousarray(fp[:, 1]))],
                        pa.array(size, pa.int32()),
                        _prefixes(owner, held, size, similarity, common),
                        _parities(owner, held, size),
                        *([pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(held.view(np.int64)))] if sets else []),
                    ],
                    names=names,
                )

    return source.mapInArrow(mark, schema)


_SALT = (0x9E6C63D0A95B3F1D, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each text's distinct shingles, ascending by both."""
    data = textbuf.LOWER[data]
    starts, ends, first = textbuf.words(data, offsets, _WHITE)
    h, counts = textbuf.hashes(data, starts, ends), np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    whole = np.flatnonzero(np.arange(len(h)) + width <= first[1:][text])
    owner, found = [text[whole]], [textbuf.window_hashes(h, width, whole)]
    for n in range(1, width):
        short = np.flatnonzero(counts == n)
        owner.append(short)
        found.append(textbuf.window_hashes(h, n, first[short]))
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.lexsort((found.view(np.int64), owner))
    owner, found = owner[order], found[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    return owner[new], found[new]


def _majority(owner: np.ndarray, held: np.ndarray, size: np.ndarray) -> np.ndarray:
    """128 bits per text, each set where it is in over half of the text's shingles."""
    ones = np.zeros((len(size), 128), np.int64)
    for a in range(0, len(held), CHUNK_SHINGLES):
        part, own = held[a : a + CHUNK_SHINGLES], owner[a : a + CHUNK_SHINGLES]
        bits = np.stack([textbuf.mixed(part ^ np.uint64(_SALT[k])) for k in range(2)], 1).astype("<u8").view(np.uint8)
        # added up as bytes, eight in a number, so by 255 at most
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        cuts = np.flatnonzero((np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))) % 255 == 0)
        sums = np.add.reduceat(np.unpackbits(bits, axis=1, bitorder="little").view(np.uint64), cuts, axis=0).view(np.uint8).astype(np.int64)
        ones[own[starts]] += np.add.reduceat(sums, np.searchsorted(cuts, starts), axis=0)
    return np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view("<u8").astype(np.uint64)


def _prefixes(owner: np.ndarray, held: np.ndarray, size: np.ndarray, similarity: tuple[int, int], common: tuple[np.ndarray, np.ndarray] | None) -> pa.Array:
    """Of each set the first ``size - ceil(similarity * size) + 1`` shingles: common ones come last by their counts, else the hash
    decides. Similar sets share that share of the larger, so the first shingle that both have stands in both beginnings."""
    held = held.view(np.int64)
    if common is not None and len(common[0]):
        at = np.minimum(np.searchsorted(common[0], held), len(common[0]) - 1)
        held = held[np.lexsort((np.where(common[0][at] == held, common[1][at], 0), owner))]
    length = np.where(size > 0, size + (-similarity[0] * size) // similarity[1] + 1, 0)
    taken = np.arange(len(held)) - np.repeat(np.cumsum(size) - size, size) < np.repeat(length, size)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(held[taken]))


def _parities(owner: np.ndarray, held: np.ndarray, size: np.ndarray) -> pa.Array:
    """Of each set a power of two of bits, at least twice its size and 64. Two sets differ in as many shingles as bits at least;
    the halves of a longer one, by exclusive or, are the one of half the length."""
    words = 1 << np.ceil(np.log2(np.maximum(size, 32) / 32)).astype(np.int64)
    begin = np.cumsum(words) - words
    bits = np.zeros(int(words.sum()), np.uint64)
    bit = held & (64 * words[owner] - 1).astype(np.uint64)
    np.bitwise_xor.at(bits, begin[owner] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    offsets = np.concatenate([[0], np.cumsum(8 * words)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(bits.astype("<u8"))])


def _differing(parity: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which the parities numbered ``a`` and ``b`` differ, the longer folded to the shorter's length."""
    out = np.empty(len(a), np.int64)
    if not len(a):
        return out
    words = np.array([len(x) // 8 for x in parity], np.int64)
    least = np.minimum(words[a], words[b])
    for width in np.unique(least).tolist():
        pairs = np.flatnonzero(least == width)
        used = np.unique(np.concatenate([a[pairs], b[pairs]]))
        folded = np.empty((len(used), width), np.uint64)
        for long in np.unique(words[used]).tolist():
            those = np.flatnonzero(words[used] == long)
            part = np.frombuffer(b"".join(parity[used[those]]), "<u8").reshape(-1, long)
            while part.shape[1] > width:
                half = part.shape[1] // 2
                part = part[:, :half] ^ part[:, half:]
            folded[those] = part
        step = max(1, PAIRS // 2 // width)
        for i in range(0, len(pairs), step):
            now = pairs[i : i + step]
            out[now] = bktree.distance(folded[np.searchsorted(used, a[now])], folded[np.searchsorted(used, b[now])])
    return out


def _common(docs: DataFrame, doc_id: str, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand in many of about ``SAMPLE`` texts, ascending, and in how many; at most ``COMMON``."""
    every = max(1, docs.count() // SAMPLE)
    texts = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).filter(F.pmod(F.xxhash64(F.col(f"`{text}`")), F.lit(every)) == 0).dropDuplicates([text])
    some = shingled(texts, doc_id, text, width, sets=True)
    some = materialise(some.select("size", "shingles"), "sample")
    least = max(8, (some.agg(F.sum("size").cast("long")).first()[0] or 0) // COMMON + 1)
    found = some.select(F.explode("shingles").alias("h")).groupBy("h").count().filter(F.col("count") >= least).toArrow()
    h, n = (found.column(k).to_numpy() for k in range(2))
    order = np.argsort(h)
    return h[order], n[order]


_MEETING = "key long, node long, size int, pos int, p int, x int"


def _meeting(batches):
    """Of rows sorted by key, those of keys that hold more than one root, with the number of their piece ``x`` of ``p``."""
    for rows, first in _groups(batches, ("key",)):
        n = np.diff(first)
        many = np.repeat(np.minimum.reduceat(rows["root"], first[:-1]) < np.maximum.reduceat(rows["root"], first[:-1]), n)
        p = np.repeat(-(-n // MEET), n)
        x = (np.arange(len(p)) - np.repeat(first[:-1], n)) % p
        columns = [rows["key"], rows["node"], rows["size"], rows["pos"], p.astype(np.int32), x.astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c[many]) for c in columns], names=["key", "node", "size", "pos", "p", "x"])


def _met(similarity: tuple[int, int], best: bool):
    """Pairs of nodes of different roots that meet at a key and that no bound rules out: not their sizes, not what can follow the
    first common shingle, not their parities. ``best``: of the pairs of two roots that are looked at in one go, the closest."""
    p, q = similarity

    def find(batches):
        for rows, first in _groups(batches, ("key", "c0", "c1")):
            n = np.diff(first)
            size, after, root, x = rows["size"].astype(np.int64), (rows["size"] - rows["pos"]).astype(np.int64), rows["root"], rows["x"]
            across = rows["c0"] != rows["c1"]
            later = np.repeat(first[1:], n) - np.arange(first[-1]) - 1
            total = np.cumsum(later)
            i = 0
            while i < len(later):
                j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS // 4, "right")))
                a = np.repeat(np.arange(i, j), later[i:j])
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later[i:j]) - later[i:j], later[i:j])
                i = j
                fits = (root[a] != root[b]) & (~across[a] | (x[a] != x[b]))
                fits &= q * np.minimum(size[a], size[b]) >= p * np.maximum(size[a], size[b])
                fits &= (p + q) * np.minimum(after[a], after[b]) >= p * (size[a] + size[b])
                a, b = a[fits], b[fits]
                differ, both = _differing(rows["parity"], a, b), size[a] + size[b]
                fits = (p + q) * differ <= (q - p) * both
                a, b, far = a[fits], b[fits], (differ / both)[fits]
                if best and len(a):
                    low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
                    order = np.lexsort((far, high, low))
                    new = np.ones(len(order), bool)
                    new[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
                    a, b = a[order[new]], b[order[new]]
                u, v = rows["node"][a], rows["node"][b]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["a", "b"])

    return find


def _key(doc_id: Column) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("k"), doc_id.cast("string")), F.lit("n"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.withColumns({"__key": _key(F.col(f"`{doc_id}`")), "__body": F.xxhash64(F.col(f"`{text}`"))})


def similar(docs: DataFrame, marked: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: tuple[int, int] = (4, 5), width: int = 5, piece: int = PIECE, seed: int = 0) -> DataFrame:
    """Links (a, b) between the nodes of ``marked`` (``shingled`` rows of ``docs`` of one ``similarity`` and order, a table) whose
    sets have at least that Jaccard similarity; they connect all that any such links connect.

    Candidates by fingerprints connect most of it. Then nodes of different components that share a shingle of their prefixes are
    compared: first the closest pair of two components, then, of components still apart, every pair."""
    share = similarity[0] / similarity[1]
    nodes = materialise(marked.groupBy("node").agg(*[F.any_value(c).alias(c) for c in ("fp0", "fp1", "size", "prefix", "parity")]).filter("size > 0"), "nodes")
    mean = 128 * unlike(share)
    radius = math.floor(mean + DEVIATIONS * math.sqrt(mean * (1 - unlike(share))))
    words = ["fp0", "fp1"]
    candidates = materialise(shard_links(nodes, words, sampled_keys([F.col(w) for w in words], nodes.count(), share, seed), radius, piece, similarity), "candidates")
    links = materialise(_verified(docs, marked, candidates, doc_id, text, similarity, width), "verified")
    roots = materialise(components(links), "roots")
    rooted = lambda rows: rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    entries = rooted(nodes.select("node", "size", "prefix")).select("node", "root", "size", F.posexplode("prefix").alias("pos", "key"))
    shared = materialise(entries.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_meeting, _MEETING), "meeting")
    cell = ["key", "c0", "c1"]
    for best in (True, False):
        rows = rooted(shared.join(nodes.select("node", "parity"), "node")).withColumn("y", F.explode(F.expr("sequence(0, p - 1)")))
        rows = rows.select("key", F.least("x", "y").alias("c0"), F.greatest("x", "y").alias("c1"), "node", "root", "size", "pos", "x", "parity")
        pairs = rows.repartition(*cell).sortWithinPartitions(*cell, "node").mapInArrow(_met(similarity, best), "a long, b long")
        met = materialise(pairs.distinct(), "met")
        links = links.unionByName(materialise(_verified(docs, marked, met, doc_id, text, similarity, width), "verified"))
        if best:
            roots = materialise(components(links), "roots")
    return links


def _verified(docs: DataFrame, marked: DataFrame, candidates: DataFrame, doc_id: str, text: str, similarity: tuple[int, int], width: int) -> DataFrame:
    """Those of the candidates (a table) whose whole sets, of one text of each node in question, are similar."""
    wanted = candidates.select(F.col("a").alias("node")).unionByName(candidates.select(F.col("b").alias("node"))).distinct()
    one = marked.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct(_key(F.col("doc_id")).alias("key"), "body")).alias("o"))
    one = materialise(one.select(F.col("o.key").alias("__key"), F.col("o.body").alias("__body")), "wanted")
    texts = _keyed(docs, doc_id, text).join(F.broadcast(one) if one.count() <= BROADCAST_ROWS else one, ["__key", "__body"], "left_semi")
    sets = shingled(texts.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), doc_id, text, width, sets=True)
    sets = materialise(sets.select("node", "shingles").dropDuplicates(["node"]), "sets")
    own = lambda side: sets.select(F.col("node").alias(side), F.col("shingles").alias(f"of_{side}"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    both = F.size("of_a") + F.size("of_b") - shared
    return candidates.join(own("a"), "a").join(own("b"), "b").filter(similarity[1] * shared >= similarity[0] * both).select("a", "b")


def _kept(docs: DataFrame, doc_id: str, text: str, marked: DataFrame, roots: DataFrame) -> DataFrame:
    """``docs`` with one row of each root's: of the smallest doc_id, null ids last. ``marked``: doc_id, body, node; ``roots``: node,
    root for nodes that are linked."""
    rooted = marked.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")).alias("f"))
    first = first.select(_key(F.col("f.doc_id")).alias("__key"), F.col("f.body").alias("__body"))
    kept = _keyed(docs, doc_id, text).join(first, ["__key", "__body"], "left_semi")
    if not marked.groupBy("doc_id", "body").count().filter("count > 1").isEmpty():  # rows that repeat whole
        kept = kept.dropDuplicates(["__key", "__body"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3, width: int = 3) -> DataFrame:
    """``docs`` with one row of each component of ``near_duplicates``: that of the smallest doc_id, null ids last; of several such
    rows, one.

    The texts are shuffled once, by a key that is never null; repeated rows are dropped in the same partitioning.
    """
    marked, named = _clusters(docs, doc_id, text, radius, width)
    return _kept(docs, doc_id, text, marked.withColumnRenamed("fp", "node"), named.select(F.col("fp").alias("node"), "root"))


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: tuple[int, int] = (4, 5), width: int = 5) -> DataFrame:
    """``docs`` with one row of each group of texts linked by a Jaccard similarity of at least ``similarity`` of their sets of
    ``width``-word shingles: the row of the smallest doc_id, null ids last; of several such rows, one.

    Texts of one set, exact copies among them, are one node; texts without words are one too. No link is taken unverified and none
    is left out. Repeated rows are copies. Empty table: no rows. ``docs`` is read seven times, so pass a table; the texts are
    shuffled once, and once more for each of three rounds of candidates that are more than a broadcast of their keys takes.
    """
    marked = materialise(shingled(docs, doc_id, text, width, similarity=similarity, common=_common(docs, doc_id, text, width)), "shingled")
    roots = materialise(components(similar(docs, marked, doc_id, text, similarity, width)), "roots")
    return _kept(docs, doc_id, text, marked.select("doc_id", "body", "node"), roots)
