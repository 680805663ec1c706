"""Benchmark decontamination by a stored positional inverted index.

The training documents are indexed once, whatever the benchmark: a row of the index holds the postings (ascending word
positions) of all terms of a run of documents. The rows are a table in the shared folder, dealt by document, so building
it shuffles nothing and any number of benchmarks can be searched in it.

The benchmark is the stated query set, cut into blocks of bounded size; one block at a time goes to the tasks. In each
row of the index a window starts from the postings of its rarest term there, moved back by the term's offset; what is
left is intersected with the moved postings of the next rarer term, and so on. All windows of a block go through these
steps together, as arrays; windows with a term that the row lacks drop out at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .common import materialise, ship

#: Bytes of benchmark text, and items, that one block of queries holds at most about (as arrays some 14 times the text); each
#: block is a pass over the index.
BLOCK_BYTES, BLOCK_ITEMS = 8 << 20, 100_000
_SEPARATORS = textbuf.separators("alnum")
#: Bytes of documents that a row of the index covers, so that a position takes two bytes; a longer document has a row of its own.
INDEX_BYTES = 256 << 10
#: Places that are intersected at a time.
SLAB = 1 << 20
#: Contaminated rows up to which their keys (some 50 bytes each) are broadcast to drop them.
BROADCAST_ROWS = 100_000


def runs(offsets: np.ndarray, most: int):
    """Ranges of texts of about ``most`` bytes; a longer text is a range of its own."""
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


class PositionalIndex:
    """Postings of all terms in a run of documents."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, first_word: np.ndarray):
        """``terms``: sorted hashes; ``counts``: postings of each; ``positions``: the postings, one term's behind the other's;
        ``first_word``: where each document begins, and the end."""
        self.terms, self.counts, self.positions, self.first_word = terms, counts.astype(np.int64), positions.astype(np.int64), first_word
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])
        self._held: dict[int, tuple[int, np.ndarray]] = {}

    @classmethod
    def of(cls, word_hashes: np.ndarray, first_word: np.ndarray) -> PositionalIndex:
        order = np.argsort(word_hashes, kind="stable")
        held = word_hashes[order]
        new = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(order) else order
        return cls(held[new], np.diff(np.append(new, len(order))), order, first_word)

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """Number of each term here, -1 for those that don't occur."""
        if not len(self.terms):
            return np.full(len(terms), -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def phrases(self, windows: np.ndarray, slack: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Row and start of every occurrence of ``windows``: a row of term numbers (all >= 0) each. With ``slack``, each term
        may stand up to so many words from its place by the rarest term's posting (a proximity match)."""
        frequency = self.counts[windows]
        rarity = np.argsort(frequency, axis=1, kind="stable")
        stride, keys = self._keys(slack)
        upto = np.cumsum(np.take_along_axis(frequency, rarity[:, :1], 1)[:, 0])
        rows, starts, i = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while i < len(windows):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + SLAB, "right")))
            row, start = self._intersected(windows[i:j], rarity[i:j], keys, stride, slack)
            rows.append(row + i)
            starts.append(start)
            i = j
        return np.concatenate(rows), np.concatenate(starts)

    def _keys(self, slack: int) -> tuple[int, np.ndarray]:
        """Every posting as one number: its term, then its position; ascending over the whole index."""
        if slack not in self._held:
            stride = int(self.first_word[-1]) + 2 * slack + 1
            self._held[slack] = stride, np.repeat(np.arange(len(self.terms)), self.counts) * stride + self.positions + slack
        return self._held[slack]

    def _intersected(self, windows, rarity, keys, stride, slack):
        width, every = windows.shape[1], np.arange(len(windows))
        term = windows[every, rarity[:, 0]]
        count = self.counts[term]
        rows = np.repeat(every, count)
        at = np.arange(int(count.sum())) + np.repeat(self.bounds[term] - (np.cumsum(count) - count), count)
        starts = self.positions[at] - rarity[rows, 0]
        # all terms within one document
        doc = np.searchsorted(self.first_word, starts, "right")
        inside = (starts >= 0) & (starts + width <= self.first_word[-1]) & (doc == np.searchsorted(self.first_word, starts + width - 1, "right"))
        rows, starts = rows[inside], starts[inside]
        for k in range(1, width):
            offset = rarity[rows, k]
            want = windows[rows, offset] * stride + starts + offset  # ``slack`` below the place itself
            near = keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)]
            held = (near >= want) & (near <= want + 2 * slack)
            rows, starts = rows[held], starts[held]
        return rows, starts


class Queries:
    """The distinct windows of a block of items: term numbers of each, and the items it stands in."""

    def __init__(self, items: list[tuple], width: int):
        self.names = np.array(sorted({i or "" for i, _ in items}), object)
        number = {name: k for k, name in enumerate(self.names)}
        owner = np.array([number[i or ""] for i, _ in items], np.int64)
        texts = pa.array([(t or "").encode() for _, t in items], pa.large_binary())
        data, offsets = textbuf.buffer(texts)
        data = textbuf.LOWER[data]
        starts, ends, first = textbuf.words(data, offsets, _SEPARATORS)
        self.terms, ids = np.unique(textbuf.hashes(data, starts, ends), return_inverse=True)
        counts = np.diff(first)
        #: For each length of windows: the windows, and their owners as (window, item) pairs ascending by window.
        self.windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in sorted({min(int(c), width) for c in counts} - {0}):
            chosen = np.flatnonzero(np.minimum(counts, width) == n)
            many = counts[chosen] - n + 1
            item = np.repeat(chosen, many)
            begin = first[item] + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            distinct, inverse = np.unique(ids[begin[:, None] + np.arange(n)], axis=0, return_inverse=True)
            pairs = np.unique(np.stack([inverse.ravel(), owner[item]], 1), axis=0)
            self.windows.append((distinct, np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1]))

    def search(self, index: PositionalIndex, slack: int = 0):
        """For each length of windows with an occurrence: the length, the starts, and each one's owners as (occurrence, item)."""
        known = index.numbers(self.terms)
        for windows, bounds, owners in self.windows:
            numbers = known[windows]
            alive = np.flatnonzero((numbers >= 0).all(1))
            if len(alive):
                rows, starts = index.phrases(numbers[alive], slack)
                if len(rows):
                    window = alive[rows]
                    count = np.diff(bounds)[window]
                    at = np.arange(int(count.sum())) + np.repeat(bounds[window] - (np.cumsum(count) - count), count)
                    yield windows.shape[1], starts, np.repeat(np.arange(len(starts)), count), owners[at]


def _lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def build_index(docs: DataFrame, text: str = "text", columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The index of ``docs``, a table in the shared folder: a row per run of documents with ``run``, ``docs`` (array of
    ``columns``), ``bodies`` (hashes of the whole texts), and as bytes ``first_word``, ``terms``, ``counts``, ``positions``.

    Null or empty text: a document without words. Null ids and repeated rows are documents of their own. Empty table: none.
    """
    ship(docs.sparkSession)
    body = F.col(f"`{text}`")
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.xxhash64(body).alias("body"), body.cast("binary").alias("text"))
    schema = source.select(F.lit(0).cast("long").alias("run"), F.array("doc").alias("docs"), F.array("body").alias("bodies"), *[F.lit(b"").alias(c) for c in ("first_word", "terms", "counts", "positions")]).schema

    def index(batches):
        from pyspark import TaskContext

        run = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = textbuf.buffer(batch.column(2))
            for i, j in runs(offsets, INDEX_BYTES):
                part = textbuf.LOWER[data[offsets[i] : offsets[j]]]
                starts, ends, first = textbuf.words(part, offsets[i : j + 1] - offsets[i], _SEPARATORS)
                own = PositionalIndex.of(textbuf.hashes(part, starts, ends), first)
                blobs = [first.astype(np.int64), own.terms, own.counts.astype(_kind(len(starts))), own.positions.astype(_kind(len(starts)))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([run], pa.int64()),
                        *[_lists(batch.column(k).slice(i, j - i), np.array([j - i])) for k in (0, 1)],
                        *[pa.array([b.tobytes()], pa.binary()) for b in blobs],
                    ],
                    names=["run", "docs", "bodies", "first_word", "terms", "counts", "positions"],
                )
                run += 1

    return materialise(source.mapInArrow(index, schema), "index")


def _kind(words: int) -> type:
    """What positions and counts of so many words are stored as."""
    return np.uint16 if words < 1 << 16 else np.uint32


def _indexes(batches):
    """Each row's run, documents, bodies and index."""
    for batch in batches:
        at = {n: k for k, n in enumerate(batch.schema.names)}
        for k in range(batch.num_rows):
            column = lambda n, d: np.frombuffer(batch.column(at[n])[k].as_buffer(), d)  # noqa: B023, E731
            first = column("first_word", np.int64)
            kind = _kind(int(first[-1]))
            own = PositionalIndex(column("terms", np.uint64), column("counts", kind), column("positions", kind), first)
            yield batch.column(at["run"])[k].as_py(), batch.column(at["docs"])[k].values, batch.column(at["bodies"])[k].values, own


def _blocks(benchmark: DataFrame, width: int):
    """The benchmark's blocks, one at a time as a broadcast that is destroyed once the next is asked for."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text"))
    size, count = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-int(size) // BLOCK_BYTES), -(-int(count) // BLOCK_ITEMS))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        shared = benchmark.sparkSession.sparkContext.broadcast(Queries([tuple(r) for r in items.filter(block == k).collect()], width))
        yield blocks, shared
        if blocks > 1:
            shared.destroy()


def _hits(index: DataFrame, shared, slack: int, every: bool) -> DataFrame:
    """A row per document that the block hits, or per document with ``every``: run, no, doc, body, n_words, spans (merged,
    half-open word ranges), longest (words of the longest window that hits) and items."""
    ship(index.sparkSession)
    doc, span = index.schema["docs"].dataType.elementType, "array<struct<begin:long,end:long>>"
    schema = index.select("run", F.lit(0).alias("no"), F.lit(None).cast(doc).alias("doc"), *[F.lit(0).cast("long").alias(c) for c in ("body", "n_words")], F.lit(None).cast(span).alias("spans"), F.lit(0).alias("longest"), F.array(F.lit("")).alias("items")).schema

    def search(batches):
        queries = shared.value
        for run, docs, bodies, own in _indexes(batches):
            first, n = own.first_word, len(own.first_word) - 1
            change, longest, pairs = np.zeros(int(first[-1]) + 1, np.int64), np.zeros(n, np.int32), [np.zeros((0, 2), np.int64)]
            for width, starts, at, owners in queries.search(own, slack):
                np.add.at(change, starts, 1)
                np.add.at(change, starts + width, -1)
                doc_at = np.searchsorted(first, starts, "right") - 1
                np.maximum.at(longest, doc_at, width)
                pairs.append(np.unique(np.stack([doc_at[at], owners], 1), axis=0))
            covered = np.cumsum(change[:-1]) > 0
            begins, ends = covered.copy(), covered.copy()
            begins[1:] &= ~covered[:-1]
            ends[:-1] &= ~covered[1:]
            edge = first[1:-1]
            edge = edge[(edge > 0) & (edge < first[-1])]
            begins[edge] = covered[edge]
            ends[edge - 1] = covered[edge - 1]
            begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
            owner = np.searchsorted(first, begins, "right") - 1
            pairs = np.unique(np.concatenate(pairs), axis=0)
            chosen = np.arange(n) if every else np.flatnonzero(longest)
            spans = pa.StructArray.from_arrays([pa.array(begins - first[owner]), pa.array(ends - first[owner])], names=["begin", "end"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(chosen), run), pa.int64()),
                    pa.array(chosen, pa.int32()),
                    docs.take(pa.array(chosen)),
                    bodies.take(pa.array(chosen)),
                    pa.array(np.diff(first)[chosen]),
                    _lists(spans, np.bincount(owner, minlength=n)[chosen]),
                    pa.array(longest[chosen]),
                    _lists(pa.array(queries.names[pairs[:, 1]], pa.string()), np.bincount(pairs[:, 0], minlength=n)[chosen]),
                ],
                names=["run", "no", "doc", "body", "n_words", "spans", "longest", "items"],
            )

    return index.mapInArrow(search, schema)


def _n_hit(spans: Column) -> Column:
    """Words in the union of the spans."""
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["begin"], a["upto"]))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto"))
    zero = F.lit(0).cast("long")
    return F.aggregate(F.sort_array(spans), F.struct(zero.alias("n"), zero.alias("upto")), step, lambda a: a["n"])


def search(index: DataFrame, benchmark: DataFrame, width: int = 13, slack: int = 0, every: bool = True) -> DataFrame:
    """A row per document of ``index`` (with ``every``; else per document hit): doc, body, n_words, n_hit, longest, items.

    Items: the ids, as strings, ascending, of the items of which a window of ``width`` words occurs; an item of fewer words is one
    window. A benchmark of several blocks is searched block by block, each block's hits written to the shared folder.
    """
    found = None
    for k, (blocks, shared) in enumerate(_blocks(benchmark, width)):
        hits = _hits(index, shared, slack, every and not k)
        if blocks == 1:
            return hits.select("doc", "body", "n_words", _n_hit(F.col("spans")).alias("n_hit"), "longest", F.array_sort("items").alias("items"))
        hits = materialise(hits, "hits")
        found = hits if found is None else found.unionByName(hits)
    one = found.groupBy("run", "no").agg(F.any_value("doc").alias("doc"), F.any_value("body").alias("body"), F.any_value("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.max("longest").alias("longest"), F.flatten(F.collect_list("items")).alias("items"))
    return one.select("doc", "body", "n_words", _n_hit(F.col("spans")).alias("n_hit"), "longest", F.array_sort(F.array_distinct("items")).alias("items"))


def matches(index: DataFrame, benchmark: DataFrame, width: int = 13, slack: int = 0) -> DataFrame:
    """A row per occurrence and item: ``doc`` (the indexed columns), ``item_id``, ``position`` (word number in the document, from
    0), ``n_words`` of the window and ``exact`` (false: found only within ``slack`` words of the places)."""
    ship(index.sparkSession)
    schema = index.select(F.lit(None).cast(index.schema["docs"].dataType.elementType).alias("doc"), F.lit("").alias("item_id"), F.lit(0).cast("long").alias("position"), F.lit(0).alias("n_words"), F.lit(True).alias("exact")).schema
    found = None
    for blocks, shared in _blocks(benchmark, width):

        def tell(batches, shared=shared):
            queries = shared.value
            for _, docs, _, own in _indexes(batches):
                strict = {(n, s, i) for n, starts, at, owners in queries.search(own) for s, i in zip(starts[at].tolist(), owners.tolist(), strict=True)} if slack else None
                for n, starts, at, owners in queries.search(own, slack):
                    begin = starts[at]
                    doc_at = np.searchsorted(own.first_word, begin, "right") - 1
                    exact = [(n, s, i) in strict for s, i in zip(begin.tolist(), owners.tolist(), strict=True)] if slack else np.ones(len(begin), bool)
                    yield pa.RecordBatch.from_arrays([docs.take(pa.array(doc_at)), pa.array(queries.names[owners], pa.string()), pa.array(begin - own.first_word[doc_at]), pa.array(np.full(len(begin), n), pa.int32()), pa.array(exact, pa.bool_())], names=["doc", "item_id", "position", "n_words", "exact"])

        told = index.mapInArrow(tell, schema)
        if blocks > 1:
            told = materialise(told, "matches")
        found = told if found is None else found.unionByName(told)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, slack: int = 0, share: tuple[int, int] = (1, 20), keep: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside an occurrence of a window of ``width`` benchmark words;
    shorter items are one window), n_items, items_sha256 and contaminated (``n_hit > 0`` and at least ``share`` of the
    words). With ``keep`` the columns of ``docs`` come first and clashing results get a trailing ``_``.

    Null or empty text: no words, not contaminated. Repeated items with one id count once; a null item id is named by
    the empty string. Repeated documents are rows of their own. Empty benchmark: nothing is hit.
    """
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    kept = list(docs.columns) if keep else ["doc_id"]
    taken = {c.lower() for c in kept}
    found = search(build_index(docs, columns=tuple(kept)), benchmark, width, slack)
    values = [F.col("n_words"), F.col("n_hit"), F.size("items").cast("long"), F.sha2(F.array_join("items", ",").cast("binary"), 256), _contaminated(share)]
    return found.select(*[F.col("doc")[c].alias(c) for c in kept], *[v.alias(n + "_" * (n in taken)) for n, v in zip(names, values, strict=True)])


def _contaminated(share: tuple[int, int]) -> Column:
    return (F.col("n_hit") > 0) & (share[1] * F.col("n_hit") >= share[0] * F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: tuple[int, int] = (1, 20)) -> DataFrame:
    """``docs`` without the rows that hold any window of ``width`` benchmark words, however long their text is. An item of
    fewer words, which may well stand anywhere by chance, takes a row away only where the words hit are ``share`` of it.

    The index holds ids and postings only, so what goes is found without the texts and then dropped from ``docs`` by id (null
    is one) and the whole text's hash: by a broadcast up to ``BROADCAST_ROWS`` rows, by a shuffle above. Rows without a text
    stay, empty tables stay empty, other columns are untouched.
    """
    found = search(build_index(docs), benchmark, width, every=False)
    bad = found.filter((F.col("longest") >= width) | _contaminated(share)).select(F.col("doc")["doc_id"].alias("__id"), F.col("body").alias("__body")).distinct()
    bad = materialise(bad, "contaminated")
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__id"]) & (F.xxhash64(docs["text"]) == bad["__body"]), "left_anti")
