"""Substring deduplication by difference-cover anchors.

With a difference cover D modulo v, any two positions i and j have a shift s < v with i+s and j+s both at cover
positions (residue in D). So windows of ``width`` words that are equal share an aligned anchor: the ``width - v + 1`` words
from a cover position on. Only anchors are hashed for all documents (|D| of v positions). An anchor that stands anywhere
else makes the windows around it candidates; these are extended to their full width, and a candidate is removed if its
whole word sequence starts anywhere else: by two 64-bit hashes of it, made of different hashes of its words. Among 10^12
windows two such pairs of random numbers agree by chance once in 10^14 runs.

Two rounds of packed records are shuffled (anchors; candidate windows), and the texts once. In either round a task sends a
value that it holds many times only twice and flags its own places itself, so a passage in a third of all documents
brings each bucket two records a chunk.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed, textbuf
from .common import ship
from .decontam import runs

PERIOD, COVER = 21, (0, 1, 4, 14, 16)
#: Text bytes per bucket of the records, and of the documents.
BUCKET_BYTES, DOCS_BYTES = 12 << 20, 8 << 20
CHUNK_BYTES = 8 << 20
_WHITE = textbuf.separators("white")
_SECOND = 0xC2B2AE3D27D4EB4F | 1


class _Words:
    """The words of a run of texts as hashes, and where each text begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.first = textbuf.words(data, offsets, _WHITE)
        self.hashes = textbuf.hashes(data, self.starts, self.ends)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)
        self.place = np.arange(len(self.starts)) - self.first[self.text]


def _anchors(w: _Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of the anchors, and their hashes."""
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    length, n = width - PERIOD + 1, w.counts[w.text]
    at = np.flatnonzero(cover[w.place % PERIOD] & (w.place + length <= n) & (n >= width))
    return at, textbuf.window_hashes(w.hashes, length, at)


def _send(h: np.ndarray, uid: np.ndarray, place: np.ndarray, buckets: int, doc_buckets: int, more: np.ndarray | None = None):
    """Kind 0: records for the bucket of their hash, with ``more`` of it if given. Kind 1: places found repeated, by the bucket of
    their document; they ride along to some bucket and pass through it."""
    once, flagged = packed.first_and_repeats(h, more)
    columns = [h // np.uint64(buckets), *([] if more is None else [more]), uid, place.astype(np.int32)]
    out = [packed.dealt((h[once] % np.uint64(buckets)).astype(np.int64), 0, *[c[once] for c in columns])]
    if len(flagged):
        out.append(_to_documents(uid[flagged], place[flagged], doc_buckets))
    return out


def _to_documents(uid: np.ndarray, place: np.ndarray, doc_buckets: int) -> pa.RecordBatch:
    owner = packed.id_bucket(uid, doc_buckets)
    return packed.dealt(owner, 1, place.astype(np.int32), uid)


def _count(doc_buckets: int, wide: bool = False):
    """Of a bucket's records those whose hash stands twice or more, by document; ``wide``: records with more of it."""

    def count(rows: pa.Table) -> pa.Table:
        kinds = rows["kind"].to_numpy()
        blobs = rows["blob"].combine_chunks()
        h, *more, uid, place = packed.unpack_all([blobs[int(i)] for i in np.flatnonzero(kinds == 0)], np.uint64, *[np.uint64] * wide, np.int64, np.int32)
        again = packed.repeated(h, *more)
        found = _to_documents(uid[again], place[again], doc_buckets)
        return pa.concat_tables([rows.filter(pa.array(kinds == 1)).cast(packed.FIELDS), pa.Table.from_batches([found])])

    return count


def _places(rows: pa.Table, uids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Word numbers (in this run) of the flagged places."""
    place, uid = packed.unpack_all(list(rows["blob"].combine_chunks()) if rows.num_rows else [], np.int32, np.int64)
    order = np.argsort(uids, kind="stable")
    at = np.searchsorted(uids[order], uid) if len(uids) else np.zeros(0, np.int64)
    known = (at < len(uids)) & (uids[order][np.minimum(at, len(uids) - 1)] == uid) if len(uids) else np.zeros(len(uid), bool)
    return first[order[at[known]]] + place[known]


def _spread(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Flags of 0..n-1 covered by any [begin, end)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0


def _sizes(docs: DataFrame) -> tuple[int, int]:
    size = int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    return max(8, -(-size // BUCKET_BYTES)), max(8, -(-size // DOCS_BYTES))


def remove_repeats(docs: DataFrame, width: int = 35, doc_id: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and with ``texts`` the kept words joined by blanks
    as ``kept``. A word is removed if a window of ``width`` words that covers it starts anywhere else in the input.

    Null and empty texts: no words. Repeated rows and rows of one doc_id are documents of their own. Empty table: none. Ids are
    whole numbers; others are an error.
    ``width`` must be at least ``PERIOD``.
    """
    if width < PERIOD:
        raise ValueError(f"width must be at least {PERIOD}")
    spark = docs.sparkSession
    ship(spark)
    rows = packed.with_uid(docs, doc_id, text)
    buckets, doc_buckets = _sizes(rows)

    def scan(batches):
        for batch in batches:
            uids = batch.column(0).to_numpy()
            data, offsets = textbuf.buffer(batch.column(1))
            for i, j in runs(offsets, CHUNK_BYTES):
                w = _Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at, h = _anchors(w, width)
                yield from _send(h, uids[i:j][w.text[at]], w.place[at], buckets, doc_buckets)

    def extend(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.RecordBatch.from_pylist([], schema=packed.FIELDS)]
        if right.num_rows:
            uids = left["uid"].to_numpy()
            data, offsets = textbuf.buffer(left["text"])
            w = _Words(data, offsets)
            at = _places(right, uids, w.first)
            owner = w.text[at]
            begin = np.maximum(w.first[owner], at - (PERIOD - 1))
            end = np.minimum(at, w.first[owner + 1] - width) + 1
            candidates = np.flatnonzero(_spread(len(w.starts), begin[end > begin], end[end > begin]))
            h = textbuf.window_hashes(w.hashes, width, candidates, _SECOND)
            more = textbuf.window_hashes(textbuf.hashes(data, w.starts, w.ends, textbuf.OTHER), width, candidates)
            out += _send(h, uids[w.text[candidates]], w.place[candidates], buckets, doc_buckets, more)
        return pa.Table.from_batches(out)

    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.string())] * texts

    def remove(key, left: pa.Table, right: pa.Table) -> pa.Table:
        data, offsets = textbuf.buffer(left["text"])
        starts, _, first = textbuf.words(data, offsets, _WHITE)
        at = _places(right, left["uid"].to_numpy(), first)
        gone = _spread(len(starts), at, at + width) if len(at) else np.zeros(len(starts), bool)
        removed = np.concatenate([[0], np.cumsum(gone)])
        n_removed = removed[first[1:]] - removed[first[:-1]]
        sha, kept = [], []
        for k in range(len(offsets) - 1):
            own = data[offsets[k] : offsets[k + 1]].tobytes().split()
            rest = b" ".join(compress(own, (~gone[first[k] : first[k + 1]]).tolist()) if n_removed[k] else own)
            sha.append(hashlib.sha256(rest).hexdigest())
            if texts:
                kept.append(rest.decode())
        return pa.Table.from_arrays([left["doc_id"], pa.array(np.diff(first)), pa.array(n_removed), pa.array(sha, pa.string()), *([pa.array(kept, pa.string())] if texts else [])], schema=pa.schema(fields))

    placed = rows.withColumn("bucket", packed.id_bucket_column(F.col("uid"), doc_buckets))  # exchanged once, used twice
    owned = placed.groupBy("bucket")
    anchors = rows.select("uid", "text").mapInArrow(scan, packed.SCHEMA).groupBy("bucket").applyInArrow(_count(doc_buckets), packed.SCHEMA)
    windows = owned.cogroup(anchors.groupBy("bucket")).applyInArrow(extend, packed.SCHEMA)
    found = windows.groupBy("bucket").applyInArrow(_count(doc_buckets, wide=True), packed.SCHEMA)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    return owned.cogroup(found.groupBy("bucket")).applyInArrow(remove, schema)
