"""Byte-level deduplication: repeated intervals of merged Burrows-Wheeler transforms.

Every window of ``width`` bytes is routed by its minimizer, the least hash of the ``GRAM``-byte grams in it: equal windows
have equal minimizers. A maximal run of windows of one minimizer is a piece. Minimizers that stand once in all documents
are dropped; of the other pieces each bucket of documents sends the bytes, once, and the least document that has them, and they
meet by minimizer. If all pieces of a minimizer are the same bytes, their
windows repeat as a whole. Else the distinct pieces go into shards by the documents they come from; the shards'
transforms are merged and their intervals of ``width`` common bytes give each window its least document. Where one
minimizer's pieces are too many to merge at once, longer grams cut them again.

The buckets of documents are told the least document of their pieces' windows, and find the places themselves. A passage in a
third of all documents so brings its minimizer a record for each bucket of documents, not for each document.

Shuffled are the minimizers (some 7 bytes of hash, id and place each), the texts once, and the pieces that may repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bwt, packed, textbuf
from .anchors import _count, _places, _send, _sizes
from .common import materialise, ship
from .decontam import runs

GRAM = 26
CHUNK_BYTES = 4 << 20
#: Bytes of pieces whose transforms are merged at a time. A minimizer with more of them is cut by longer grams first.
MERGE_BYTES = 128 << 10
FINER = 12
SHARDS = 4
_BASE = 0xA0761D6478BD642F
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = 1 << 18
_LAST = np.iinfo(np.int64).max
#: Kinds of rows for a bucket of documents: places that may repeat are 1, answers from bucket k of the minimizers are this and k more.
_ANSWER = 2


def _table(width: int) -> tuple[np.ndarray, np.ndarray]:
    n = _STEP + width + 1
    return textbuf.powers(_BASE, n), textbuf.powers(_INVERSE, n)


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each ``n`` consecutive values."""
    span = 1
    while span * 2 <= n:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (n - span)], x[n - span :]) if n > span else x


def pieces(data: np.ndarray, offsets: np.ndarray, width: int, table, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, first window and number of windows of each piece. Windows never cross texts; a text of any size is read in
    steps, and a piece goes on over the end of a step."""
    up, down = table
    out_h, out_at = [], []
    last = None
    n_windows = max(0, len(data) - width + 1)
    for low in range(0, n_windows, _STEP):
        m = min(_STEP, n_windows - low)
        part = data[low : low + m + width - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(textbuf.BYTE[part] * up[: len(part)], out=sums[1:])
        k = len(part) - gram + 1
        h = textbuf.mixed((sums[gram:] - sums[:-gram]) * down[:k])
        least = _least(h, width - gram + 1)
        new = np.empty(m, bool)
        new[1:] = least[1:] != least[:-1]
        new[0] = last is None or least[0] != last
        last = least[-1]
        at = np.flatnonzero(new)
        out_h.append(least[at])
        out_at.append(at + low)
    if not out_at:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    h, at = np.concatenate(out_h), np.concatenate(out_at)
    # cut at the texts' borders: windows from offsets[t] on to offsets[t + 1] - width are those of text t
    begins = offsets[:-1][np.diff(offsets) >= width]
    ends = (offsets[1:] - width + 1)[np.diff(offsets) >= width]
    cuts = np.concatenate([begins, ends[ends < n_windows]])
    owner = np.searchsorted(at, cuts, "right") - 1
    at, h = np.concatenate([at, cuts]), np.concatenate([h, h[owner]])
    order = np.argsort(at, kind="stable")
    at, h = at[order], h[order]
    keep = np.concatenate([at[1:] != at[:-1], [True]])
    at, h = at[keep], h[keep]
    count = np.diff(np.concatenate([at, [n_windows]]))
    text = np.searchsorted(begins, at, "right") - 1
    inside = (text >= 0) & (at < ends[np.maximum(text, 0)]) if len(begins) else np.zeros(len(at), bool)
    return h[inside], at[inside], count[inside]


class _Pieces:
    """The distinct pieces that may repeat in a bucket of documents, in the order of their minimizers and bytes, and where they
    stand: ``of`` has the piece of each occurrence, ``doc`` and ``start`` its text and first byte there."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, flagged: np.ndarray, owners: np.ndarray, width: int):
        h, at, count = pieces(data if len(flagged) else data[:0], offsets, width, _table(width))
        chosen = np.searchsorted(at, flagged)
        chosen = chosen[at[np.minimum(chosen, len(at) - 1)] == flagged] if len(at) else chosen[:0]
        h, at, count = h[chosen], at[chosen], count[chosen]
        raw = data.tobytes()
        number: dict[bytes, int] = {}  # equal bytes have one minimizer
        which = np.array([number.setdefault(raw[a : a + n], len(number)) for a, n in zip(at.tolist(), (count + width - 1).tolist(), strict=True)], np.int64)
        own = np.empty(len(number), np.uint64)
        own[which] = h
        texts = list(number)
        order = np.argsort(own, kind="stable")
        same = np.flatnonzero(own[order][1:] == own[order][:-1])
        for run in np.split(same, np.flatnonzero(np.diff(same) > 1) + 1) if len(same) else []:
            order[run[0] : run[-1] + 2] = sorted(order[run[0] : run[-1] + 2].tolist(), key=texts.__getitem__)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        places = np.argsort(rank[which], kind="stable")
        self.of = rank[which][places]
        self.doc = np.searchsorted(offsets, at[places], "right") - 1
        self.start, self.owner = at[places] - offsets[self.doc], owners[self.doc]
        self.h, self.texts = own[order], [texts[k] for k in order.tolist()]
        self.least = np.minimum.reduceat(self.owner, np.searchsorted(self.of, np.arange(len(order)))) if len(order) else np.zeros(0, np.int64)


def _blob(h: np.ndarray, least: np.ndarray, texts: list[bytes]) -> bytes:
    text = b"".join(texts)
    head = packed.pack(h, least, np.array([len(t) for t in texts], np.int32))
    return b"".join([len(head).to_bytes(4, "little"), len(text).to_bytes(4, "little"), head, pa.compress(text, codec="zstd", asbytes=True) if text else b""])


def _unblob(blob: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    n, size = (int.from_bytes(blob[i : i + 4], "little") for i in (0, 4))
    h, least, length = packed.unpack(blob[8 : 8 + n], np.uint64, np.int64, np.int32)
    text = pa.decompress(blob[8 + n :], size, codec="zstd", asbytes=True) if size else b""
    ends = np.cumsum(length).tolist()
    return h, least, [text[e - k : e] for e, k in zip(ends, length.tolist(), strict=True)]


def _finer(texts: list[bytes], least: np.ndarray, source: np.ndarray, width: int, gram: int) -> list[np.ndarray]:
    """The least owner of each window of pieces that are too many to merge at once: the pieces are cut again, by the minimizers of
    longer grams. Grams as long as a window leave equal windows only."""
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    h, at, count = pieces(data, offsets, width, _table(width), gram)
    owner = np.searchsorted(offsets, at, "right") - 1
    out = [np.empty(len(t) - width + 1, np.int64) for t in texts]
    raw = data.tobytes()
    number: dict[tuple, int] = {}
    parts, hs, low, mine = [], [], [], np.empty(len(h), np.int64)
    for k, (x, a, n, i) in enumerate(zip(h.tolist(), at.tolist(), count.tolist(), owner.tolist(), strict=True)):
        j = mine[k] = number.setdefault((x, raw[a : a + n + width - 1]), len(parts))
        if j == len(parts):
            parts.append(raw[a : a + n + width - 1])
            hs.append(x)
            low.append((least[i], source[i]))
        elif least[i] < low[j][0]:
            low[j] = least[i], low[j][1]
    own, of = np.array(low, np.int64).T
    found = _resolve(parts, np.array(hs, np.uint64), own, of, width, gram)
    for j, a, n, i in zip(mine.tolist(), at.tolist(), count.tolist(), owner.tolist(), strict=True):
        out[i][a - offsets[i] : a - offsets[i] + n] = found.get(j, own[j])
    return out


def _resolve(texts: list[bytes], h: np.ndarray, least: np.ndarray, source: np.ndarray, width: int, gram: int = GRAM) -> dict[int, np.ndarray]:
    """For pieces whose minimizer has several distinct pieces, the least owner of each window."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    begins = np.flatnonzero(same & ~np.concatenate([[False], same[:-1]]) if len(same) else same)
    ends = np.flatnonzero(same & ~np.concatenate([same[1:], [False]]) if len(same) else same) + 2
    groups = [order[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
    out: dict[int, np.ndarray] = {}
    batch: list[int] = []
    size = 0

    def merge():
        shards = [[i for i in batch if source[i] % SHARDS == k] for k in range(SHARDS)]
        found = bwt.least_owner([[texts[i] for i in s] for s in shards], [least[s] if s else np.zeros(0, np.int64) for s in shards], width)
        for s, f in zip(shards, found, strict=True):
            out.update(zip(s, f, strict=True))
        batch.clear()

    for g in groups:
        own = sum(len(texts[i]) for i in g)
        if own > MERGE_BYTES:
            if gram == width:  # all windows of these pieces are the same bytes
                out.update((i, np.full(len(texts[i]) - width + 1, least[g].min())) for i in g.tolist())
            else:
                finer = _finer([texts[i] for i in g], least[g], source[g], width, min(width, gram + FINER))
                out.update(zip(g.tolist(), finer, strict=True))
            continue
        if size + own > MERGE_BYTES and batch:
            merge()
            size = 0
        batch += g.tolist()
        size += own
    if batch:
        merge()
    return out


def _meet(width: int):
    """The answer to each bucket of documents (by ``kind`` of its row): of its pieces, by number, those with windows that are owned by
    a smaller document than the bucket's own least, and the least owners of their windows."""

    def meet(rows: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        asked = []
        for bucket, blob in zip(rows["kind"].to_pylist(), rows["blob"].combine_chunks(), strict=True):
            h, own, parts = _unblob(blob.as_buffer().to_pybytes())
            asked.append((bucket, h, np.array([number.setdefault(t, len(number)) for t in parts], np.int64), own))
        texts = list(number)
        hs, source, least = np.empty(len(texts), np.uint64), np.empty(len(texts), np.int64), np.full(len(texts), _LAST)
        for bucket, h, mine, own in asked:
            hs[mine], source[mine] = h, bucket
            least[mine] = np.minimum(least[mine], own)  # a bucket has each text once
        found = _resolve(texts, hs, least, source, width)
        low = least.copy()
        for i, windows in found.items():
            low[i] = windows.min()
        buckets, blobs = [], []
        for bucket, _, mine, own in asked:
            told = np.flatnonzero(low[mine] < own)
            if len(told):
                windows = [found.get(i, least[i : i + 1]) for i in mine[told].tolist()]
                head = packed.pack(told.astype(np.int32), np.array([len(w) for w in windows], np.int32))
                buckets.append(bucket)
                blobs.append(len(head).to_bytes(4, "little") + head + packed.pack(np.concatenate(windows)))
        kinds = pa.array(np.full(len(buckets), _ANSWER + rows["bucket"][0].as_py(), np.int32))
        return pa.Table.from_arrays([pa.array(buckets, pa.int32()), kinds, pa.array(blobs, pa.binary())], schema=packed.FIELDS)

    return meet


def remove_repeats(docs: DataFrame, width: int = 50, doc_id: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``texts`` the kept bytes as binary
    ``kept``. A byte is removed if a ``width``-byte string that covers it also starts in a document of a smaller id.

    Null text: empty. Rows of one id are no smaller than each other; a null id is larger than all others. Ids are whole numbers;
    others are an error. Empty table: no rows. ``width`` must be above ``GRAM``.
    """
    if width <= GRAM:
        raise ValueError(f"width must be above {GRAM}")
    ship(docs.sparkSession)
    rows = packed.with_uid(docs, doc_id, text).withColumn("owner", F.coalesce("doc_id", F.lit(_LAST - 1)))
    buckets, doc_buckets = _sizes(rows)

    def scan(batches):
        table = _table(width)
        for batch in batches:
            uids = batch.column(0).to_numpy()
            data, offsets = textbuf.buffer(batch.column(1))
            for i, j in runs(offsets, CHUNK_BYTES):
                own = offsets[i : j + 1] - offsets[i]
                h, at, _ = pieces(data[offsets[i] : offsets[j]], own, width, table)
                text = np.searchsorted(own, at, "right") - 1
                yield from _send(h & np.uint64(2**48 - 1), uids[i:j][text], at - own[text], buckets, doc_buckets)

    def own(left: pa.Table, right: pa.Table):
        uids = left["uid"].to_numpy()
        data, offsets = textbuf.buffer(left["text"])
        found = _Pieces(data, offsets, np.unique(_places(right, uids, offsets)), left["owner"].to_numpy(), width)
        return data, offsets, found, (found.h % np.uint64(buckets)).astype(np.int64)

    def cut(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            _, _, found, bucket = own(left, right)
            order = np.argsort(bucket, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
                out.append((int(bucket[part[0]]), _blob(found.h[part], found.least[part], [found.texts[k] for k in part.tolist()])))
        kinds = pa.array(np.full(len(out), key[0].as_py(), np.int32))
        return pa.Table.from_arrays([pa.array([b for b, _ in out], pa.int32()), kinds, pa.array([x for _, x in out], pa.binary())], schema=packed.FIELDS)

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * texts

    def remove(key, left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = right["kind"].to_numpy()
        data, offsets, found, bucket = own(left, right.filter(pa.array(kinds == 1)))
        least, several = found.least.copy(), np.zeros(len(found.texts), np.int64)  # first of a piece's windows in ``told``, from 1
        told, held = [np.zeros(1, np.int64)], 1
        order = np.argsort(bucket, kind="stable")
        for kind, blob in zip(kinds.tolist(), right["blob"].combine_chunks(), strict=True):
            if kind >= _ANSWER:
                blob = blob.as_buffer().to_pybytes()
                n = int.from_bytes(blob[:4], "little")
                number, lengths = packed.unpack(blob[4 : 4 + n], np.int32, np.int32)
                (windows,) = packed.unpack(blob[4 + n :], np.int64)
                mine = order[np.searchsorted(bucket[order], kind - _ANSWER) :][number]  # as they were sent
                first, one = np.cumsum(lengths) - lengths, lengths == 1
                least[mine[one]] = np.minimum(least[mine[one]], windows[first[one]])
                several[mine[~one]] = held + first[~one]
                told.append(windows)
                held += len(windows)
        told = np.concatenate(told)
        size = np.array([len(t) for t in found.texts], np.int64)
        begin = offsets[found.doc] + found.start
        whole = (several[found.of] == 0) & (least[found.of] < found.owner)
        change = np.zeros(len(data) + 1, np.int32)
        np.add.at(change, begin[whole], 1)
        np.add.at(change, (begin + size[found.of])[whole], -1)
        apart = np.flatnonzero(several[found.of])
        upto = np.cumsum(size[found.of[apart]] - width + 1)
        for part in np.split(apart, np.searchsorted(upto, np.arange(_STEP, int(upto[-1]), _STEP))) if len(apart) else []:
            count = size[found.of[part]] - width + 1
            window = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            owned = told[window + np.repeat(several[found.of[part]], count)] < np.repeat(found.owner[part], count)
            single = (window + np.repeat(begin[part], count))[owned]
            np.add.at(change, single, 1)
            np.add.at(change, single + width, -1)
        gone = np.cumsum(change[:-1]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = offsets[1:-1]
        inner = inner[inner < len(data)]
        begins[inner] = gone[inner]
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
        sha, kept = [], []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            rest = data[a:b][~gone[a:b]].tobytes()
            sha.append(hashlib.sha256(rest).hexdigest())
            if texts:
                kept.append(rest)
        columns = [left["doc_id"], pa.array(np.diff(offsets)), pa.array(total(gone)), pa.array(total(begins)), pa.array(sha, pa.string()), *([pa.array(kept, pa.binary())] if texts else [])]
        return pa.Table.from_arrays(columns, schema=pa.schema(fields))

    placed = rows.withColumn("bucket", packed.id_bucket_column(F.col("uid"), doc_buckets))  # exchanged once, used twice
    owned = placed.groupBy("bucket")
    flagged = materialise(rows.select("uid", "text").mapInArrow(scan, packed.SCHEMA).groupBy("bucket").applyInArrow(_count(doc_buckets), packed.SCHEMA), "flagged")
    asked = owned.cogroup(flagged.groupBy("bucket")).applyInArrow(cut, packed.SCHEMA)
    answers = asked.groupBy("bucket").applyInArrow(_meet(width), packed.SCHEMA)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return owned.cogroup(flagged.unionByName(answers).groupBy("bucket")).applyInArrow(remove, schema)
