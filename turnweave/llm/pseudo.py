"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both sides.

The network's input is the sum of the ``WINDOW`` token vectors on either side, each scaled by a vector of its place; the
token itself is masked. Behind a softsign layer the token's number is predicted digit by digit in base ``CLASS``, each
given the digits before it, so the probabilities of all numbers add up to one. Number 0 stands for all words that have none
of their own; such a word costs ln p(0 | both sides) plus ln p of its spelling, byte by byte given the two bytes before. A
document's score is the sum over its tokens.

The whole corpus is gathered: all words seen often enough (``threshold``) are numbered, so the numbers, digits and weights
grow with the corpus; the spelling of the others is counted over all documents; and every document is trained on once, in one of ``ROUNDS`` rounds. In a round each task trains on its own part from the round's start weights; the weights
are then averaged by tokens, in two steps of bounded memory. The driver holds one set of weights.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .common import materialise, shared_dir, ship
from .decontam import runs

#: Tokens: number 0 is any rarer word. Two digits below CLASS number them, or more where the vocabulary is larger than this.
CLASS = 32
VOCABULARY = CLASS * CLASS
EDGE = VOCABULARY
WINDOW, WIDTH = 2, 16
ROUNDS = (1, 3, 4)  # eighths of the documents
BATCH, RATE = 2048, 0.1
CHUNK_BYTES, CHUNK_TOKENS = 4 << 20, 1 << 16
#: Distinct words a counting task holds before it sends what it has.
HELD = 1 << 20
#: Words have a number from sqrt(tokens) / RARITY occurrences on, so there are at most RARITY * sqrt(tokens) of them.
RARITY = 100
#: Pseudo-counts that a spelling's shorter context has in the longer one.
SHORTER = 32
_SPACE = 0x20
_WHITE = textbuf.separators("white")
_ONES = np.ones(CLASS, np.float32)


class Network:
    """Weights as float32 arrays by name."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 0, size: int = VOCABULARY):
        """``size``: numbers there are; the edge token's is ``size``."""
        rng = np.random.default_rng(seed)
        start = lambda k: 0.3 if k == "vectors" else 0.1 if k.startswith(("first", "second", "given", "digit")) and not k.endswith("_bias") else 0
        self.size, self.levels = size, _levels(size)
        self.w = weights or {k: (rng.standard_normal(s) * start(k)).astype(np.float32) + np.float32(k == "places") for k, s in self.shapes(size).items()}
        self.squares = {k: np.full(v.shape, 1e-4, np.float32) for k, v in self.w.items()}

    @staticmethod
    def shapes(size: int) -> dict[str, tuple]:
        found = {"vectors": (size + 1, WIDTH), "places": (2 * WINDOW, WIDTH), "bias": (WIDTH,), "first": (WIDTH, CLASS), "first_bias": (CLASS,)}
        for k in range(1, _levels(size)):
            before = -(-size // CLASS ** (_levels(size) - k))
            given, digit = _names(k)
            found |= {given: (before, WIDTH), digit: (WIDTH, CLASS), f"{digit}_bias": (before, CLASS)}
        return found

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in self.shapes(self.size)])

    @classmethod
    def of(cls, flat: np.ndarray, size: int = VOCABULARY) -> Network:
        shapes = cls.shapes(size)
        cuts = np.cumsum([int(np.prod(s)) for s in shapes.values()])[:-1]
        return cls({k: p.reshape(s).astype(np.float32) for (k, s), p in zip(shapes.items(), np.split(flat, cuts), strict=True)}, size=size)

    def _forward(self, ids: np.ndarray):
        """``ids``: tokens between ``WINDOW`` more on each side, which are context only. Digits: (what stood before, inner
        layer, scores, digit)."""
        w, n = self.w, len(ids) - 2 * WINDOW
        x = np.take(w["vectors"], ids, 0)
        total = np.broadcast_to(w["bias"], (n, WIDTH)).copy()
        for k, at in enumerate(_offsets()):
            total += x[at : at + n] * w["places"][k]
        hidden = total / (1 + np.abs(total))
        number = ids[WINDOW : WINDOW + n].astype(np.int64)
        edge = number >= self.size
        number[edge] = 0
        digits = []
        for k in range(self.levels):
            before, digit = np.divmod(number // CLASS ** (self.levels - 1 - k), CLASS)
            if k:
                given, name = _names(k)
                inner = hidden + np.take(w[given], before, 0)
                scores = inner @ w[name] + np.take(w[f"{name}_bias"], before, 0)
            else:
                inner, scores = hidden, hidden @ w["first"] + w["first_bias"]
            digits.append((before, inner, scores, digit))
        return x, hidden, edge, digits

    def log_probs(self, ids: np.ndarray) -> np.ndarray:
        """ln p of each inner token; 0 for the edge token."""
        _, _, edge, digits = self._forward(ids)
        rows = np.arange(len(edge))
        found = sum(scores[rows, digit] - np.log(np.exp(scores) @ _ONES) for _, _, scores, digit in digits)
        return np.where(edge, np.float32(0), found)

    def _gradient(self, ids: np.ndarray) -> dict[str, tuple]:
        """Of the mean -ln p over the inner tokens: by name, the rows that have one (None: all) and their values."""
        w, n = self.w, len(ids) - 2 * WINDOW
        x, hidden, edge, digits = self._forward(ids)
        used = (~edge).astype(np.float32) / max(1, n - int(edge.sum()))
        rows, g, d = np.arange(n), {}, np.zeros_like(hidden)
        for k, (before, inner, scores, digit) in enumerate(digits):
            np.exp(scores, out=scores)
            scores *= (used / (scores @ _ONES))[:, None]
            scores[rows, digit] -= used
            given, name = _names(k)
            back = scores @ w[name].T
            g[name] = None, inner.T @ scores
            if k:
                g[f"{name}_bias"], g[given] = _by_row(before, scores, back)
            else:
                g[f"{name}_bias"] = None, scores.sum(0)
            d += back
        d *= np.square(1 - np.abs(hidden))
        g["bias"] = None, d.sum(0)
        dx, places = np.zeros_like(x), []
        for k, at in enumerate(_offsets()):
            dx[at : at + n] += d * w["places"][k]
            places.append(np.einsum("ij,ij->j", d, x[at : at + n]))
        g["places"] = None, np.array(places, np.float32)
        (g["vectors"],) = _by_row(ids, dx)
        return g

    def gradient(self, ids: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean -ln p over the inner tokens."""
        out = {k: np.zeros_like(v) for k, v in self.w.items()}
        for k, (at, g) in self._gradient(ids).items():
            out[k][slice(None) if at is None else at] = g
        return out

    def step(self, ids: np.ndarray, rate: float = RATE) -> None:
        """One step of adaptive gradient descent."""
        for k, (at, g) in self._gradient(ids).items():
            at = slice(None) if at is None else at
            squares = self.squares[k][at] + g * g
            self.squares[k][at] = squares
            self.w[k][at] -= np.float32(rate) * g / np.sqrt(squares)


def _levels(size: int) -> int:
    """Digits that number ``size`` tokens."""
    k = 2
    while CLASS**k < size:
        k += 1
    return k


def _names(level: int) -> tuple[str, str]:
    return ("", "first") if not level else ("given", "second") if level == 1 else (f"given{level}", f"digit{level}")


def _by_row(index: np.ndarray, *values: np.ndarray) -> list[tuple]:
    """The distinct indices, with the sums of each one's rows."""
    order = np.argsort(index, kind="stable")
    held = index[order]
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    return [(held[first], np.add.reduceat(v[order], first, 0)) for v in values]


def _kind(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def _offsets() -> list[int]:
    return [k for k in range(2 * WINDOW + 1) if k != WINDOW]


def _streams(batches, size: int = VOCABULARY):
    """The batches' documents in runs of about ``CHUNK_TOKENS`` tokens: one array with ``WINDOW`` edge tokens before, between
    and behind the documents, where each begins in it, and their lengths; with the batch and its range of rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = textbuf.buffer(batch.column(batch.num_columns - 1))
        ids, offsets = np.frombuffer(data.tobytes(), _kind(size)), offsets // _kind(size)().itemsize
        for i, j in runs(offsets, CHUNK_TOKENS):
            lengths = np.diff(offsets[i : j + 1])
            begin = offsets[i:j] - offsets[i] + WINDOW * np.arange(1, j - i + 1)
            stream = np.full(int(lengths.sum()) + WINDOW * (j - i + 1), size, np.int32)
            place = np.repeat(begin - (offsets[i:j] - offsets[i]), lengths) + np.arange(int(lengths.sum()))
            stream[place] = ids[offsets[i] : offsets[j]]
            yield batch, i, j, stream, begin, lengths


def _hashed(batch_text):
    data, offsets = textbuf.buffer(batch_text)
    for i, j in runs(offsets, CHUNK_BYTES):
        part = textbuf.LOWER[data[offsets[i] : offsets[j]]]
        starts, ends, first = textbuf.words(part, offsets[i : j + 1] - offsets[i], _WHITE)
        yield textbuf.hashes(part, starts, ends), first, part, starts, ends


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``h`` (a word's 64-bit hash) and ``n`` over all documents. A task sends each of its words once, or again where it
    holds more than ``HELD`` of them."""
    ship(docs.sparkSession)

    def count(batches):
        held, numbers, loose = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def merged():
            values, inverse = np.unique(np.concatenate([held, *loose]), return_inverse=True)
            weights = np.concatenate([numbers, *[np.ones(len(x), np.int64) for x in loose]])
            return values, np.bincount(inverse, weights, len(values)).astype(np.int64)

        for batch in batches:
            for h, *_ in _hashed(batch.column(0)):
                loose.append(h)
                if sum(map(len, loose)) >= HELD:
                    held, numbers = merged()
                    loose = []
                    if len(held) >= HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(numbers)], names=["h", "n"])
                        held, numbers = held[:0], numbers[:0]
        held, numbers = merged()
        yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(numbers)], names=["h", "n"])

    return docs.select(F.col(f"`{text}`").cast("binary")).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _number(docs: DataFrame, vocabulary: np.ndarray, columns: list[str], text: str) -> DataFrame:
    """``columns``, the words without a number (``__rare``, each with a space behind it) and the tokens' numbers
    (``__ids``, of 16 bits or, from 65,536 on, 32), in a table by round."""
    order, kind = np.argsort(vocabulary, kind="stable"), _kind(len(vocabulary) + 1)
    known, rank = vocabulary[order], (order + 1).astype(kind)
    source = docs.select(*columns, F.col(f"`{text}`").cast("binary").alias("__text"))
    schema = source.select(*columns, F.lit(0).alias("__round"), F.lit(b"").alias("__rare"), F.lit(b"").alias("__ids")).schema
    upto = np.cumsum(ROUNDS)

    def number(batches):
        for batch in batches:
            blobs, rounds, rare = [], [], []
            for h, first, part, starts, ends in _hashed(batch.column(batch.num_columns - 1)):
                at = np.searchsorted(known, h)
                at[at == len(known)] = 0
                ids = np.where(known[at] == h, rank[at], kind(0)) if len(known) else np.zeros(len(h), kind)
                spelt, upto_word = _spelt(part, starts, ends, ids == 0)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)])
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    blobs.append(ids[a:b].tobytes())
                    rare.append(spelt[upto_word[a] : upto_word[b]])
                    rounds.append(int(np.searchsorted(upto, (int(sums[b]) - int(sums[a])) * 0x9E3779B97F4A7C15 % 2**64 >> 61, "right")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rounds, pa.int32()), pa.array(rare, pa.binary()), pa.array(blobs, pa.binary())], names=[*columns, "__round", "__rare", "__ids"])

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/turnweave/tokens-{uuid.uuid4().hex}"
    found = source.mapInArrow(number, schema)
    found.write.partitionBy("__round").parquet(path)
    return spark.read.schema(found.select(*columns, "__rare", "__ids", "__round").schema).parquet(path)


def _spelt(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, chosen: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The chosen words with a space behind each, and the bytes of them before each word (one more than words)."""
    lengths = np.where(chosen, ends - starts + 1, 0)
    before = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat((starts - before[:-1])[chosen], lengths[chosen]) + np.arange(before[-1])
    out = part[np.minimum(at, len(part) - 1)]
    out[before[1:][chosen] - 1] = _SPACE
    return out.tobytes(), before


def _triples(data: np.ndarray) -> np.ndarray:
    """Each byte of words with a space behind each, with the two before it; before a word there are spaces only."""
    last = np.concatenate([[_SPACE], data[:-1]]).astype(np.int64)
    older = np.where(last == _SPACE, _SPACE, np.concatenate([[_SPACE], last[:-1]]))
    return older << 16 | last << 8 | data


def spelling(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Triples of bytes in the words of ``__rare``, ascending, and ln p of the third byte given the two before it.

    A word ends with a space, which it cannot hold, so the probabilities of all words add up to one. The counts of a
    context are filled up with ``SHORTER`` of the next shorter one, down to evenly spread bytes, so what stands only
    once in the corpus is not taken for certain. At most 2**24 rows, as many as there are triples, reach the driver.
    """

    def count(batches):
        total = None
        for batch in batches:
            data, offsets = textbuf.buffer(batch.column(0))
            for i, j in runs(offsets, CHUNK_BYTES):
                if offsets[i] < offsets[j]:
                    now = np.bincount(_triples(data[offsets[i] : offsets[j]]), minlength=1 << 24)
                    total = now if total is None else np.add(total, now, out=total)
        if total is not None:
            for at in np.array_split(np.flatnonzero(total), 16):
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["triple", "n"])

    found = tokens.select("__rare").mapInArrow(count, "triple int, n long").groupBy("triple").agg(F.sum("n").alias("n")).orderBy("triple").toArrow()
    triples, n = found["triple"].to_numpy().astype(np.int64), found["n"].to_numpy().astype(np.float64)
    byte, pair, context = triples & 0xFF, triples & 0xFFFF, triples >> 8
    singles, pairs = np.bincount(byte, n, 1 << 8), np.bincount(pair, n, 1 << 16)
    p = (singles + 1) / (singles.sum() + 256)
    p = (pairs.reshape(256, 256) + SHORTER * p) / (pairs.reshape(256, 256).sum(1, keepdims=True) + SHORTER)
    p = (n + SHORTER * p.ravel()[pair]) / (np.bincount(context, n, 1 << 16)[context] + SHORTER)
    return triples, np.log(p)


def threshold(tokens: int) -> int:
    """Occurrences from which on a word has a number of its own: two at least."""
    return max(2, math.ceil(math.sqrt(tokens) / RARITY))


def _mean(parts: DataFrame, key: list[str]) -> DataFrame:
    """Token-weighted means of the weight blocks by ``key``, added up one row after the other."""

    def means(batches):
        at, total, tokens = None, None, 0
        for batch in batches:
            for row in batch.to_pylist():
                now = tuple(row[k] for k in key)
                if now != at:
                    if at is not None:
                        yield out(at, total, tokens)
                    at, total, tokens = now, 0.0, 0
                total = total + np.frombuffer(row["weights"], np.float32).astype(np.float64) * row["tokens"]
                tokens += row["tokens"]
        if at is not None:
            yield out(at, total, tokens)

    def out(at, total, tokens):
        mean = (total / max(1, tokens)).astype(np.float32).tobytes()
        return pa.RecordBatch.from_pylist([{**dict(zip(key, at, strict=True)), "part": 0, "tokens": tokens, "weights": mean}], schema=fields)

    fields = pa.schema([*[(k, pa.int32()) for k in key], ("part", pa.int32()), ("tokens", pa.int64()), ("weights", pa.binary())])
    schema = ", ".join(f"{k} int" for k in key) + ", part int, tokens long, weights binary"
    return parts.repartition(*key).sortWithinPartitions(*key, "part").mapInArrow(means, schema)


def train(tokens: DataFrame, blocks: int = 16, salt: int = 64, seed: int = 0, size: int = VOCABULARY) -> np.ndarray:
    """The weights after all rounds over ``tokens`` (columns ``__ids`` and ``__round``), flat."""
    flat = Network(seed=seed, size=size).flat()
    for r in range(len(ROUNDS)):

        def fit(batches, flat=flat):
            from pyspark import TaskContext

            net, trained = Network.of(flat, size), 0
            for _, _, _, stream, _, lengths in _streams(batches, size):
                n = len(stream) - 2 * WINDOW
                steps = max(1, n // BATCH)
                cuts = [n * k // steps for k in range(steps + 1)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if (stream[WINDOW + a : WINDOW + b] != size).any():
                        net.step(stream[a : b + 2 * WINDOW])
                trained += int(lengths.sum())
            if trained:
                part = TaskContext.get().partitionId()
                for k, piece in enumerate(np.array_split(net.flat(), blocks)):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part % salt], pa.int32()), pa.array([part], pa.int32()), pa.array([trained], pa.int64()), pa.array([piece.tobytes()], pa.binary())], names=["block", "salt", "part", "tokens", "weights"])

        fitted = tokens.filter(F.col("__round") == r).select("__ids").mapInArrow(fit, "block int, salt int, part int, tokens long, weights binary")
        salted = _mean(fitted, ["block", "salt"]).select("block", F.col("salt").alias("part"), "tokens", "weights")
        rows = sorted(_mean(salted, ["block"]).select("block", "weights").collect())  # one set of weights
        if rows:
            flat = np.concatenate([np.frombuffer(x.weights, np.float32) for x in rows])
    return flat


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_rare (tokens of number 0), log_likelihood (sum of ln p of all tokens, each
    given the tokens around it, with the spelling of those of number 0) and mean_log_prob (null without tokens).

    Words are runs without white space, with A-Z lower-cased. Null or empty text: no tokens, log_likelihood 0. Repeated
    rows are documents of their own and all are trained on; null ids stay. Empty table: no rows.
    """
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # words seen once never have a number; the others' counts are read twice
    counts = materialise(word_counts(narrow).filter("n > 1"), "words")
    least = threshold(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    top = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "h").select("h").toArrow()
    vocabulary = top["h"].to_numpy().astype(np.int64).view(np.uint64)
    size = max(VOCABULARY, len(vocabulary) + 1)
    tokens = _number(narrow, vocabulary, ["doc_id"], "text")
    flat = train(tokens, seed=seed, size=size)
    triples, spelt = spelling(tokens)

    def mark(batches):
        net, cost = Network.of(flat, size), np.zeros(1 << 24, np.float32)
        cost[triples] = spelt
        for batch, i, j, stream, begin, lengths in _streams(batches, size):
            found = np.concatenate([net.log_probs(stream[a : min(a + BATCH, len(stream) - 2 * WINDOW) + 2 * WINDOW]) for a in range(0, len(stream) - 2 * WINDOW, BATCH)] or [np.zeros(0)])
            sums = np.concatenate([[0.0], np.cumsum(found, dtype=np.float64)])
            rare = np.concatenate([[0], np.cumsum(stream[WINDOW:-WINDOW] == 0)])
            low, high = begin - WINDOW, begin - WINDOW + lengths
            data, at = textbuf.buffer(batch.column(1).slice(i, j - i))
            letters = np.concatenate([[0.0], np.cumsum(cost[_triples(data)] if len(data) else [], dtype=np.float64)])
            total = sums[high] - sums[low] + letters[at[1:]] - letters[at[:-1]]
            mean = pa.array(total / np.maximum(lengths, 1), pa.float64(), mask=lengths == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(lengths), pa.array(rare[high] - rare[low]), pa.array(total), mean], names=["doc_id", "n_tokens", "n_rare", "log_likelihood", "mean_log_prob"])

    schema = tokens.select("doc_id", *[F.lit(0).cast("long").alias(n) for n in ("n_tokens", "n_rare")], *[F.lit(None).cast("double").alias(n) for n in ("log_likelihood", "mean_log_prob")]).schema
    return tokens.select("doc_id", "__rare", "__ids").mapInArrow(mark, schema)
