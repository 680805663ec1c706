"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over exact block quotas.

Documents of a source stand in a permuted stream (by hash). The mix takes a prefix of so many words of the stream,
which may run round twice; the stream is cut into blocks of ``block_words`` words. A tree over the output shards
splits the sources' block quotas exactly: at each node the left half draws its share without replacement. Every shard
so gets a disjoint run of each source's permuted blocks, and orders its rows by another hash.

The level of the targets is found by aggregates over the sources' sizes. Quotas are drawn on the driver, for ``GROUP`` sources
at a time: first the groups' totals go through the tree, then each group's sources share out what the group got.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from fractions import Fraction
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, materialise

WEIGHTS = (5, 2, 1)
#: Sources whose quotas are drawn at a time, and up to which the plan is broadcast (about 2 MB).
GROUP = 10_000
#: Hash buckets of a source: the unit in which its stream is numbered.
BUCKETS = 4096


def level(sums: DataFrame, weights: Sequence[float], share: float = 1.5, most: int = 2) -> list[Fraction] | None:
    """What a source of each weight gets if it is not held at ``most`` times its size: its weight's part of what the sources so
    held leave of ``share`` of all sizes. None: all are held. ``sums``: source sizes ``n`` and numbers of weights ``w``.

    Each round holds the sources that the last level puts above their bound, by one aggregate; the level only rises.
    """
    weights = [Fraction(w).limit_denominator(1_000_000) for w in weights]
    scale = math.lcm(*[w.denominator for w in weights])
    whole = [int(w * scale) for w in weights]
    rows = sums.select(F.col("n").cast("decimal(38,0)").alias("n"), F.element_at(F.array(*[F.lit(w).cast("decimal(38,0)") for w in whole]), F.col("w") + 1).alias("w")).filter("n > 0 AND w > 0")
    total = Fraction(int(sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])) * Fraction(share)
    now = Fraction(0)
    while True:
        # a source is held if its bound is below the level times its weight
        held = F.col("n") * F.lit(most * now.denominator).cast("decimal(38,0)") < F.col("w") * F.lit(now.numerator).cast("decimal(38,0)")
        taken, free = rows.agg(F.sum(F.when(held, F.col("n"))), F.sum(F.when(~held, F.col("w")))).first()
        if not free:
            return None
        before, now = now, max(Fraction(0), total - most * int(taken or 0)) / int(free)
        if now == before:
            return [now * w for w in whole]


def hypergeometric(good: int, bad: int, draws: int, rng: random.Random) -> int:
    """Number of good ones among ``draws`` without replacement; inverse of the distribution outwards from its mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    u, down, up, p_down, p_up = rng.random() - p, mode, mode, p, p
    while u > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            if (u := u - p_up) <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            if (u := u - p_down) <= 0:
                return down
    return mode


def split_quotas(quotas: Sequence[int], shards: int, seed: int | str = 0, sizes: Sequence[int] | None = None) -> list[list[int]]:
    """Blocks of each source (column) for each shard (row); columns add up to ``quotas``, rows to ``sizes`` or else differ by one
    at most."""

    def go(q: list[int], first: int, n: int) -> list[list[int]]:
        if n == 1:
            return [q]
        left_n, total = n // 2, sum(q)
        rng, want, rest, left = random.Random(f"{seed}/{first}/{n}"), sum(sizes[first : first + left_n]) if sizes else total * left_n // n, total, []
        for x in q:
            rest -= x
            got = hypergeometric(x, rest, want, rng)
            left.append(got)
            want -= got
        return go(left, first, left_n) + go([a - b for a, b in zip(q, left, strict=True)], first + left_n, n - left_n)

    return go(list(quotas), 0, shards)


def _ranges_before(cuts: str, block: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c <= block))


def _stream(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, *more: Column) -> DataFrame:
    """doc_id, source, size, and the place in the source's permuted stream: hash ``__h`` and its bucket ``__b``."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("n"))
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        *more,
        F.md5(F.concat(F.lit(f"{seed}/"), name, F.lit("/"), F.md5(text.cast("binary"))).cast("binary")).alias("__h"),
    ).withColumn("__b", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"))


def _sources(sums: DataFrame, weights: Sequence[float], share: float, most: int) -> tuple[DataFrame, int]:
    """A row per source: its size, ``w`` (the number of its weight, by code-point order, nulls last), target and words wanted.
    Sources are numbered by ranges, so no task holds all of them."""
    totals = sums.groupBy("source").agg(F.sum("n").alias("n"))
    dealt = materialise(totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "sources")
    counts = dealt.groupBy("range").agg(F.count("*").alias("c"))
    before = counts.select("range", F.coalesce(F.sum("c").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("first")
    numbered = materialise(dealt.join(F.broadcast(before), "range").select("source", "n", place.alias("no")).withColumn("w", (F.col("no") % len(weights)).cast("int")), "numbered-sources")
    free, bound = level(numbered, weights, share, most), F.col("n").cast("double") * most
    targets, words = bound, F.col("n") * most
    if free is not None:
        pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("w") + 1)
        # above the level exactly if above its whole part
        held = F.col("n") * most <= pick([math.floor(v) for v in free], "long")
        targets, words = F.when(held, bound).otherwise(pick([float(v) for v in free], "double")), F.when(held, words).otherwise(pick([round(v) for v in free], "long"))
    none = (F.col("n") <= 0) | F.element_at(F.array(*[F.lit(not w > 0) for w in weights]), F.col("w") + 1)
    planned = numbered.select(F.col("source").alias("__s"), "no", F.col("n").alias("source_size"), F.when(none, 0.0).otherwise(targets).alias("target"), F.when(none, 0).otherwise(words).cast("long").alias("__want"))
    planned = materialise(planned, "targets")
    return planned, planned.count()


def _cuts(planned: DataFrame, n_sources: int, shards: int, block_words: int, seed: int) -> DataFrame:
    """``__t`` (a source) and ``__cuts``: the blocks of its stream before the end of each shard's run."""
    group, quota = F.floor(F.col("no") / GROUP), F.ceil(F.col("__want") / block_words)
    totals = [int(r.q) for r in planned.groupBy(group.alias("g")).agg(F.sum(quota).alias("q")).orderBy("g").collect()]
    by_group = list(zip(*split_quotas(totals, shards, seed), strict=True)) if totals else []
    schema = T.StructType([T.StructField("__t", T.StringType()), T.StructField("__cuts", T.ArrayType(T.LongType()))])
    found = planned.sparkSession.createDataFrame([], schema)
    for g, sizes in enumerate(by_group):
        own = planned.filter(group == g).select("__s", "no", quota.alias("q")).orderBy("no").collect()  # ``GROUP`` rows at most
        runs = list(zip(*split_quotas([int(r.q) for r in own], shards, seed if len(by_group) == 1 else f"{seed}/{g}", sizes), strict=True))
        part = planned.sparkSession.createDataFrame([(r[0], list(accumulate(run))) for r, run in zip(own, runs, strict=True)], schema)
        found = part if n_sources <= GROUP else found.unionByName(materialise(part, "cuts"))
    return found


def _small(df: DataFrame, n_sources: int) -> DataFrame:
    return F.broadcast(df) if n_sources <= GROUP else df


def _starts(sums: DataFrame) -> DataFrame:
    """Words of its source before each bucket, as ``__s2, __b2, __first, n``."""
    earlier = Window.partitionBy("source").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(F.col("source").alias("__s2"), F.col("__b").alias("__b2"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__first"), "n")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    most: int = 2,
    shards: int = 16,
    block_words: int = 4096,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: size, its source's size and target, words taken, and for each of the up to ``most`` times it
    is taken the output shard and place (``shard_1, order_1, shard_2, ...``; null where not taken). A document counts as
    taken again where a copy of its words begins within the mix.

    Weights go by the sources' code-point order, nulls last, repeating. Null text or none: size 0, taken 0. Repeated
    rows are rows of their own (they tie in the permutation and so are interchangeable). Same input, same result.
    """
    rows = materialise(_stream(docs, id_col, text_col, source_col, seed), "mix-rows")
    sums = materialise(rows.groupBy("source", "__b").agg(F.sum("size").alias("n")), "mix-sums")
    planned, n = _sources(sums, weights, share, most)
    cuts = _cuts(planned, n, shards, block_words, seed)
    within = Window.partitionBy("source", "__b").orderBy("__h", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    by_source = planned.join(_small(cuts, n), F.col("__s").eqNullSafe(F.col("__t"))).drop("no", "__t")
    placed = (
        rows.withColumn("__at", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(_starts(sums).drop("n"), F.col("source").eqNullSafe(F.col("__s2")) & (F.col("__b") == F.col("__b2")))
        .withColumn("__at", F.col("__at") + F.col("__first"))
        .join(_small(by_source, n), F.col("source").eqNullSafe(F.col("__s")), "left")
    )
    out, taken = [], F.lit(0).cast("long")
    for k in range(most):
        begin = F.col("__at") + F.lit(k) * F.col("source_size")
        taken = taken + F.greatest(F.lit(0), F.least(F.col("size"), F.col("__want") - begin))
        here = (F.col("size") > 0) & (begin < F.col("__want"))
        shard = _ranges_before("__cuts", F.floor(begin / F.lit(block_words)))
        out += [F.when(here, shard).cast("int").alias(f"shard_{k + 1}"), F.when(here, F.xxhash64("__h", F.lit(k))).alias(f"order_{k + 1}")]
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *out)


def mix_rows(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    most: int = 2,
    shards: int = 16,
    block_words: int = 4096,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix as rows with the columns of ``docs``: whole documents, each as often as ``mix`` begins a copy of it, dealt to the
    tree's output shards: a partition holds the rows of one shard or more, each shard's in its own shuffled order. A document
    of no words is not taken. Of rows equal in id and text, which tie, as many are taken as ``mix`` takes.

    A shard's run begins, and the mix ends, at some hash of a source's stream; these are found in the few buckets they fall into,
    so all rows are judged where they are, by their hash. Only what is taken is shuffled, once. ``docs`` is read three times,
    so pass a table.
    """
    hashed = _stream(docs, id_col, text_col, source_col, seed)
    sums = materialise(hashed.groupBy("source", "__b").agg(F.sum("size").alias("n")), "mix-sums")
    planned, n = _sources(sums, weights, share, most)
    cuts = _cuts(planned, n, shards, block_words, seed)
    by_source = planned.join(_small(cuts, n), F.col("__s").eqNullSafe(F.col("__t"))).drop("no", "__t")
    # borders in words of each copy's stream: where the shards' runs begin (but the first's), and behind them where the mix ends
    starts = F.transform(F.slice("__cuts", 1, shards - 1), lambda c: c * block_words) if shards > 1 else F.array().cast("array<bigint>")
    borders = F.concat(starts, F.array("__want"))
    shifted = lambda k: F.transform(borders, lambda at, j: F.struct(F.lit(k).alias("k"), j.alias("j"), (at - k * F.col("source_size")).alias("at")))
    local = F.flatten(F.array(*[shifted(k) for k in range(most)]))
    bordered = materialise(by_source.select(F.col("__s"), F.col("source_size"), local.alias("__borders")), "borders")
    inside = lambda b: (F.col("__first") < b["at"]) & (b["at"] <= F.col("__first") + F.col("n"))
    met = _starts(sums).join(_small(bordered, n), F.col("__s2").eqNullSafe(F.col("__s"))).select("__s", F.col("__b2"), "__first", F.explode(F.filter("__borders", inside)).alias("b"))
    met = materialise(met.select("__s", "__b2", "b.k", "b.j", (F.col("b.at") - F.col("__first")).alias("__rest")), "met")
    # the first hash that lies behind each border; of rows that tie there, the share before it
    per = Window.partitionBy("__s", "k", "j")
    before = F.coalesce(F.sum("size").over(per.orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = hashed.select("source", "__b", "__h", "size").join(_small(met, n), F.col("source").eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__b2")))
    near = near.select("__s", "k", "j", "__h", "__b2", "__rest", before.alias("__before")).withColumn("__at", F.min(F.when(F.col("__before") >= F.col("__rest"), F.col("__h"))).over(per))
    tied = F.count_if(F.col("__h") == F.col("__at"))
    found = near.groupBy("__s", "k", "j").agg(
        # no hash of its bucket lies behind it: the next bucket does, if there is one
        F.coalesce(F.any_value("__at"), F.when(F.any_value("__b2") < BUCKETS - 1, F.lpad(F.lower(F.hex(F.any_value("__b2") + 1)), 3, "0")), F.lit("~")).alias("h"),
        (F.count_if((F.col("__h") == F.col("__at")) & (F.col("__before") < F.col("__rest"))) / F.greatest(tied, F.lit(1))).alias("part"),
    )
    marks = found.groupBy("__s").agg(F.collect_list(F.struct("k", "j", "h", "part")).alias("__found"))
    outside = lambda b: F.struct(b["k"], b["j"], F.when(b["at"] <= 0, "").otherwise("~").alias("h"), F.lit(0.0).alias("part"))
    beyond = F.transform(F.filter("__borders", lambda b: (b["at"] <= 0) | (b["at"] > F.col("source_size"))), outside)
    whole = bordered.join(marks.withColumnRenamed("__s", "__t"), F.col("__s").eqNullSafe(F.col("__t")), "left")
    whole = materialise(whole.select("__s", F.sort_array(F.concat(beyond, F.coalesce("__found", F.array().cast(marks.schema["__found"].dataType)))).alias("__marks")), "marks")
    carried = _stream(docs, id_col, text_col, source_col, seed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), (F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)) / float(1 << 30)).alias("__u"))
    judged = carried.filter("size > 0").join(_small(whole, n), F.col("source").eqNullSafe(F.col("__s")))

    def copy(k: int) -> Column:
        end = F.get("__marks", F.lit(k * shards + shards - 1))
        runs = F.slice("__marks", k * shards + 1, shards - 1) if shards > 1 else F.array().cast(whole.schema["__marks"].dataType)
        here = (F.col("__h") < end["h"]) | (F.col("__h") == end["h"]) & (F.col("__u") < end["part"])
        return F.when(here, F.struct(F.size(F.filter(runs, lambda m: m["h"] <= F.col("__h"))).alias("shard"), F.xxhash64("__h", F.lit(k)).alias("order")))

    copies = F.filter(F.array(*[copy(k) for k in range(most)]), lambda c: c.isNotNull())
    dealt = judged.select("row", F.explode(copies).alias("c"))
    # a shard is as large as the data asks: its rows are spread over many tasks and shuffled within each
    spread = dealt.repartition(F.col("c.shard"), F.pmod("c.order", F.lit(BUCKETS))).sortWithinPartitions("c.shard", "c.order")
    return spread.select("row.*")
