"""Quality rules whose cutoffs carry a guarantee on false rejection.

Each document is measured natively (words, symbols, repeated lines, repeated word windows). A rule rejects a document
whose measure is above a cutoff. Cutoffs come from labelled documents, per stratum (language), in two halves by a hash of
the whole text, so exact copies never stand on both sides (near copies may; drop them before where there are many). The selection half puts all cutoffs of all rules in a chain: first those that reject fewest good documents, of
these the ones that reject most bad ones. The holdout half, which had no say in that, tests the chain's beginnings one after
the other: a beginning (all its cutoffs together) is certified if the exact binomial tail P(Bin(n, max_rejection) <= k)
of its k rejections among n good documents is at most delta divided by the number of strata. Testing stops at the first
that fails, so within a stratum nothing further is paid for many tests; over the strata delta is shared out. Of the certified
beginnings the one is taken that catches most bad documents of the selection half less ``cost`` times the good ones; ties
go to the shorter. With probability 1 - delta no stratum then loses more than ``max_rejection`` of its good documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

#: Measure and its cutoffs, the loosest first.
RULES = {
    "symbols": ("n_symbols / n_words", (2.0, 1.0, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05)),
    "word_length": ("word_chars / n_words", (12.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0, 6.5, 6.0)),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.2)),
    "windows": ("n_repeat_words / n_words", (0.19, 0.175, 0.15, 0.125, 0.1, 0.075, 0.05)),
}
MAX_REJECTION, DELTA, COST = 0.05, 0.05, 20
#: Column of the hash that deals labelled documents to the halves.
HALF = "__half"
#: Strata up to which the table of cutoffs (some 100 bytes each) is broadcast; above, it is joined by a shuffle.
BROADCAST_STRATA = 10_000


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with n_words, word_chars, n_symbols, n_lines (lines with a word), n_dup_lines,
    n_repeat_words (long) and base_failed. Columns of ``docs`` with these names are replaced. No shuffle, no Python.

    Null or empty text: all zero and base_failed.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed")
    rest = [c for c in docs.columns if c != text and c.lower() not in names]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.transform(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD))
    first = docs.select(
        *[F.col(f"`{c}`") for c in rest],
        words.alias("__w"),
        F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("__l"),
    )
    w = F.col("__w")
    windows = F.when(F.size(w) < 5, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.slice(w, 1, F.greatest(F.size(w) - 4, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2), F.get(w, i + 3), F.get(w, i + 4)))
    )
    second = first.select(*[F.col(f"`{c}`") for c in rest], "word_chars", "n_symbols", F.size("__w").cast("long").alias("n_words"), F.size("__l").cast("long").alias("n_lines"), (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), windows.alias("__v"))
    # most texts repeat no window: only the others are sorted, by hash and place
    repeats = F.size(F.array_distinct("__v")) < F.size("__v")
    third = second.withColumn("__s", F.when(repeats, F.sort_array(F.transform("__v", lambda x, i: F.struct(x.alias("v"), i.alias("i"))))))
    s = F.col("__s")
    twice = F.filter(
        F.transform(s, lambda x, k: F.when((x["v"] == F.get(s, k - 1)["v"]) | (x["v"] == F.get(s, k + 1)["v"]), x["i"])), lambda i: i.isNotNull()
    )
    fourth = third.withColumn("__p", F.when(s.isNotNull(), F.sort_array(twice)))
    p = F.col("__p")
    covered = F.aggregate(F.transform(p, lambda at, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - at, F.lit(5)))), F.lit(0).cast("long"), lambda a, x: a + x)
    fifth = fourth.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return fifth.select(*[F.col(f"`{c}`") for c in rest], *names[:-1], failed.alias("base_failed"))


def log_factorial(x: Column) -> Column:
    """ln(x!) by Stirling's series, eight steps up for small x."""
    y = x.cast("double") + 9.0
    steps = sum((F.log(x + float(i)) for i in range(1, 9)), F.lit(0.0))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1.0 / (12.0 * y) - 1.0 / (360.0 * y * y * y) + 1.0 / (1260.0 * y * y * y * y * y) - steps


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact for k below the mean; 1 above it, where no cutoff can be certified.

    Terms fall from k down, by a factor that only shrinks; those beyond 40 deviations are below any double.
    """
    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    terms = F.least(k, F.ceil(40.0 * F.sqrt(n * p)) + 50).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(0), terms),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda a, i: F.struct((a["term"] * (k - i) / (n - k + i + 1) * ((1 - p) / p)).alias("term"), (a["sum"] + a["term"]).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(top) * total)


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", max_rejection: float = MAX_REJECTION, delta: float = DELTA, cost: int = COST) -> DataFrame:
    """One row per stratum that has a cutoff: ``stratum`` and ``cut_<rule>``, null where none is certified or catches anything.
    ``measured``: rows of ``measure`` with a hash of the text as ``HALF``.

    ``labels``: doc_id, quality (1 good, 0 bad); a document with several labels is good if all say so; null labels are
    left out. Null and empty strata are one. What is gathered per stratum has as many rows as there are cutoffs.
    """
    one = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = measured.filter(~F.col("base_failed")).join(one, "doc_id")
    hold = F.substring(F.col(HALF), 1, 1) < "8"
    values = F.expr("array(" + ", ".join(m for m, _ in RULES.values()) + ")")
    rows = materialise(rows.select(F.coalesce(F.col(f"`{stratum}`"), F.lit("")).alias("stratum"), hold.alias("hold"), (F.col("quality") == 1).alias("good"), values.alias("x")), "labelled")
    # as SQL text: hundreds of column objects take the driver longer than the job
    grid = [(r, g) for r, (_, cuts) in enumerate(RULES.values()) for g in cuts]
    array = lambda form: F.expr("array(" + ", ".join(form.format(n=n, r=r, g=f"{g}D") for n, (r, g) in enumerate(grid)) + ")")
    over = rows.groupBy("stratum").agg(array("count_if(NOT hold AND good AND x[{r}] > {g})").alias("good"), array("count_if(NOT hold AND NOT good AND x[{r}] > {g})").alias("bad"))
    cells = over.select("stratum", F.explode(array("named_struct('no', {n}, 'r', {r}, 'cut', {g}, 'good', good[{n}], 'bad', bad[{n}])")).alias("c")).select("stratum", "c.*")
    place = F.row_number().over(Window.partitionBy("stratum").orderBy("good", F.desc("bad"), "no"))
    chains = materialise(cells.filter("bad > 0").withColumn("place", place).groupBy("stratum").agg(F.collect_list(F.struct("r", "cut", "place")).alias("chain")), "chains")
    # the first cutoff of the chain that rejects a document; null if none does
    first = F.array_min(F.transform("chain", lambda c: F.when(F.get("x", c["r"]) > c["cut"], c["place"])))
    marked = rows.join(F.broadcast(chains) if chains.count() <= BROADCAST_STRATA else chains, "stratum", "left").withColumn("first", first)
    sums = marked.groupBy("stratum", "first").agg(F.expr("count_if(hold AND good)").alias("k"), F.expr(f"count_if(NOT hold AND NOT good) - {cost} * count_if(NOT hold AND good)").alias("gain"))
    whole = Window.partitionBy("stratum")
    upto = whole.orderBy("first").rowsBetween(Window.unboundedPreceding, 0)
    strata = sums.agg(F.greatest(F.count_distinct("stratum"), F.lit(1)).alias("strata"))  # one row
    steps = sums.withColumn("n", F.sum("k").over(whole)).filter("first IS NOT NULL")
    steps = steps.select("stratum", "first", "n", F.sum("k").over(upto).alias("k"), F.sum("gain").over(upto).alias("gain")).crossJoin(F.broadcast(strata))
    holds = binomial_tail(F.col("k"), F.col("n"), max_rejection) <= delta / F.col("strata")
    passed = steps.withColumn("passed", F.min(holds.cast("int")).over(upto)).filter("passed = 1 AND gain > 0")
    ends = passed.groupBy("stratum").agg(F.max(F.struct("gain", (-F.col("first")).alias("last"))).alias("b")).select("stratum", (-F.col("b.last")).alias("last"))
    used = ends.join(chains, "stratum").withColumn("used", F.filter("chain", lambda c: c["place"] <= F.col("last")))
    return used.select("stratum", *[F.expr(f"array_min(transform(filter(used, c -> c.r = {r}), c -> c.cut))").alias(f"cut_{name}") for r, name in enumerate(RULES)])


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The measured rows of ``docs`` (without text) with ``kept``: false if base_failed or above a certified cutoff.

    The measures are written to the shared folder once and used to fit and to judge. Documents need no label. Null id:
    judged, never a labelled case. Repeated rows stay. Empty labels: no cutoffs.
    """
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{stratum}`").alias("lang"), F.col(f"`{text}`").alias("text"), _half(text))
    measured = materialise(measure(narrow), "measures")
    return _verdict(measured, _usable(cutoffs(measured, labels, "lang", **options))).drop(HALF)


def _half(text: str) -> Column:
    return F.md5(F.concat(F.lit("holdout/"), F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("binary")).alias(HALF)


def _usable(cuts: DataFrame) -> DataFrame:
    cuts = materialise(cuts, "cutoffs")
    return F.broadcast(cuts) if cuts.count() <= BROADCAST_STRATA else cuts


def _verdict(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    joined = measured.join(cuts, F.coalesce("lang", F.lit("")) == F.col("stratum"), "left").drop("stratum")
    kept = ~F.col("base_failed")
    for r, (m, _) in RULES.items():
        kept = kept & ~F.coalesce(F.when(F.col("n_words") > 0, F.expr(m) > F.col(f"cut_{r}")), F.lit(False))
    return joined.withColumn("kept", kept)


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep. They are measured once and written with their measures to the shared
    folder; only the measures of labelled documents are shuffled."""
    carried = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{stratum}`").alias("lang"), F.col(f"`{text}`").alias("text"), _half(text), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    )
    measured = materialise(measure(carried), "measured-rows")
    return _verdict(measured, _usable(cutoffs(measured.drop("row"), labels, "lang", **options))).filter("kept").select("row.*")
