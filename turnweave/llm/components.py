"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import made, materialise, remove


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a > b). Large star: each node's larger neighbours link to its smallest neighbour. Small star: its smaller
    neighbours and itself do."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = materialise(both.groupBy("u").agg(F.min("v").alias("m")), "star").select("u", F.least("u", "m").alias("m"))
    # least is read from a table, so both sides are exchanged and a hub's rows can be split between tasks
    moved = both.join(least, "u")
    if large:
        out = moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` (the component's smallest node) for every node with a link; ``links`` has columns a and b.

    Each round at least halves what keeps a component from being a star; rounds go on until nothing changes. Every
    round's links are written to the shared folder and removed after the next. Loops and null ends are ignored.
    """
    links = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = mark(links)
    while now[0]:
        old = len(made()) - 1  # the links of the round before and what comes of them
        links = materialise(_star(materialise(_star(links, True), "large"), False), "small")
        before, now = now, mark(links)
        remove(links.sparkSession, made()[old:-1])
        if before == now:
            break
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
