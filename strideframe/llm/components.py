"""Connected components of an edge table, by large-star and small-star rounds.

Every round rewires edges towards smaller neighbours; the edges become stars around the smallest node of
each component after a logarithmic number of rounds. Rounds are written to the shared folder, so nothing
of the graph comes to the driver but a count and a checksum. What links found later join is found among the
roots alone (``extended``), so the rounds of a later step are as large as its links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _directed(edges: DataFrame) -> DataFrame:
    """Edges, larger node first, without loops."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("_m", "a").alias("_m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("_m"))
    return edges.join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).union(least.select("a", F.col("_m").alias("b")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: the smallest node that each node of ``edges`` (a, b: long) reaches. Other nodes aren't listed."""
    now, before = common.written(_directed(edges).distinct(), "components"), None
    for _ in range(rounds):
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
        # a large star has no more rows than its edges, so repeats wait for the one exchange at the end
        now = common.written(_directed(_small_star(_directed(_large_star(now)))).distinct(), "components")
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) of components that ``links`` (a, b) may join further; nodes that stand alone aren't listed."""
    up = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"_{x}"))
    ends = links.select("a", "b").join(up("a"), "a", "left").join(up("b"), "b", "left")
    tops = components(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    moved = roots.join(tops.select(F.col("node").alias("root"), F.col("root").alias("_top")), "root", "left")
    # a root is no node of ``roots``, so no node stands twice
    return common.written(moved.select("node", F.coalesce("_top", "root").alias("root")).union(tops), "components")
