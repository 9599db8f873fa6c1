"""Exact median of groups of any length (AGG11): counts by range of value, narrowed until few values are left.

``median`` holds a group's values in one task. Here each pass counts the values of a group in ``bins`` ranges between its
bounds, summed before they are exchanged; the range that holds the middle one gives the next bounds. Memory is a
row a group and range, and with 1,024 ranges two passes leave about a millionth of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised

#: Groups whose bounds may go to all workers; more are joined by an exchange.
GROUPS = 100_000


def medians(df: DataFrame, keys: list[str], value: str, bins: int = 1024, enough: int = 4096, name: str = "median") -> DataFrame:
    """keys, ``name``: what ``F.median`` gives; groups without a value are null. Values must be finite numbers.

    Null keys are a group. A group is narrowed as long as its range holds more than ``enough`` values that aren't all equal.
    """
    v = F.col("_v")
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    known = rows.where(v.isNotNull())
    state = known.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count(v).alias("_n"))
    # the lower middle value stands at _rank among the _left values in [_lo, _hi]
    state = materialised(state.withColumn("_rank", F.expr("(_n - 1) div 2")).withColumn("_left", F.col("_n")))
    few = state.count() <= GROUPS

    def meet(what: DataFrame) -> DataFrame:
        other = what.select(*(F.col(k).alias(f"_of_{k}") for k in keys), "_lo", "_hi", "_rank", "_n", "_left")
        on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
        other = F.broadcast(other) if few else other
        return (known.join(other, on) if keys else known.crossJoin(other)).where(v.between(F.col("_lo"), F.col("_hi"))).drop(*(f"_of_{k}" for k in keys))

    while True:
        narrow = state.where((F.col("_lo") < F.col("_hi")) & (F.col("_left") > enough))
        if narrow.isEmpty():
            break
        share = (v / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        bin_ = F.least(F.floor(share * bins), F.lit(bins - 1)).alias("_bin")
        counts = meet(narrow).groupBy(*keys, "_rank", "_n", bin_).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count(v).alias("_left"))
        upto = F.sum("_left").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
        found = counts.withColumn("_upto", upto).where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_left") <= F.col("_rank")))
        found = found.select(*keys, "_lo", "_hi", "_n", (F.col("_rank") - F.col("_upto") + F.col("_left")).alias("_rank"), "_left")
        same = state.where(~((F.col("_lo") < F.col("_hi")) & (F.col("_left") > enough))).select(*keys, "_lo", "_hi", "_n", "_rank", "_left")
        state = materialised(found.union(same))
    # few values are left to each group
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("_v")) - 1
    lower = state.where("_lo = _hi").select(*keys, "_n", F.col("_lo").alias("_low"))
    lower = lower.union(meet(state.where("_lo < _hi")).withColumn("_at", order).where("_at = _rank").select(*keys, "_n", F.col("_v").alias("_low")))
    lower = materialised(lower)
    # the upper middle one of an even number: the same, if enough values don't exceed it, else the next larger
    other = lower.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_low").alias("_lo"), "_n")
    other = F.broadcast(other) if few else other
    met = known.join(other, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]) if keys else known.crossJoin(other)
    ends = met.groupBy(*keys, "_lo", "_n").agg(F.count(F.when(v <= F.col("_lo"), 1)).alias("_upto"), F.min(F.when(v > F.col("_lo"), v)).alias("_next"))
    upper = F.when(F.expr("_n div 2") < F.col("_upto"), F.col("_lo")).otherwise(F.col("_next"))
    out = ends.select(*keys, ((F.col("_lo") + upper) / 2).alias(name))
    if not keys:
        return out
    every = rows.select(*(F.col(k).alias(f"_of_{k}") for k in keys)).distinct()
    return every.join(out, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], "left").select(*(F.col(f"_of_{k}").alias(k) for k in keys), name)
