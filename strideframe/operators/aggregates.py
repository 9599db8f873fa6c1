"""Aggregates with fixed tie rules (AGG02-AGG22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_one(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in ``order`` (which must be total)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def argmax_first(value: Column, metric: Column, idx: Column) -> Column:
    """Aggregate: the value at the largest metric; of equal ones, at the smallest position."""
    return F.max_by(value, F.when(metric.isNotNull(), F.struct(metric.alias("m"), (-idx).alias("i"))))


def argmin_first(value: Column, metric: Column, idx: Column) -> Column:
    return F.min_by(value, F.when(metric.isNotNull(), F.struct(metric.alias("m"), idx.alias("i"))))


def last_near_max(df: DataFrame, keys: list[str], metric: str, idx: str, eps: float = 1e-6) -> DataFrame:
    """keys, peak, last_idx: the largest metric and the last position within ``eps`` of it."""
    peaks = df.groupBy(*keys).agg(F.max(metric).alias("peak"))
    near = df.join(peaks, keys).where(F.abs(F.col(metric) - F.col("peak")) <= eps)
    return near.groupBy(*keys, "peak").agg(F.max(idx).alias("last_idx"))


def side(mean_x: Column) -> Column:
    """-1 for a negative mean, else 1 (also for none)."""
    return F.when(mean_x < 0, -1).otherwise(1)


def spread_if_enough(x: Column, least: int = 3) -> Column:
    """Aggregate: sample standard deviation, null below ``least`` values. Linear, not circular."""
    return F.when(F.count(x) >= least, F.stddev_samp(x))


def bounding_box(x: str, y: str, z: str) -> list[Column]:
    """Aggregates: bounds of all points as a cube around their centre."""
    centre = {k: (F.min(k) + F.max(k)) / 2 for k in (x, y, z)}
    half = F.greatest(*((F.max(k) - F.min(k)) / 2 for k in (x, y, z)))
    return [c for k in (x, y, z) for c in ((centre[k] - half).alias(f"{k}_low"), (centre[k] + half).alias(f"{k}_high"))]


def axis_stats(*axes: str) -> list[Column]:
    return [f(a).alias(f"{a}_{name}") for a in axes for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]


def mean_difference(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean absolute difference of two runs over the keys that both have."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys)
    return both.agg(F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("mad"), F.count(F.lit(1)).alias("n"))


def mean_differences(a: DataFrame, b: DataFrame, runs: list[str], keys: list[str], value: str) -> DataFrame:
    """``mean_difference`` of each pair of runs that both sides name alike (``runs``)."""
    both = a.select(*runs, *keys, F.col(value).alias("_a")).join(b.select(*runs, *keys, F.col(value).alias("_b")), [*runs, *keys])
    return both.groupBy(*runs).agg(F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("mad"), F.count(F.lit(1)).alias("n"))


def rest_pose(df: DataFrame, keys: list[str], frame: str, values: list[str], frames: int = 10) -> DataFrame:
    """Mean of the first ``frames`` frames."""
    return df.where(F.col(frame) < frames).groupBy(*keys).agg(*(F.avg(v).alias(v) for v in values))


def calm_frame(df: DataFrame, keys: list[str], frame: str, square: Column) -> DataFrame:
    """keys, frame, calm: the frame of smallest mean squared distance from the origin, the first of equal ones.

    It is a matter of place, not of motion; ``still_frame`` is about motion.
    """
    means = df.groupBy(*keys, frame).agg(F.avg(square).alias("calm"))
    return top_one(means, keys, F.asc("calm"), F.asc(frame))


def still_frame(df: DataFrame, keys: list[str], joint: str, frame: str, axes: list[str]) -> DataFrame:
    """Extension: the frame whose points moved least since the frame before."""
    w = Window.partitionBy(*keys, joint).orderBy(frame)
    step = sum(((F.col(a) - F.lag(a).over(w)) ** 2 for a in axes[1:]), (F.col(axes[0]) - F.lag(axes[0]).over(w)) ** 2)
    return calm_frame(df.withColumn("_step", step).where("_step is not null"), keys, frame, F.col("_step"))


def next_run(names: DataFrame, number: Column) -> DataFrame:
    return names.agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_run"))
