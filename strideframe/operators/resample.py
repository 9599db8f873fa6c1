"""Resampling in time (WIN15, WIN16): clock grid, loop or clamp, interpolation or nearest sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import lerp, slerp


def frame_position(clock: Column, rate: Column, n: Column, loop: bool = True) -> Column:
    """Fractional frame at ``clock`` seconds: round the sequence's duration, or held at its last frame."""
    at = clock * rate
    last = n - 1
    return F.when(last <= 0, F.lit(0.0)).otherwise(F.pmod(at, n.cast("double")) if loop else F.greatest(F.lit(0.0), F.least(at, last.cast("double"))))


def neighbours(position: Column, n: Column, loop: bool = True) -> tuple[Column, Column, Column]:
    """Frame before, frame after and the share of the way between them."""
    low = F.least(F.floor(position), n - 1)
    high = F.when(low + 1 < n, low + 1).otherwise(F.lit(0) if loop else n - 1)
    return low, high, position - low


def nearest_frame(position: Column, n: Column) -> Column:
    """Half a frame rounds to the even one, as the players' rounding does."""
    return F.greatest(F.lit(0), F.least(F.bround(position).cast("long"), n - 1))


def truncated_frame(position: Column, n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.floor(position), n - 1))


def resampled(series: DataFrame, grid: DataFrame, keys: list[str], frame: str, vectors: list[str] = (), quats: list[str] = (), scalars: list[str] = ()) -> DataFrame:
    """``grid`` (keys, low, high, share and others) with interpolated columns of ``series``."""
    names = [*vectors, *quats, *scalars]
    a = series.select(*keys, F.col(frame).alias("low"), *(F.col(c).alias(f"_{c}_a") for c in names))
    b = series.select(*keys, F.col(frame).alias("high"), *(F.col(c).alias(f"_{c}_b") for c in names))
    met = grid.join(a, [*keys, "low"], "left").join(b, [*keys, "high"], "left")
    share = F.col("share")
    made = [lerp(F.col(f"_{c}_a"), F.col(f"_{c}_b"), share).alias(c) for c in vectors]
    made += [slerp(F.col(f"_{c}_a"), F.col(f"_{c}_b"), share).alias(c) for c in quats]
    made += [(F.col(f"_{c}_a") + (F.col(f"_{c}_b") - F.col(f"_{c}_a")) * share).alias(c) for c in scalars]
    return met.select(*(c for c in grid.columns), *made)
