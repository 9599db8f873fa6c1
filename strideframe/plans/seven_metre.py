"""Secondary entry: shots with millisecond times against ball rows, and the 7 m detector (FLT08-FLT11, AGG05, AGG06, COR07, COR08)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import asof
from ..operators.aggregates import spread_if_enough


def track_points(shots: DataFrame, ball: DataFrame, window_ms: int = 3000, keys: list[str] | None = None) -> DataFrame:
    """Shots with each ball row in the window around them and ``time_from_shot_ms``, negative before the shot."""
    keyed = keys or ["_all"]
    one = shots if keys else shots.withColumn("_all", F.lit(0))
    two = ball if keys else ball.withColumn("_all", F.lit(0))
    met = asof.within(one, two.withColumnRenamed("ts_ms", "ball_ts"), keyed, "ts_ms", "ball_ts", window_ms, window_ms)
    return met.withColumn("time_from_shot_ms", F.col("ball_ts") - F.col("ts_ms"))


def shot_tracks(shots: DataFrame, ball: DataFrame, window_ms: int = 3000, keys: list[str] | None = None) -> DataFrame:
    """One row for each shot with a track of at least two points in the window around it (before and after rows
    without position are dropped): count, maxima, duration, spread of direction and release point.
    """
    met = track_points(shots, ball, window_ms, keys)
    offset = F.col("time_from_shot_ms")
    placed = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    met = met.withColumn("_placed", placed)
    counted = met.groupBy(*[c for c in shots.columns]).agg(
        F.count(F.lit(1)).alias("_raw"),
        F.count_if("_placed").alias("num_points"),
        F.max(F.when(F.col("_placed"), F.col("speed"))).alias("max_speed"),
        F.max(F.when(F.col("_placed"), F.col("accel"))).alias("max_acceleration"),
        (F.max(F.when(F.col("_placed"), F.col("ball_ts"))) - F.min(F.when(F.col("_placed"), F.col("ball_ts")))).alias("flight_ms"),
        F.when(F.count_if("_placed") > 2, spread_if_enough(F.when(F.col("_placed"), F.col("direction")), 2)).alias("angle_spread"),
        asof.last_at_or_before(F.when(F.col("_placed"), F.struct("ball_ts", "x", "y", "z", "speed")), F.when(F.col("_placed"), offset)).alias("release"),
    )
    return counted.where("_raw >= 2 and num_points >= 2").drop("_raw")


def detected(tracks: DataFrame) -> DataFrame:
    """The detector's criteria. Spot and straightness are reported, they don't decide."""
    near = F.col("distance").between(6.5, 7.5)
    fast = F.col("max_speed") > 12
    return tracks.select(
        "*", near.alias("is_7m_distance"), fast.alias("is_high_speed"), F.abs("shot_position_x").between(6.5, 7.5).alias("is_7m_spot"),
        F.coalesce(F.col("angle_spread") < 15, F.lit(False)).alias("is_straight"),
        F.coalesce((F.col("shot_category") == "penalty") & near & fast, F.lit(False)).alias("is_7m_penalty"),
    )


def strict_rule(df: DataFrame) -> DataFrame:
    """The documented variant: straight, faster than 15 and from the spot."""
    return df.withColumn("is_7m_strict", F.coalesce(F.col("is_straight") & (F.col("max_speed") > 15) & F.col("is_7m_spot") & F.col("is_7m_distance"), F.lit(False)))


def analysed(shots: DataFrame, ball: DataFrame, limit: int | None = None) -> DataFrame:
    """All penalties, with their track where there is one, else with the shot's own speed."""
    penalties = shots.where("shot_category = 'penalty'")
    if limit:
        penalties = penalties.orderBy("ts_ms", "id").limit(limit)
    found = detected(shot_tracks(penalties, ball))
    extra = [c for c in found.columns if c not in penalties.columns]
    joined = penalties.join(found.select("id", *extra), "id", "left")
    return joined.withColumn("max_speed", F.coalesce("max_speed", "speed_ball")).withColumn("is_7m_penalty", F.coalesce("is_7m_penalty", F.lit(False)))
