"""Entry B (pose pipeline between the two models) and entry C (marker solve and playback)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import markers, pose, resample


def with_model(frames: DataFrame, infer: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A place for an external model: ``infer`` gets Arrow batches as data frames. None is shipped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield infer(batch)

    return frames.mapInPandas(run, schema)


def flat_lift(frames: DataFrame) -> DataFrame:
    """A deterministic stand-in for a lifting model: the image plane, depth 0."""
    return frames.select("clip_id", "frame", F.transform("joints", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(0.0).alias("z"))).alias("joints"))


def postprocessed(frames: DataFrame, height: float = 1.8) -> DataFrame:
    """Smoothing, constant bones, height and ground, in that order; long form."""
    return pose.grounded(pose.scaled(pose.constant_lengths(pose.smoothed(pose.to_long(frames))), height))


def animate(frames: DataFrame, height: float = 1.8) -> DataFrame:
    """3D joints (clip_id, frame, joints of 17) to frames for the document sinks."""
    ready = pose.to_frames(postprocessed(frames, height)).withColumn("joints", pose.with_hands(F.col("joints")))
    return pose.exported(pose.retargeted(pose.facing_forward(ready)))


def solve(points: DataFrame) -> DataFrame:
    """Marker points to local rotations of the rig."""
    return markers.solved(markers.frame_arrays(markers.joints(points)))


def playback(animation: DataFrame, clocks: DataFrame, rate: float, loop: bool = True) -> DataFrame:
    """Root and rotations at clock times (clip_id, clock in seconds), interpolated."""
    n = animation.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"))
    grid = clocks.join(n, "clip_id").withColumn("at", resample.frame_position(F.col("clock"), F.lit(float(rate)), F.col("n"), loop))
    low, high, share = resample.neighbours(F.col("at"), F.col("n"), loop)
    grid = grid.withColumn("low", low).withColumn("high", high).withColumn("share", share).drop("at")
    a = animation.select("clip_id", F.col("frame").alias("low"), F.col("root").alias("ra"), F.col("quats").alias("qa"))
    b = animation.select("clip_id", F.col("frame").alias("high"), F.col("root").alias("rb"), F.col("quats").alias("qb"))
    met = grid.join(a, ["clip_id", "low"]).join(b, ["clip_id", "high"])
    from ..functions.vector import lerp, slerp

    return met.select("clip_id", "clock", lerp(F.col("ra"), F.col("rb"), F.col("share")).alias("root"), F.zip_with("qa", "qb", lambda p, q: slerp(p, q, F.col("share"))).alias("quats"))
