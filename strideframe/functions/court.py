"""Court geometry (VEC22): constants that predicates use, and points along arcs and dashes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values in metres: court, goals, 7 m marks.
LENGTH, WIDTH = 40.0, 20.0
GOAL_LINE, GOAL_HALF, GOAL_HEIGHT = 20.0, 1.5, 2.0
SEVEN_METRE_X = 13.0


def arc(x: Column, y: Column, radius: Column, begin: Column, end: Column, steps: int) -> Column:
    """array of (x, y): ``steps`` + 1 points on a circle's arc between two angles in degrees."""
    angle = lambda i: (begin + (end - begin) * i / steps) * (math.pi / 180)
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.struct((x + radius * F.cos(angle(i))).alias("x"), (y + radius * F.sin(angle(i))).alias("y")))


def dashes(length: Column, dash: float, gap: float) -> Column:
    """array of (begin, end) of the dashes along a line; the last one ends with the line."""
    n = F.ceil(length / (dash + gap)).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct((i * (dash + gap)).alias("begin"), F.least(i * (dash + gap) + dash, length).alias("end")))
    return F.filter(each, lambda d: d["end"] > d["begin"])
