"""Numbers from text, formatting and small numeric rules (NUM01-NUM08, STR07)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, unquote

NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def to_double(x: Column | str, special: bool = False) -> Column:
    """Number in text with decimal comma or point, quotes and single underscores allowed; else null.

    NaN and infinities are null too (missing is NULL here), unless ``special``.
    """
    s = F.regexp_replace(F.translate(unquote(x), ",", "."), "(?<=[0-9])_(?=[0-9])", "")
    number = F.when(F.regexp_like(s, F.lit(NUMBER)), s.try_cast("double"))
    if special:
        low = F.lower(s)
        number = number.when(F.regexp_like(low, F.lit("^[+-]?nan$")), F.lit(math.nan)).when(F.regexp_like(low, F.lit(r"^\+?inf(?:inity)?$")), F.lit(math.inf)).when(F.regexp_like(low, F.lit("^-inf(?:inity)?$")), F.lit(-math.inf))
    return number


def to_long(x: Column | str) -> Column:
    """Whole number, truncated toward zero; out of range, NaN and infinite are null."""
    return to_double(x).try_cast("bigint")


def thousands_to_long(x: Column | str) -> Column:
    """Whole number whose commas group thousands (the second source profile)."""
    return F.regexp_replace(_c(x), ",", "").try_cast("double").try_cast("bigint")


def goal_distance(x: Column, y: Column, side: Column) -> Column:
    """Distance to the goal's centre on the side of ``side``: x = 20 if it is positive, else -20."""
    return F.hypot(x - F.when(side > 0, 20.0).otherwise(-20.0), y)


def side_sign(x: Column) -> Column:
    return F.when(x < 0, -1).otherwise(1)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def close_to(a: Column, b: Column, eps: float = 1e-6) -> Column:
    return F.abs(a - b) <= eps


def six_decimals(x: Column) -> Column:
    """Text with six decimals; '' for missing."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.format_string("%.6f", x)).otherwise("")


def stretch(length: Column, bind: Column) -> Column:
    """Change of a length in proportion to its length at rest, within -1 and 1; null without a length at rest."""
    return F.when(bind > 1e-6, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (length - bind) / bind)))


def muscle(degrees: Column, low: float, high: float) -> Column:
    """Degrees in proportion to the limit of their sign, within -1 and 1."""
    up = F.when(F.lit(high) > 0, degrees / F.lit(float(high))).otherwise(0.0)
    down = F.when(F.lit(low) < 0, -degrees / F.lit(float(low))).otherwise(0.0)
    return clip(F.when(degrees >= 0, up).otherwise(down), -1.0, 1.0)


def millimetres(x: Column) -> Column:
    return x * 0.001
