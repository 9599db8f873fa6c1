"""Series of points: position, next match, reversal, back-walk, trailing peak, smoothing (WIN01-WIN17).

A series is the rows of equal ``keys`` in ``order``. Searches ahead run over the descending order, so
that every frame only grows; an ascending frame "current row to the end" would be evaluated anew for
each row. Each series is one window partition: shuffled once by its keys for all columns added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDX = "idx"


def indexed(df: DataFrame, keys: list[str], order: list, name: str = IDX) -> DataFrame:
    """Position from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - F.lit(1).cast("long"))


def _ahead(keys: list[str], idx: str, include: bool):
    return Window.partitionBy(*keys).orderBy(F.desc(idx)).rowsBetween(Window.unboundedPreceding, 0 if include else -1)


def next_match(predicate: Column, keys: list[str], idx: str = IDX, also: tuple[str, ...] = ()) -> Column:
    """Position of the first row at or behind this one where ``predicate`` holds; with ``also``, a struct of it and
    those columns of that row, so that no join has to fetch them.
    """
    hit = F.struct(idx, *also) if also else F.col(idx)
    return F.min(F.when(predicate, hit)).over(_ahead(keys, idx, True))


def crossing(x: Column, line: float = 20.0) -> Column:
    return (x > line) | (x < -line)


def gate(x: Column, low: float = 12.0, high: float = 14.0) -> Column:
    return F.abs(x).between(low, high)


def reversal(x: str, keys: list[str], idx: str = IDX, horizon: int | None = None) -> Column:
    """Whether later values (up to ``horizon`` rows ahead) lie on both sides of this one."""
    w = _ahead(keys, idx, False)
    if horizon is not None:
        w = Window.partitionBy(*keys).orderBy(F.desc(idx)).rowsBetween(-horizon, -1)
    return F.coalesce((F.min(x).over(w) < F.col(x)) & (F.max(x).over(w) > F.col(x)), F.lit(False))


def run_start(a: str, keys: list[str], idx: str = IDX) -> Column:
    """Where the walk back from this row ends that goes on while the value before isn't smaller."""
    w = Window.partitionBy(*keys).orderBy(idx)
    before = F.lag(a).over(w)
    stop = (F.col(idx) == 0) | F.col(a).isNull() | before.isNull() | (before < F.col(a))
    return F.max(F.when(stop, F.col(idx))).over(w.rowsBetween(Window.unboundedPreceding, 0))


def trailing_peak(value: Column, keys: list[str], time: Column, span: int) -> Column:
    """Largest value in the last ``span`` units of ``time`` (a whole number), this row's time included."""
    return F.max(value).over(Window.partitionBy(*keys).orderBy(time).rangeBetween(-span, 0))


def moving_average(x: str, keys: list[str], width: int, idx: str = IDX) -> Column:
    """Average of "same" length, zeros beyond the ends, always divided by ``width``; short series stay."""
    w = Window.partitionBy(*keys).orderBy(idx)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    total = F.sum(x).over(w.rowsBetween(-(width // 2), (width - 1) // 2)) / width
    return F.when(n < width, F.col(x)).otherwise(total) if width > 1 else F.col(x)


def decimated(df: DataFrame, step: int, idx: str = IDX) -> DataFrame:
    return df.where(F.col(idx) % step == 0)


def gradient(x: str, keys: list[str], dt: float = 1.0, idx: str = IDX) -> Column:
    """Central differences, one-sided at the ends; null for a single row."""
    w = Window.partitionBy(*keys).orderBy(idx)
    before, after, here = F.lag(x).over(w), F.lead(x).over(w), F.col(x)
    return F.when(before.isNull(), (after - here) / dt).when(after.isNull(), (here - before) / dt).otherwise((after - before) / (2 * dt))


def carried_forward(value: Column, keys: list[str], idx: str = IDX) -> Column:
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0))


def from_first(x: str, keys: list[str], idx: str = IDX) -> Column:
    return F.col(x) - F.first(x).over(Window.partitionBy(*keys).orderBy(idx).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def above_lowest(x: str, keys: list[str]) -> Column:
    return F.col(x) - F.min(x).over(Window.partitionBy(*keys))


def frame_seconds(time: Column) -> Column:
    """Seconds a frame, of a whole series."""
    return F.try_divide(F.max(time) - F.min(time), F.count(time) - 1)


def clamped_frame(i: Column, n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(i, n - 1))


# Savitzky-Golay: a linear operator. Rows of the hat matrix of a polynomial fit over the window.


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    n = len(b)
    m = [[*row, v] for row, v in zip(a, b)]
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[p] = m[p], m[i]
        for r in range(n):
            if r != i:
                f = m[r][i] / m[i][i]
                m[r] = [x - f * y for x, y in zip(m[r], m[i])]
    return [m[i][n] / m[i][i] for i in range(n)]


def hat_matrix(window: int, degree: int = 2) -> list[list[float]]:
    half = window // 2
    at = range(-half, half + 1)
    moments = [[math.fsum(float(t) ** (i + j) for t in at) for j in range(degree + 1)] for i in range(degree + 1)]
    rows = []
    for here in at:
        c = _solve(moments, [float(here) ** i for i in range(degree + 1)])
        rows.append([math.fsum(c[i] * float(t) ** i for i in range(degree + 1)) for t in at])
    return rows


def smoothed(x: str, keys: list[str], window: int = 11, degree: int = 2, idx: str = IDX) -> Column:
    """Savitzky-Golay over whole series; the window shrinks to the largest odd length of a short series,
    below 3 rows values stay. The ends take the fit over the first or last window.
    """
    whole = Window.partitionBy(*keys).orderBy(idx).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    w = Window.partitionBy(*keys).orderBy(idx)
    i = F.col(idx)
    out = F.col(x)
    for size in range(3, window + 1, 2):
        rows, half = hat_matrix(size, degree), size // 2
        near = F.collect_list(x).over(w.rowsBetween(-(size - 1), size - 1))
        # the window that applies begins at clamp(i - half, 0, n - size); ``near`` begins at max(0, i - size + 1)
        begin = F.greatest(F.lit(0), F.least(i - half, n - size))
        values = F.slice(near, (begin - F.greatest(F.lit(0), i - (size - 1)) + 1).cast("int"), size)
        row = F.element_at(F.array(*(F.array(*(F.lit(c) for c in r)) for r in rows)), (i - begin + 1).cast("int"))
        fit = F.aggregate(F.zip_with(values, row, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        applies = (n >= size) if size == window else (n >= size) & (n < size + 2)
        out = F.when(applies, fit).otherwise(out)
    del whole
    return out
