"""Series windows in spans: the searches of ``series`` for a series that holds most rows (WIN01-WIN06, WIN13).

A plain window makes one task of each series. Here a series is cut into spans along its order (an hour, some
thousand rows), and what a window over the whole series would give is found at two levels: inside each span by a window of
its own, and for all that lies in other spans by one row a span, carried along the spans. Only these summaries
meet by series. A frame of bounded width needs no second level: each row is also lent to the spans
that look at it (``lent``), and windows run within spans.

Equal to the plain windows for any span, as the tests show for spans of one row and of all. Null keys are a series like
any other; the span must not fall along the order (nulls first), and ``order`` must tell all rows of a
series apart, as for the plain windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = "_span"


@dataclass(frozen=True)
class Scan:
    """One value of all rows of the series at or before this one, or at or behind it (``ahead``).

    kind: ``min``, ``max``, ``sum`` or ``nearest``, the value of the closest row that has one. own: the row itself counts.
    """

    kind: str
    value: Column
    ahead: bool = False
    own: bool = True

    def within(self, window) -> Column:
        """In a window over this row's span that begins at the far end."""
        f = {"min": F.min, "max": F.max, "sum": F.sum, "nearest": lambda c: F.last(c, ignorenulls=True)}[self.kind]
        return f(self.value).over(window.rowsBetween(Window.unboundedPreceding, 0 if self.own else -1))

    def summary(self, order: list[str]) -> Column:
        if self.kind != "nearest":
            return getattr(F, self.kind)(self.value)
        place = F.when(self.value.isNotNull(), F.struct(*order))
        return (F.min_by if self.ahead else F.max_by)(self.value, place)

    def joined(self, here: Column, there: Column) -> Column:
        if self.kind == "nearest":
            return F.coalesce(here, there)
        if self.kind == "sum":
            return F.when(here.isNull() & there.isNull(), F.lit(None)).otherwise(F.coalesce(here, F.lit(0)) + F.coalesce(there, F.lit(0)))
        return (F.least if self.kind == "min" else F.greatest)(here, there)


def scanned(df: DataFrame, keys: list[str], order: list[str], span: Column, **scans: Scan) -> DataFrame:
    """``df`` with a column for each scan. One exchange of the rows by key and span, whatever the number of scans."""
    rows = df.withColumn(SPAN, span.cast("long"))
    ways = {}
    for ahead in (False, True):
        down = F.desc if ahead else F.asc
        ways[ahead] = (Window.partitionBy(*keys, SPAN).orderBy(*(down(c) for c in order)), Window.partitionBy(*keys).orderBy(down(SPAN)))
    sums = rows.groupBy(*keys, SPAN).agg(*(s.summary(order).alias(n) for n, s in scans.items()))
    far = (Scan(s.kind, F.col(n), s.ahead, own=False).within(ways[s.ahead][1]).alias(f"_far_{n}") for n, s in scans.items())
    carried = sums.select(*(F.col(k).alias(f"_of_{k}") for k in [*keys, SPAN]), *far)
    for n, s in scans.items():
        rows = rows.withColumn(f"_near_{n}", s.within(ways[s.ahead][0]))
    met = rows.join(carried, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in [*keys, SPAN]])
    return met.select(*df.columns, *(s.joined(F.col(f"_near_{n}"), F.col(f"_far_{n}")).alias(n) for n, s in scans.items()))


def indexed(df: DataFrame, keys: list[str], order: list[str], span: Column, name: str = "idx") -> DataFrame:
    """Position from 0, without gaps."""
    return scanned(df, keys, order, span, **{name: Scan("sum", F.lit(1).cast("long"))}).withColumn(name, F.col(name) - 1)


def next_match(predicate: Column, of: Column) -> Scan:
    """``of`` of the first row at or behind this one where ``predicate`` holds; a struct of several columns if need be."""
    return Scan("nearest", F.when(predicate, of), ahead=True)


def carried_forward(value: Column) -> Scan:
    return Scan("nearest", value)


def before(value: Column) -> Scan:
    """The row before, wrapped so that a null value isn't passed over: field ``v``, null for the first row."""
    return Scan("nearest", F.struct(value.alias("v")), own=False)


def after(value: Column) -> Scan:
    return Scan("nearest", F.struct(value.alias("v")), ahead=True, own=False)


def reversals(df: DataFrame, x: str, keys: list[str], order: list[str], span: Column, name: str = "reversal") -> DataFrame:
    """Whether later values lie on both sides of this one."""
    both = scanned(df, keys, order, span, _low=Scan("min", F.col(x), True, False), _high=Scan("max", F.col(x), True, False))
    return both.withColumn(name, F.coalesce((F.col("_low") < F.col(x)) & (F.col("_high") > F.col(x)), F.lit(False))).drop("_low", "_high")


def run_starts(df: DataFrame, a: str, keys: list[str], order: list[str], span: Column, idx: str = "idx", name: str = "run_start") -> DataFrame:
    """Where the walk back from each row ends that goes on while the value before isn't smaller."""
    one = scanned(df, keys, order, span, _before=before(F.col(a)))
    b = F.col("_before")["v"]
    stop = F.col("_before").isNull() | F.col(a).isNull() | b.isNull() | (b < F.col(a))
    return scanned(one.withColumn("_stop", F.when(stop, F.col(idx))), keys, order, span, **{name: Scan("max", F.col("_stop"))}).drop("_before", "_stop")


def lent(df: DataFrame, at: Column, behind: int, ahead: int, width: int) -> DataFrame:
    """Rows by span of ``width`` along the whole number ``at``, each also lent (``_lent``) to every span of which a row looks at it:
    a row looks ``behind`` back and ``ahead`` forward. A width of at least both lends to two spans at most.
    """
    own = F.floor(at / width)
    spans = F.sequence(F.floor((at - ahead) / width), F.floor((at + behind) / width))
    return df.withColumn(SPAN, F.explode(F.when(at.isNotNull(), spans).otherwise(F.array(F.lit(None).cast("long"))))).withColumn("_lent", F.coalesce(F.col(SPAN) != own, F.lit(False)))


def kept(df: DataFrame) -> DataFrame:
    """What was lent goes back."""
    return df.where(~F.col("_lent")).drop(SPAN, "_lent")


def trailing_peaks(df: DataFrame, value: Column, keys: list[str], time: str, back: int, width: int | None = None, name: str = "peak") -> DataFrame:
    """Largest value in the last ``back`` units of ``time`` (a whole number), this row's time included.

    Spans are as wide as ``back``, whatever ``width`` allows: all that a row looks at is then the begin of its own span up to the row,
    and the end of the span before. Rows are lent to the next span at their time and ``back``, so that both are frames that
    only grow; a frame that slides would be evaluated anew for each row, which takes rows times rows of a frame.
    """
    del width
    span = max(back, 1)
    t = F.col(time).cast("long")
    rows = df.withColumn("_lent", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn(SPAN, t - F.pmod(t, F.lit(span)) + F.when(F.col("_lent"), span).otherwise(0))
    rows = rows.withColumn("_at", t + F.when(F.col("_lent"), back).otherwise(0))
    own, far = F.when(~F.col("_lent"), value), F.when(F.col("_lent"), value)
    grown = lambda down: Window.partitionBy(*keys, SPAN).orderBy(down("_at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    peak = F.greatest(F.max(own).over(grown(F.asc)), F.max(far).over(grown(F.desc)))
    return kept(rows.withColumn(name, peak).drop("_at"))


def moving_averages(df: DataFrame, x: str, keys: list[str], window: int, idx: str, span: int, name: str) -> DataFrame:
    """Average of "same" length, zeros beyond the ends, divided by ``window``; a series shorter than that stays as it is."""
    size = scanned(df, keys, [idx], F.floor(F.col(idx) / span), _last=Scan("max", F.col(idx), True))
    rows = lent(size, F.col(idx), window // 2, (window - 1) // 2, max(span, window))
    near = Window.partitionBy(*keys, SPAN).orderBy(idx).rowsBetween(-(window // 2), (window - 1) // 2)
    short = F.col("_last") + 1 < window
    return kept(rows.withColumn(name, F.when(short, F.col(x)).otherwise(F.sum(x).over(near) / window))).drop("_last")


def gradients(df: DataFrame, x: str, keys: list[str], dt: float, idx: str, span: int, name: str) -> DataFrame:
    """Central differences, one-sided at the ends; null for a single row."""
    rows = lent(df, F.col(idx), 1, 1, max(span, 1))
    near = Window.partitionBy(*keys, SPAN).orderBy(idx)
    b, n, here = F.lag(x).over(near), F.lead(x).over(near), F.col(x)
    slope = F.when(b.isNull(), (n - here) / dt).when(n.isNull(), (here - b) / dt).otherwise((n - b) / (2 * dt))
    return kept(rows.withColumn(name, slope))
