"""Joins in time: forward, backward and nearest as-of, interval join and slices (JOIN04-JOIN10).

As-of joins are a union of both sides and one window: no pairs are formed. With ``span``, a series is
cut into spans of time that are searched in parallel; what a span doesn't answer comes from the nearest
span that has a row, known from one row for each span. One recording may then hold most of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, payload: list[str], forward: bool, order: str | None = None, prefix: str = "hit_", span: int | None = None) -> DataFrame:
    """``left`` with ``prefix``-columns of the right row at or after (``forward``) or at or before its time.

    order: right column that decides between rows of equal time; the first of them is taken forward, the
    last backward. span: width in units of time (times must then be whole numbers).
    """
    order = order or right_time
    taken = F.struct(*(F.col(c).alias(c) for c in payload))
    at = lambda side: (F.floor(F.col(side) / span) if span else F.lit(0)).cast("long").alias("_span")
    one = left.select(*keys, F.col(left_time).alias("_t"), F.lit(None).cast(right.schema[order].dataType).alias("_o"), F.lit(1).alias("_side"), at(left_time), F.struct(*left.columns).alias("_left"))
    kind = right.select(taken.alias("p")).schema["p"].dataType
    one = one.withColumn("_p", F.lit(None).cast(kind))
    two = right.select(*keys, F.col(right_time).alias("_t"), F.col(order).alias("_o"), F.lit(0).alias("_side"), at(right_time), F.lit(None).cast(one.schema["_left"].dataType).alias("_left"), taken.alias("_p"))
    both = one.unionByName(two)
    down = F.desc if forward else F.asc
    w = Window.partitionBy(*keys, "_span").orderBy(down("_t"), "_side", down("_o")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_hit", F.last("_p", ignorenulls=True).over(w)).where("_side = 1")
    if span:
        # one row for each span that has right rows, and what the spans beyond it offer
        edge = F.min_by if forward else F.max_by
        spans = two.groupBy(*keys, "_span").agg(edge("_p", F.struct("_t", "_o")).alias("_edge"))
        asked = found.select(*keys, "_span").distinct()
        known = spans.unionByName(asked.withColumn("_edge", F.lit(None).cast(kind))).groupBy(*keys, "_span").agg(F.first("_edge", ignorenulls=True).alias("_edge"))
        beyond = F.last("_edge", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(down("_span")).rowsBetween(Window.unboundedPreceding, -1))
        found = found.join(known.select(*keys, "_span", beyond.alias("_beyond")), [*keys, "_span"], "left").withColumn("_hit", F.coalesce("_hit", "_beyond"))
    return found.select("_left.*", *(F.col("_hit")[c].alias(f"{prefix}{c}") for c in payload))


def lookups(left: DataFrame, right: DataFrame, keys: list[str], name: str, asked: dict[str, tuple[str, bool]], right_time: str, payload: list[str], order: str | None = None) -> DataFrame:
    """``left`` with several as-of lookups in the same series: ``asked`` gives for each prefix the column of the time looked for and
    whether it is looked for forward. ``name`` tells the rows of ``left`` apart.

    The series is exchanged once for all of them, where ``asof`` would exchange it for each.
    """
    order = order or right_time
    row = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.col(t).alias("t"), F.lit(f).alias("f")) for p, (t, f) in asked.items()))).alias("_ask")
    one = left.select(name, *keys, row).select(name, *keys, F.col("_ask.t").alias("_t"), F.lit(None).cast(right.schema[order].dataType).alias("_o"), F.lit(1).alias("_side"), "_ask")
    taken = F.struct(*(F.col(c).alias(c) for c in payload))
    kind = right.select(taken.alias("p")).schema["p"].dataType
    two = right.select(F.lit(None).cast(left.schema[name].dataType).alias(name), *keys, F.col(right_time).alias("_t"), F.col(order).alias("_o"), F.lit(0).alias("_side"), F.lit(None).cast(one.schema["_ask"].dataType).alias("_ask"), taken.alias("_p"))
    both = one.withColumn("_p", F.lit(None).cast(kind)).unionByName(two)
    w = Window.partitionBy(*keys)
    last = lambda down: F.last("_p", ignorenulls=True).over(w.orderBy(down("_t"), "_side", down("_o")).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_ahead", last(F.desc)).withColumn("_back", last(F.asc)).where("_side = 1")
    hit = F.when(F.col("_ask.f"), F.col("_ahead")).otherwise(F.col("_back"))
    hits = found.groupBy(F.col(name).alias("_name")).agg(*(F.max(F.when(F.col("_ask.p") == p, hit)).alias(f"_hit_{p}") for p in asked))
    met = left.join(hits, F.col(name) == F.col("_name"), "left")
    return met.select(*left.columns, *(F.col(f"_hit_{p}")[c].alias(f"{p}{c}") for p in asked for c in payload))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, payload: list[str], order: str | None = None, prefix: str = "near_", span: int | None = None) -> DataFrame:
    """``left`` with the right row nearest in time: the earlier one of two equally near, the first before
    all rows, the last behind all. Times are whole numbers (or anything whose difference can be compared).
    span: width in units of time (then whole numbers) of what is searched in parallel.
    """
    order = order or right_time
    cols = list(dict.fromkeys([*payload, right_time]))
    here = F.struct(*(F.col(c).alias(c) for c in cols))
    # of rows of equal time the last one counts from behind, the first one from before
    sides = right.select(*keys, F.col(right_time).alias("_rt"), F.col(order).alias("_ro"), here.alias("here"))
    found = asof(left, sides, keys, left_time, "_rt", ["here"], False, "_ro", "_b_", span)
    found = asof(found, sides, keys, left_time, "_rt", ["here"], True, "_ro", "_a_", span)
    gap = lambda c: F.abs(F.col(c)[right_time] - F.col(left_time))
    pick = F.when(F.col("_b_here").isNull() | (gap("_a_here") < gap("_b_here")), F.col("_a_here")).otherwise(F.col("_b_here"))
    return found.withColumn("_pick", pick).select(*left.columns, *(F.col("_pick")[c].alias(f"{prefix}{c}") for c in payload))


#: Rows of one side of a bucket that one task should have.
DENSE = 50_000
#: Dense buckets that may go to all workers, about 100 bytes each; more are joined by an exchange.
BUCKETS = 200_000


def dealt(one: DataFrame, two: DataFrame, on: list[str], dense: int = DENSE) -> tuple[DataFrame, DataFrame]:
    """Both sides of an equi-join on ``on`` with two more columns to join on, ``_l`` and ``_r``, that part dense keys.

    Keys with more than ``dense`` rows on a side are counted first. Such a key is a grid of tasks: each row of ``one`` belongs to
    one line of it and is copied along the line, each row of ``two`` to one column. Other keys are one cell.
    """
    n = lambda df, name: df.groupBy(*on).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > dense)
    cells = n(one, "_nl").join(n(two, "_nr"), on, "full").select(*on, F.ceil(F.coalesce("_nl", F.lit(1)) / dense).alias("_nl"), F.ceil(F.coalesce("_nr", F.lit(1)) / dense).alias("_nr"))
    cells = materialised(cells)
    small = F.broadcast(cells) if cells.count() <= BUCKETS else cells
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(c), F.lit(1)) - 1))
    own = lambda df, c: F.pmod(F.xxhash64(*(x for x in df.columns if x not in ("_nl", "_nr"))), F.coalesce(F.col(c), F.lit(1)))
    a, b = one.join(small, on, "left"), two.join(small, on, "left")
    a = a.withColumn("_l", own(one, "_nl")).withColumn("_r", every("_nr"))
    b = b.withColumn("_r", own(two, "_nr")).withColumn("_l", every("_nl"))
    return a.drop("_nl", "_nr"), b.drop("_nl", "_nr")


def within(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, before: int, after: int, bucket: int | None = None, dense: int | None = None) -> DataFrame:
    """Pairs whose right time is in [left - before, left + after] (whole numbers).

    Rows meet by key and bucket of time, so a long series isn't compared with every event: each left row
    goes to the few buckets that its interval touches. dense: rows of a bucket beyond which it is parted (``dealt``); None
    counts nothing, for series whose buckets are known to be even.
    """
    bucket = bucket or max(1, before + after)
    lo, hi = F.floor((F.col(left_time) - before) / bucket), F.floor((F.col(left_time) + after) / bucket)
    one = left.withColumn("_bucket", F.explode(F.sequence(lo, hi)))
    two = right.withColumn("_bucket", F.floor(F.col(right_time) / bucket))
    on = [*keys, "_bucket"]
    if dense:
        one, two = dealt(one, two, on, dense)
        on += ["_l", "_r"]
    one, two = one.alias("l"), two.alias("r")
    met = one.join(two, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in on] + [F.col(f"r.{right_time}").between(F.col(f"l.{left_time}") - before, F.col(f"l.{left_time}") + after)])
    return met.select(*(F.col(f"l.{c}") for c in left.columns), *(F.col(f"r.{c}") for c in right.columns if c not in keys))


def within_sums(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, before: int, after: int, left_sums: dict[str, Column], right_sums: dict[str, Column], dense: int | None = None) -> DataFrame:
    """What ``within`` would make pairs of, summed: one row for each of ``keys`` and left time with a pair, ``pairs`` (their number) and
    the sums of whole numbers of either side over all pairs, exact in decimals.

    Rows of equal time count as one: each side is summed by time before they meet, so the work grows with the times, not with the pairs.
    """
    whole = lambda c: c.cast("decimal(38,0)")
    at = lambda df, time, n, sums: df.groupBy(*keys, time).agg(F.count(F.lit(1)).alias(n), *(F.sum(whole(c)).alias(f"_{k}") for k, c in sums.items()))
    met = within(at(left, left_time, "_n1", left_sums), at(right, right_time, "_n2", right_sums), keys, left_time, right_time, before, after, dense=dense)
    # a left row stands in as many pairs as there are right rows, and the other way round; the left side is the same in all of the group
    by = met.groupBy(*keys, left_time, "_n1", *(f"_{k}" for k in left_sums)).agg(F.sum("_n2").alias("_n2"), *(F.sum(whole(F.col(f"_{k}"))).alias(f"_{k}_") for k in right_sums))
    sums = [(whole(F.col(f"_{k}")) * F.col("_n2")).cast("decimal(38,0)").alias(k) for k in left_sums] + [(whole(F.col(f"_{k}_")) * F.col("_n1")).cast("decimal(38,0)").alias(k) for k in right_sums]
    return by.select(*keys, left_time, (F.col("_n1") * F.col("_n2")).alias("pairs"), *sums)


def last_at_or_before(value: Column, offset: Column) -> Column:
    """Aggregate: the value of the largest offset up to 0, else of the smallest offset."""
    return F.coalesce(F.max_by(F.when(offset <= 0, value), F.when(offset <= 0, offset)), F.min_by(value, offset))


def slices(events: DataFrame, points: DataFrame, keys: list[str], first: str, last: str, idx: str, columns: list[str], bucket: int = 256, dense: int | None = None) -> DataFrame:
    """Rows of ``events`` with ``points``: the ordered array of their series' points in [first, last].

    Only places meet the points, each once: key, first and last. Events, with all their columns, get what was cut
    afterwards, so equal events and a task that runs again do no harm. ``idx`` must be unique in a series. dense: places of
    a bucket beyond which it is parted, as in ``within``.
    """
    place = [*keys, first, last]
    one = events.select(*place).distinct().withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(first) / bucket), F.floor(F.greatest(F.col(first), F.col(last)) / bucket))))
    two = points.select(*keys, F.floor(F.col(idx) / bucket).alias("_bucket"), F.struct(F.col(idx).alias(idx), *(F.col(c).alias(c) for c in columns if c != idx)).alias("_p"))
    on = [*keys, "_bucket"]
    if dense:
        one, two = dealt(one, two, on, dense)
        on += ["_l", "_r"]
    met = one.join(two, on).where(F.col(f"_p.{idx}").between(F.col(first), F.col(last)))
    cut = met.groupBy(*place).agg(F.array_sort(F.collect_list("_p")).alias("points"))
    return events.join(cut, place).select(*events.columns, "points")
