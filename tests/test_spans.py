"""Windows in spans equal the plain ones, whatever the span, with one series that holds most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strideframe.operators import asof, series, spans

KEYS, ORDER = ["k"], ["t", "id"]


@pytest.fixture(scope="module")
def frame(spark):
    r = random.Random(2)
    rows, i = [], 0
    for k, n in ((1, 300), (2, 20), (3, 1), (None, 30)):
        t = 0
        for _ in range(n):
            t += r.choice([0, 1, 1, 2, 40])
            rows.append((k, i, t, r.choice([None, -21.0, 0.0, 12.0, 20.5, 20.5, 3.0]), r.choice([None, 1.0, 2.0, 3.0])))
            i += 1
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, id long, t long, x double, a double").repartition(5)
    return series.indexed(df, KEYS, ORDER).cache()


def same(one, two, *columns):
    rows = lambda df: sorted(map(repr, df.select("id", *columns).collect()))
    assert rows(one) == rows(two)


@pytest.mark.parametrize("width", [1, 7, 64, 10**6])
def test_spans_equal_plain_windows(frame, width):
    span = F.floor(F.col("t") / width)
    same(spans.indexed(frame.drop("idx"), KEYS, ORDER, span), frame, "idx")
    beyond = series.crossing(F.col("x"))
    plain = frame.withColumn("v", series.next_match(beyond, KEYS)).withColumn("c", series.carried_forward(F.col("x"), KEYS))
    lag = Window.partitionBy("k").orderBy("idx")
    plain = plain.withColumn("b", F.lag("x").over(lag)).withColumn("n", F.lead("x").over(lag))
    got = spans.scanned(frame, KEYS, ORDER, span, m=spans.next_match(beyond, F.struct("idx", "id")), c=spans.carried_forward(F.col("x")), p=spans.before(F.col("x")), q=spans.after(F.col("x")))
    same(got.withColumn("v", F.col("m.idx")).withColumn("b", F.col("p.v")).withColumn("n", F.col("q.v")), plain, "v", "c", "b", "n")
    hits = frame.select(F.col("k").alias("hk"), F.col("idx").alias("v"), F.col("id").alias("hit"))
    joined = plain.join(hits, plain["k"].eqNullSafe(hits["hk"]) & (plain["v"] == hits["v"]), "left")
    same(got.withColumn("hit", F.col("m.id")), joined, "hit")
    same(spans.reversals(frame, "x", KEYS, ORDER, span), frame.withColumn("reversal", series.reversal("x", KEYS)), "reversal")
    same(spans.run_starts(frame, "a", KEYS, ORDER, span), frame.withColumn("run_start", series.run_start("a", KEYS)), "run_start")
    total = F.sum("x").over(lag.rowsBetween(Window.unboundedPreceding, 0))
    same(spans.scanned(frame, KEYS, ORDER, span, s=spans.Scan("sum", F.col("x"))), frame.withColumn("s", total), "s")


@pytest.mark.parametrize("width", [1, 5, 1000])
def test_frames_of_bounded_width(frame, width):
    peak = series.trailing_peak(F.col("x"), KEYS, F.col("t"), 6)
    same(spans.trailing_peaks(frame, F.col("x"), KEYS, "t", 6, width), frame.withColumn("peak", peak), "peak")
    filled = frame.withColumn("x", F.coalesce("x", F.lit(1.5)))
    for n in (1, 4, 5):
        same(spans.moving_averages(filled, "x", KEYS, n, "idx", width, "v").withColumn("v", F.round("v", 9)), filled.withColumn("v", F.round(series.moving_average("x", KEYS, n), 9)), "v")
    same(spans.gradients(filled, "x", KEYS, 0.5, "idx", width, "v"), filled.withColumn("v", series.gradient("x", KEYS, 0.5)), "v")


@pytest.mark.parametrize("width", [1, 9, 10**6])
def test_nearest_in_spans(frame, width):
    left = frame.where("id % 3 = 0 and k is not null").select("k", "id", "t")
    right = frame.where("id % 3 = 1 and k = 1").select("k", "t", F.col("id").alias("other"))
    rows = right.collect()
    got = {r.id: (r.near_t, r.near_other) for r in asof.nearest(left, right, KEYS, "t", "t", ["t", "other"], "other", span=width).collect()}
    for r in left.collect():
        own = [(abs(s.t - r.t), s.t) for s in rows if s.k == r.k]
        t = min(own)[1] if own else None
        at = [s.other for s in rows if s.t == t and s.k == r.k]
        assert got[r.id][0] == t and (got[r.id][1] in at if own else got[r.id][1] is None)
        if own:  # from behind the last of equal times, from ahead the first
            assert got[r.id][1] == (max(at) if t <= r.t else min(at))


def test_no_task_holds_the_series(spark):
    """All rows in one series: the windows over rows are by key and span, those by key see one row a span."""
    df = spark.range(0, 4000, 1, 4).select(F.lit(1).alias("k"), F.col("id"), F.col("id").alias("t"), F.rand(1).alias("x"))
    got = spans.scanned(df, KEYS, ["t"], F.floor(F.col("t") / 100), v=spans.next_match(F.col("x") > 0.99, F.col("t")))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_span" in plan and got.count() == 4000
    summed = got.groupBy().agg(F.count("v"))
    assert summed.first()[0] > 0


def test_trailing_peaks_have_no_sliding_frame(spark):
    """All rows in one frame: what slides would be evaluated rows times rows."""
    df = spark.range(0, 3000, 1, 4).select(F.lit(1).alias("k"), F.col("id"), (F.col("id") * 7 % 1000 - 300).alias("t"), (F.col("id") * 37 % 1009).alias("x"))
    rows = df.collect()
    for back in (0, 1, 13, 5000):
        got = spans.trailing_peaks(df, F.col("x"), ["k"], "t", back, 100)
        best = {t: max((r.x for r in rows if t - back <= r.t <= t)) for t in {r.t for r in rows[:200]}}
        assert got.columns == [*df.columns, "peak"] and got.count() == 3000
        assert all(r.peak == best[r.t] for r in got.collect() if r.t in best)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("specifiedwindowframe(RangeFrame, unboundedpreceding$(), currentrow$())") >= 2 and "specifiedwindowframe(RangeFrame, -" not in plan
