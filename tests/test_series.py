"""Series and as-of operators against plain loops on random series: micro-fixtures F3, F4, F6, F7, F11, F18."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.operators import aggregates, asof, resample, series

KEYS = ["k"]


def random_series(seed, n_keys=30):
    r = random.Random(seed)
    out = {}
    for k in range(n_keys):
        out[k] = [(r.choice([-21.0, -20.0, -13.0, 0.0, 1.0, 12.0, 14.0, 20.0, 20.5]), r.choice([None, 1.0, 2.0, 2.0, 3.0])) for _ in range(r.randrange(1, 25))]
    return out


@pytest.fixture(scope="module")
def data():
    return random_series(1)


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = [(k, i, x, a) for k, s in data.items() for i, (x, a) in enumerate(s)]
    return spark.createDataFrame(rows, "k int, idx long, x double, a double")


def collect(df, name):
    return {(r.k, r.idx): r[name] for r in df.select("k", "idx", name).collect()}


def test_searches_ahead(frame, data):
    cross = collect(frame.withColumn("v", series.next_match(series.crossing(F.col("x")), KEYS)), "v")
    gate = collect(frame.withColumn("v", series.next_match(series.gate(F.col("x")), KEYS)), "v")
    turn = collect(frame.withColumn("v", series.reversal("x", KEYS)), "v")
    back = collect(frame.withColumn("v", series.run_start("a", KEYS)), "v")
    for k, s in data.items():
        for i in range(len(s)):
            assert cross[k, i] == next((j for j in range(i, len(s)) if abs(s[j][0]) > 20), None)
            assert gate[k, i] == next((j for j in range(i, len(s)) if 12 <= abs(s[j][0]) <= 14), None)
            later = [x for x, _ in s[i + 1 :]]
            assert turn[k, i] == (any(x < s[i][0] for x in later) and any(x > s[i][0] for x in later))
            j = i
            while j > 0 and s[j][1] is not None and s[j - 1][1] is not None and s[j - 1][1] >= s[j][1]:
                j -= 1
            assert back[k, i] == j


def test_smoothing_and_gradient(frame, data):
    avg = collect(frame.withColumn("v", series.moving_average("x", KEYS, 5)), "v")
    slope = collect(frame.withColumn("v", series.gradient("x", KEYS, 0.5)), "v")
    kept = collect(frame.withColumn("v", series.carried_forward(F.col("a"), KEYS)), "v")
    for k, s in data.items():
        x = np.array([p[0] for p in s])
        want = np.convolve(x, np.ones(5) / 5, "same") if len(x) >= 5 else x
        grad = np.gradient(x, 0.5) if len(x) > 1 else [None]
        last = None
        for i in range(len(s)):
            last = s[i][1] if s[i][1] is not None else last
            assert avg[k, i] == pytest.approx(want[i]) and kept[k, i] == last
            assert slope[k, i] == (pytest.approx(grad[i]) if grad[i] is not None else None)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 10, 11, 12, 40])
def test_savitzky_golay(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "k int, idx long, x double")
    got = [r[1] for r in sorted(df.select("idx", series.smoothed("x", KEYS)).collect())]
    w = min(11, n if n % 2 else n - 1)
    want = x.copy()
    if w >= 3:
        h = w // 2
        for i in range(n):
            b = min(max(i - h, 0), n - w)
            want[i] = np.polyval(np.polyfit(np.arange(w), x[b : b + w], 2), i - b)
    assert got == pytest.approx(want, abs=1e-8)


def test_hat_matrix_rows():
    assert [round(429 * c) for c in series.hat_matrix(11)[5]] == [-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36]


def sides(spark, seed):
    r = random.Random(seed)
    left = [(k, r.randrange(0, 200), n) for n, k in enumerate(r.choice(range(12)) for _ in range(150))]
    right = [(k, t, i) for k in range(10) for i, t in enumerate(sorted(r.choice(range(0, 200, 3)) for _ in range(r.choice([1, 2, 30]))))]
    return left, right, spark.createDataFrame(left, "k int, t long, n int"), spark.createDataFrame(right, "k int, rt long, i int")


@pytest.mark.parametrize("span", [None, 7, 64])
def test_asof(spark, span):
    left, right, a, b = sides(spark, 5)
    ahead = {r.n: r.hit_i for r in asof.asof(a, b, KEYS, "t", "rt", ["i"], True, "i", span=span).collect()}
    before = {r.n: r.hit_i for r in asof.asof(a, b, KEYS, "t", "rt", ["i"], False, "i", span=span).collect()}
    assert len(ahead) == len(before) == 150
    for k, t, n in left:
        own = [(rt, i) for q, rt, i in right if q == k]
        assert ahead[n] == next((i for rt, i in own if rt >= t), None)
        assert before[n] == next((i for rt, i in reversed(own) if rt <= t), None)


def test_nearest(spark):
    left, right, a, b = sides(spark, 6)
    got = {r.n: r.near_i for r in asof.nearest(a, b, KEYS, "t", "rt", ["i"], "i").collect()}
    for k, t, n in left:
        own = [(rt, i) for q, rt, i in right if q == k]
        if not own:
            assert got[n] is None
            continue
        j = 0
        while j + 1 < len(own) and own[j + 1][0] <= t:
            j += 1
        if j + 1 < len(own) and abs(own[j + 1][0] - t) < abs(own[j][0] - t):
            j += 1
        assert got[n] == own[j][1], (own, t)


def test_within_and_slices(spark):
    left, right, a, b = sides(spark, 7)
    got = sorted((r.n, r.i, r.rt) for r in asof.within(a, b, KEYS, "t", "rt", 20, 5).collect())
    assert got == sorted((n, i, rt) for k, t, n in left for q, rt, i in right if q == k and t - 20 <= rt <= t + 5)
    ev = a.withColumn("lo", F.lit(3)).withColumn("hi", F.lit(300))
    cut = {r.n: [p.i for p in r.points] for r in asof.slices(ev, b, KEYS, "lo", "hi", "i", ["rt"], bucket=4).collect()}
    for k, _, n in left:
        assert cut.get(n, []) == [i for q, _, i in right if q == k and 3 <= i <= 300]
    twice = asof.slices(ev.union(ev), b, KEYS, "lo", "hi", "i", ["rt"], bucket=4).collect()
    assert sorted((r.n, [p.i for p in r.points]) for r in twice) == sorted((n, i) for n, i in cut.items() for _ in range(2))


def test_aggregates(spark):
    df = spark.createDataFrame([(0, 0, 5.0), (0, 1, 7.0), (0, 2, 7.0), (0, 3, None), (1, 0, None), (2, 0, 1.0), (2, 1, 1.0 + 5e-7)], "k int, idx int, v double")
    best = dict((r.k, r.b) for r in df.groupBy("k").agg(aggregates.argmax_first(F.col("idx"), F.col("v"), F.col("idx")).alias("b")).collect())
    assert best == {0: 1, 1: None, 2: 1}
    last = {r.k: r.last_idx for r in aggregates.last_near_max(df, KEYS, "v", "idx").collect()}
    assert last == {0: 2, 2: 1}
    spread = dict((r.k, r.s) for r in df.groupBy("k").agg(aggregates.spread_if_enough(F.col("v")).alias("s")).collect())
    assert spread[0] == pytest.approx(np.std([5, 7, 7], ddof=1)) and spread[1] is None and spread[2] is None
    moving = spark.createDataFrame([("c", f, "m", x, 0.0, 0.0) for f, x in enumerate([5.0, 4.0, 3.9, 0.1, 0.0])], "clip_id string, frame int, joint string, x double, y double, z double")
    assert aggregates.calm_frame(moving, ["clip_id"], "frame", F.col("x") ** 2).first().frame == 4
    assert aggregates.still_frame(moving, ["clip_id"], "joint", "frame", ["x", "y", "z"]).first().frame in (2, 4)


def test_resampling(spark):
    clocks = [0.0, 0.5, 1.999, 2.0, 2.5, 3.0, 7.25, -0.5]
    df = spark.createDataFrame([(c,) for c in clocks], "c double")
    n = F.lit(4)
    for loop in (True, False):
        pos = resample.frame_position(F.col("c"), F.lit(1.0), n, loop)
        lo, hi, share = resample.neighbours(pos, n, loop)
        for c, r in zip(clocks, df.select(lo.alias("lo"), hi.alias("hi"), share.alias("share"), resample.nearest_frame(pos, n).alias("near")).collect()):
            p = c % 4 if loop else max(0.0, min(c, 3.0))
            a = min(int(p), 3)
            assert (r.lo, r.hi) == (a, a + 1 if a + 1 < 4 else (0 if loop else 3)) and r.share == pytest.approx(p - a)
            assert r.near == min(3, round(p))
    assert math.isclose(spark.range(5).select(series.frame_seconds(F.col("id") * 0.1)).first()[0], 0.1)


def test_several_lookups_equal_one_by_one(spark):
    r = random.Random(8)
    right = spark.createDataFrame([(r.randrange(3), i, r.randrange(60)) for i in range(200)], "k int, id long, t long")
    left = spark.createDataFrame([(r.randrange(4), i, r.randrange(-5, 70), r.randrange(70)) for i in range(60)], "k int, no long, a long, b long")
    got = asof.lookups(left, right, KEYS, "no", {"f_": ("a", True), "w_": ("b", True), "e_": ("b", False)}, "t", ["id", "t"], "id")
    want = left
    for p, t, forward in (("f_", "a", True), ("w_", "b", True), ("e_", "b", False)):
        want = asof.asof(want, right, KEYS, t, "t", ["id", "t"], forward, "id", p)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 3
