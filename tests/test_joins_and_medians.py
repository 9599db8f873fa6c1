"""Substring join, exact medians, dense interval joins: against plain restatements, and what their plans must not do."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from strideframe.operators import asof, contained, medians


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_substring_join(spark):
    r = random.Random(1)
    names = ["".join(r.choice("abäc ") for _ in range(r.randrange(0, 14))) for _ in range(150)] + [None, "", "ab", "ab"]
    parts = ["".join(r.choice("abäc ") for _ in range(r.randrange(0, 6))) for _ in range(60)] + [None, "", "zz", "b"]
    texts = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    frags = spark.createDataFrame(list(enumerate(parts)), "j int, f string")
    for q in (1, 3):
        got = contained.containing(texts, "name", frags, "f", q)
        assert got.columns == ["i", "name", "j", "f"] and "NestedLoop" not in plan(got)
        assert sorted((x.i, x.j) for x in got.collect()) == [(i, j) for i, n in enumerate(names) for j, f in enumerate(parts) if n is not None and f is not None and f in n]
    none = contained.containing(texts, "name", frags.limit(0), "f")
    assert none.collect() == []


@pytest.mark.parametrize(("bins", "enough"), [(2, 1), (7, 3), (1024, 4096)])
def test_medians(spark, bins, enough):
    r = random.Random(bins)
    groups = {"one": [5.0], "two": [1.0, 4.0], "ties": [3.0] * 50 + [9.0] * 50, "odd": [r.gauss(0, 1) for _ in range(301)], "even": [r.expovariate(1e-6) for _ in range(400)], "far": [-1.7e308, 1.7e308, 1.0, 2.0], None: [r.choice([1.0, 2.0]) for _ in range(99)]}
    rows = [(k, v) for k, own in groups.items() for v in own] + [("none", None), ("odd", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {x.k: x.median for x in medians.medians(df, ["k"], "v", bins, enough).collect()}
    want = {k: statistics.median(v) for k, v in groups.items()} | {"none": None}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == (v if v is None else pytest.approx(v, rel=1e-15)), k
    every = [v for _, v in rows if v is not None]
    assert medians.medians(df, [], "v", bins, enough).first().median == pytest.approx(statistics.median(every))


def test_dense_interval_join_is_even(spark):
    """All events in one minute of one recording: no task has more than twice the median's pairs, and no pair is lost."""
    left = spark.range(1200).select(F.lit("r").alias("k"), "id", (F.col("id") % 60).alias("t"))
    right = spark.range(900).select(F.lit("r").alias("k"), F.col("id").alias("other"), (F.col("id") % 60).alias("u"))
    met = asof.within(left, right, ["k"], "t", "u", 60, 60, dense=100)
    assert met.count() == 1200 * 900 and met.select("id", "other").distinct().count() == 1200 * 900
    one, two = asof.dealt(left, right, ["k"], 100)
    cells = [x.n for x in one.join(two, ["k", "_l", "_r"]).groupBy("_l", "_r").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(cells) == 108 and max(cells) <= 2 * statistics.median(cells)
    sparse = asof.within(left, right, ["k"], "t", "u", 0, 1, dense=10**6)
    assert sorted(map(tuple, sparse.collect())) == sorted(map(tuple, asof.within(left, right, ["k"], "t", "u", 0, 1).collect()))


def test_dense_slices(spark):
    points = spark.range(500).select(F.lit("r").alias("k"), F.col("id").alias("idx"), (F.col("id") * 2).alias("x"))
    ev = spark.createDataFrame([("r", i, 10 + i % 3, 300 + i % 5) for i in range(200)] + [("r", 1, 11, 301)], "k string, id long, a long, b long")
    rows = lambda df: sorted((x.id, x.a, x.b, [tuple(p) for p in x.points]) for x in df.collect())
    assert rows(asof.slices(ev, points, ["k"], "a", "b", "idx", ["x"], dense=20)) == rows(asof.slices(ev, points, ["k"], "a", "b", "idx", ["x"]))


def test_substring_join_of_equal_fragments(spark, monkeypatch):
    """Pairs of one fragment with many rows are told by many tasks, whether its rows go to all of them or are dealt out."""
    texts = spark.range(0, 400, 1, 1).select(F.col("id").alias("i"), F.concat(F.lit("part "), F.col("id")).alias("name"))
    frags = spark.range(0, 300, 1, 1).select(F.col("id").alias("j"), F.element_at(F.array(F.lit("pa"), F.lit("rt 1"), F.lit("7")), (F.col("id") % 3 + 1).cast("int")).alias("f"))
    want = sorted((i, j) for i in range(400) for j in range(300) if ("pa", "rt 1", "7")[j % 3] in f"part {i}")
    for few in (contained.PIECES, 5):
        monkeypatch.setattr(contained, "PIECES", few)
        got = contained.containing(texts, "name", frags, "f", pairs=2000)
        assert got.columns == ["i", "name", "j", "f"] and sorted((x.i, x.j) for x in got.collect()) == want
        tasks = [x.n for x in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(tasks) == len(want) and max(tasks) <= (2 if few > 5 else 6) * 2000


def test_interval_sums_make_no_pairs(spark):
    """Sums over all pairs equal those of the pairs; 10^12 pairs of few times are summed at once."""
    r = random.Random(4)
    left = spark.createDataFrame([(r.choice("ab"), r.randrange(30), r.randrange(-9, 9)) for _ in range(300)] + [("c", 1, 1), (None, 1, 1), ("a", None, 1)], "k string, t long, v long")
    right = spark.createDataFrame([(r.choice("ab"), r.randrange(30), r.choice([None, 5, 2**60])) for _ in range(200)] + [(None, 1, 1), ("b", None, 1)], "k string, u long, w long")
    pairs = asof.within(left, right, ["k"], "t", "u", 2, 3)
    want = pairs.groupBy("k", "t").agg(F.count(F.lit(1)), F.sum("v").cast("decimal(38,0)"), F.sum(F.col("w").cast("decimal(38,0)")).cast("decimal(38,0)"))
    got = asof.within_sums(left, right, ["k"], "t", "u", 2, 3, {"v": F.col("v")}, {"w": F.col("w")}, dense=3)
    assert got.columns == ["k", "t", "pairs", "v", "w"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    many = spark.range(1_000_000).select(F.lit("r").alias("k"), "id", (F.col("id") % 60).alias("t"))
    got = asof.within_sums(many, many.withColumnRenamed("t", "u"), ["k"], "t", "u", 60, 60, {}, {"s": F.col("id")}, dense=20)
    assert [int(x) for x in got.agg(F.sum("pairs"), F.sum("s")).first()] == [10**12, 10**6 * (10**6 - 1) // 2 * 10**6]


def test_slices_carry_places_only(spark):
    """Columns of events don't go through the join with the points; equal places are cut once."""
    points = spark.range(50).select(F.lit("r").alias("k"), F.col("id").alias("idx"), (F.col("id") * 2).alias("x"))
    ev = spark.createDataFrame([("r", i, "text", 3, 5) for i in range(40)] + [("r", 1, "text", 3, 5), ("s", 1, "text", 3, 5)], "k string, id long, said string, a long, b long")
    got = asof.slices(ev, points, ["k"], "a", "b", "idx", ["x"])
    assert got.columns == [*ev.columns, "points"] and sorted(r.id for r in got.collect()) == sorted([*range(40), 1]) and all([p.x for p in r.points] == [6, 8, 10] for r in got.collect())
    assert all("said" not in line for line in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in line)
