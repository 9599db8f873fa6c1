"""Stateful stream: equal to the rows at rest, after shuffled and late input, with state that shrinks."""

import random
from datetime import datetime, timedelta

import pytest

from strideframe.streaming import windows

START = datetime(2024, 3, 1, 12)


def rows(seed, seconds, keys="abc"):
    r = random.Random(seed)
    out = []
    for k in keys:
        at = 0
        while at < seconds * 1000:
            at += r.choice([0, 1, 40, 700, 2500])
            out.append((k, START + timedelta(milliseconds=at, microseconds=r.randrange(1000)), r.choice([0.0, 5.0, 19.0, 21.0, -25.0])))
    return out


def run(spark, tmp_path, batches, name, **options):
    """Each batch is a file; gives what came out and the rows in state after each batch."""
    schema = "k string, ts timestamp, v double"
    src = tmp_path / name
    src.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    found = windows.crossings(stream, "k", "ts", "v", **options)
    q = found.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
    held = []
    try:
        for batch in batches:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(src))
            q.processAllAvailable()
            held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    finally:
        q.stop()
    return sorted(map(tuple, spark.table(name).collect())), held


@pytest.fixture
def few(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_shuffled_input_equals_rows_at_rest(spark, tmp_path, few):
    """Rows up to nine seconds behind the latest, in any order; a pause longer than the idle time; a last row far ahead."""
    r = random.Random(1)
    first, second = rows(1, 60), [(k, t + timedelta(minutes=5), v) for k, t, v in rows(2, 30, "ab")]
    every = first + second
    shuffled = sorted(every, key=lambda x: x[1] + timedelta(seconds=r.uniform(0, 9)))
    n = len(shuffled) // 5 + 1
    batches = [r.sample(b, len(b)) for b in (shuffled[i : i + n] for i in range(0, len(shuffled), n))]
    end = [("z", START + timedelta(hours=3), 0.0)]
    got, held = run(spark, tmp_path, [*batches, end, [("z", START + timedelta(hours=6), 0.0)]], "shuffled", idle_ms=60_000)
    at_rest = windows.crossings_of(spark.createDataFrame(every, "k string, ts timestamp, v double"), "k", "ts", "v", idle_ms=60_000)
    want = sorted(map(tuple, at_rest.collect()))
    assert len(want) > 20 and got == want
    assert max(held) > 20 and held[-1] < 6, held


def test_rows_that_come_too_late_are_dropped(spark, tmp_path, few):
    base = [("a", START + timedelta(seconds=s), 0.0) for s in range(40)]
    late = [("a", START + timedelta(seconds=3), 99.0)]
    got, _ = run(spark, tmp_path, [base, [("a", START + timedelta(seconds=60), 30.0)], late, [("a", START + timedelta(hours=2), 0.0)], [("a", START + timedelta(hours=4), 0.0)]], "late")
    assert got == [("a", START + timedelta(seconds=60), 30.0, 0)]
