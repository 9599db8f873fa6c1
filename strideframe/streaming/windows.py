"""Extension: the series operators on streams (the original has no streams).

``tumbling`` is a windowed aggregate with a watermark. ``crossings`` gives a row when a recording's point goes beyond the
line, and equals ``crossings_of`` on the same rows at rest, in whatever order and batches they come: points wait in
state until the watermark has passed them and a timer takes them in order of time. Only what later points can
ask for is held: the times of the last ``back_ms``, and whether the last point was beyond. A recording that is
silent for ``idle_ms`` loses its state; a point after such a pause is a first one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CROSSING = "key string, crossed_at timestamp, x double, points_before long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tumbling(stream: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours", keys: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def _points(df: DataFrame, key: str, time: str, x: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("t"), F.col(x).cast("double").alias("x")).where("key is not null and t is not null and x is not null")


def crossings_of(df: DataFrame, key: str, time: str, x: str, line: float = 20.0, back_ms: int = 3000, idle_ms: int = 3_600_000) -> DataFrame:
    """Points beyond the line whose point before isn't (or is more than ``idle_ms`` ago), and how many of the ``back_ms`` before came earlier.

    Points of one time stand in order of ``x``. Rows without key, time or value don't count.
    """
    p = _points(df, key, time, x).withColumn("ms", F.unix_millis("t")).withColumn("beyond", F.abs("x") > line)
    w = Window.partitionBy("key").orderBy("t", "x")
    again = F.lag("beyond").over(w) & (F.col("ms") - F.lag("ms").over(w) <= idle_ms)
    same = F.row_number().over(Window.partitionBy("key", "ms").orderBy("t", "x")) - 1
    earlier = F.count(F.lit(1)).over(Window.partitionBy("key").orderBy("ms").rangeBetween(-back_ms, -1))
    found = p.withColumn("_again", F.coalesce(again, F.lit(False))).withColumn("points_before", (earlier + same).cast("long"))
    return found.where("beyond and not _again").select("key", F.col("t").alias("crossed_at"), "x", "points_before")


class Crossings(StatefulProcessor):
    def __init__(self, line: float, back_ms: int, idle_ms: int):
        self.line, self.back_ms, self.idle_ms = line, back_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms bigint", "points array<struct<us:bigint,x:double>>")
        self.past = handle.getValueState("past", "times array<bigint>, beyond boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for part in rows:
            micros = part["t"].astype("datetime64[us]").astype("int64")
            for ms, own in part.assign(us=micros).groupby(micros // 1000):
                points = list(zip(own["us"].tolist(), own["x"].tolist()))
                if self.waiting.containsKey((ms,)):
                    points += [tuple(p) for p in self.waiting.getValue((ms,))[0]]
                else:
                    self.handle.registerTimer(int(ms))
                self.waiting.updateValue((ms,), (points,))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        times, beyond = ([int(t) for t in self.past.get()[0]], bool(self.past.get()[1])) if self.past.exists() else ([], False)
        if self.waiting.containsKey((now,)):
            points = sorted(tuple(p) for p in self.waiting.getValue((now,))[0])
            self.waiting.removeKey((now,))
            if times and now - times[-1] > self.idle_ms:
                beyond = False
            times = [t for t in times if t >= now - self.back_ms]
            for us, x in points:
                here = abs(x) > self.line
                if here and not beyond:
                    out.append((key[0], pd.Timestamp(us, unit="us"), x, len(times)))
                beyond = here
                times.append(now)
            self.past.update((times, beyond))
            self.handle.registerTimer(now + self.idle_ms + 1)
        elif times and now - times[-1] > self.idle_ms:
            self.past.clear()
        return iter([pd.DataFrame(out, columns=["key", "crossed_at", "x", "points_before"])] if out else [])

    def close(self) -> None:
        pass


def crossings(stream: DataFrame, key: str, time: str, x: str, line: float = 20.0, back_ms: int = 3000, idle_ms: int = 3_600_000, late: str = "10 seconds") -> DataFrame:
    """``crossings_of`` for a stream whose rows come at most ``late`` behind the latest; later ones are dropped.

    State is kept by RocksDB, so that it may outgrow an executor's memory; the session's setting is changed to it.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = _points(stream, key, time, x).withWatermark("t", late)
    return rows.groupBy("key").transformWithStateInPandas(Crossings(line, back_ms, idle_ms), CROSSING, "append", "eventTime")
