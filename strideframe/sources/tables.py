"""Text sources (SRC01-SRC17). Explicit schemas, columns by name, bad values null.

Files with different header orders can't be read together (columns go by position), so files are grouped
by their header line first, of which only the first bytes are read. Rows are read in blocks and numbered as
``text_files`` tells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import millimetres, thousands_to_long, to_double, to_long
from ..functions.text import first_filled, marker_stems, strip
from ..functions.times import track_time
from ..operators.fixtures import missing
from ..schemas import BALL_REQUIRED, EVENT_COLUMNS, KEEPER_NAMES, KEEPER_REQUIRED, SHOTS  # noqa: F401
from . import text_files
from .text_files import lines

POSITIONS = "*_2_phases_positions.csv"


def events(spark: SparkSession, path: str) -> DataFrame:
    """Event rows, all text, with ``row_idx`` in file order, without gaps; columns that a file lacks are null."""
    parts = []
    for columns, rows in text_files.delimited(spark, text_files.by_header(spark, path)):
        df = rows.select("row.*", F.col("ordinal").alias("row_idx"))
        for c in EVENT_COLUMNS:
            if c not in columns:
                df = df.withColumn(c, F.lit(None).cast("string"))
        parts.append(df)
    none = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in EVENT_COLUMNS) + ", row_idx long")  # a folder may be empty
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else none


def files(spark: SparkSession, path: str, glob: str = POSITIONS) -> DataFrame:
    """file_name of every matching file; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.element_at(F.split("path", "/"), -1).alias("file_name")).orderBy("file_name")


def positions(spark: SparkSession, path: str, required: tuple[str, ...] = BALL_REQUIRED, glob: str = POSITIONS) -> tuple[DataFrame | None, DataFrame]:
    """Raw rows with ``fixture_file`` and ``file_ord`` of files that have all required columns, and the issues of
    the others (fixture_file, issue): a file without one is rejected as a whole.
    """
    parts, rejected, accepted = [], [], {}
    for columns, found in text_files.by_header(spark, path, glob=glob).items():
        lacking = missing(list(required), list(columns))
        if lacking:
            rejected += [(f.rsplit("/", 1)[-1], f"positions_load_error:missing columns {', '.join(lacking)}") for f in found]
        else:
            accepted[columns] = found
    for columns, rows in text_files.delimited(spark, accepted):
        df = rows.select("row.*", F.col("file_name").alias("fixture_file"), F.col("ordinal").alias("file_ord"))
        for c in KEEPER_NAMES:
            if c not in columns:
                df = df.withColumn(c, F.lit(None).cast("string"))
        parts.append(df)
    issues = spark.createDataFrame(rejected, "fixture_file string, issue string")
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None), issues


def _typed(raw: DataFrame) -> DataFrame:
    return raw.select(
        "fixture_file", "file_ord", track_time("formatted local time").alias("local_dt"), to_long("ts in ms").alias("ts_ms"), to_double("x in m").alias("x"), to_double("y in m").alias("y"), to_double("z in m").alias("z"),
        *(to_double(c).alias(n) for c, n in (("speed in m/s", "speed"), ("acceleration in m/s2", "accel"), ("direction of movement in deg", "direction")) if c in raw.columns),
        strip(F.coalesce("group name", F.lit(""))).alias("group_name"), first_filled(*KEEPER_NAMES).alias("sensor_id"),
    ).dropna(subset=["local_dt", "x", "y", "z"])


def ball_points(raw: DataFrame) -> DataFrame:
    """Points of the ball group; all balls of a file are one series."""
    return _typed(raw).where("group_name = 'Ball'").drop("group_name", "sensor_id")


def keeper_candidates(raw: DataFrame) -> DataFrame:
    """Points of others in front of a goal."""
    area = F.abs("x").between(16.0, 20.0) & (F.abs("y") <= 1.5)
    return _typed(raw).where((F.col("group_name") != "Ball") & area).select("fixture_file", "file_ord", "local_dt", "ts_ms", "x", "y", "z", "sensor_id")


def shots(spark: SparkSession, path: str) -> DataFrame:
    """Second profile: shots with times in milliseconds."""
    names = [c.strip().split()[0] for c in SHOTS.split(",")]
    parts = [rows.select("row.*") for _, rows in text_files.delimited(spark, text_files.by_header(spark, path))]
    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    raw = raw.select(*(F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in names))
    return raw.select("id", "player_id", "shot_type", "shot_category", thousands_to_long("timestamp_ms").alias("ts_ms"), "success", *(to_double(c).alias(c) for c in ("distance", "speed_ball", "shot_position_x", "shot_position_y")))


def shot_ball_rows(raw: DataFrame) -> DataFrame:
    """Second profile's ball rows: the full name holds 'ball' in any case; commas group thousands."""
    ball = F.contains(F.lower(F.coalesce("full name", F.lit(""))), F.lit("ball"))
    return raw.where(ball).select(thousands_to_long("ts in ms").alias("ts_ms"), to_double("x in m").alias("x"), to_double("y in m").alias("y"), to_double("z in m").alias("z"), to_double("speed in m/s").alias("speed"), to_double("acceleration in m/s2").alias("accel"), to_double("direction of movement in deg").alias("direction"))


MARKER_HEADER = r"^Frame\tTime"
AXES = {"xyz": lambda x, y, z: (x, y, z), "xzy": lambda x, y, z: (x, z, y), "yzx": lambda x, y, z: (y, z, x)}


def markers(spark: SparkSession, path: str, axes: str = "xyz", zero_fill: bool = False, required: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Marker TSV files: (points, metadata, rejects).

    points: clip_id, frame, time_s, marker, x, y, z in metres, one row for each marker with all three axes
    (with ``zero_fill``, gaps are zeros). metadata: clip_id, frequency, marker_names. rejects: clips without
    header or without a required marker.
    """
    text = lines(spark, path).withColumnRenamed("file_name", "clip_id").withColumn("cells", F.split("value", "\t"))
    head = text.where(F.regexp_like("value", F.lit(MARKER_HEADER))).groupBy("clip_id").agg(F.min_by(F.struct("line_no", "cells"), "line_no").alias("h")).select("clip_id", F.col("h.line_no").alias("head_no"), F.col("h.cells").alias("head"))
    key = F.upper(F.trim(F.element_at("cells", 1)))
    meta = text.join(head, "clip_id").where("line_no < head_no").groupBy("clip_id").agg(
        F.max(F.when(key == "FREQUENCY", to_double(F.get("cells", F.lit(1))))).alias("frequency"),
        F.first(F.when(key == "MARKER_NAMES", F.filter(F.slice("cells", 2, 10_000), lambda c: F.trim(c) != "")), ignorenulls=True).alias("marker_names"),
    )
    # column triples by name; the first of equal names counts
    named = head.select("clip_id", "head_no", F.posexplode("head").alias("pos", "name")).where(F.regexp_like("name", F.lit(" [XYZ]$")))
    named = named.select("clip_id", "head_no", F.regexp_replace("name", " [XYZ]$", "").alias("marker"), F.right("name", F.lit(1)).alias("axis"), "pos")
    triples = named.groupBy("clip_id", "head_no", "marker").agg(*(F.min(F.when(F.col("axis") == a, F.col("pos"))).alias(f"p{a}") for a in "XYZ")).dropna()
    wanted = F.explode(F.array(*map(F.lit, required or [])).cast("array<string>")).alias("marker")
    lacking = head.select("clip_id", wanted).join(triples.select("clip_id", "marker"), ["clip_id", "marker"], "left_anti").groupBy("clip_id").agg(F.concat(F.lit("missing_markers:"), F.array_join(F.array_sort(F.collect_list("marker")), ",")).alias("issue"))
    headless = text.select("clip_id").distinct().join(head, "clip_id", "left_anti").select("clip_id", F.lit("no_header").alias("issue"))
    rejects = lacking.union(headless)
    cols = triples.groupBy("clip_id", "head_no").agg(F.collect_list(F.struct("marker", "pX", "pY", "pZ")).alias("triples"))
    data = text.join(cols, "clip_id").where("line_no > head_no").withColumn("frame", to_long(F.get("cells", F.lit(0)))).withColumn("time_s", to_double(F.get("cells", F.lit(1)))).where("frame is not null")
    value = lambda p: millimetres(to_double(F.get(F.col("cells"), F.col(f"t.{p}"))))
    long = data.select("clip_id", "frame", "time_s", "cells", F.explode("triples").alias("t")).select("clip_id", "frame", "time_s", F.col("t.marker").alias("marker"), *(v.alias(n) for n, v in zip("xyz", AXES[axes](value("pX"), value("pY"), value("pZ")))))
    long = long.na.fill(0.0, ["x", "y", "z"]) if zero_fill else long.dropna(subset=["x", "y", "z"])
    return long.join(rejects.select("clip_id"), "clip_id", "left_anti"), meta, rejects


def unpivoted(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Marker rows of a wide table with columns '<marker> X', '<marker> Y', '<marker> Z'; gaps go."""
    stems = [m for m in marker_stems(wide.columns) if all(f"{m} {a}" in wide.columns for a in "XYZ")]
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("marker"), *(F.col(f"`{m} {a}`").cast("double").alias(a.lower()) for a in "XYZ")) for m in stems))).alias("p")
    return wide.select(*keys, rows).select(*keys, "p.*").dropna(subset=["x", "y", "z"])


def bvh_motion(spark: SparkSession, path: str) -> DataFrame:
    """file_name, frame and channels of the motion section of BVH files."""
    text = lines(spark, path)
    start = text.where(F.trim("value") == "MOTION").groupBy("file_name").agg(F.min("line_no").alias("at"))
    rows = text.join(start, "file_name").where("line_no > at + 2 and trim(value) <> ''")
    return rows.select("file_name", (F.col("line_no") - F.col("at") - 3).alias("frame"), F.transform(F.split(F.trim("value"), r"\s+"), lambda c: c.try_cast("double")).alias("channels"))


def column_times(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """file_name, line_no and second column of delimited lines without their header."""
    return lines(spark, path).where("line_no > 0 and value <> ''").select("file_name", "line_no", F.get(F.split("value", sep), F.lit(1)).alias("time"))
