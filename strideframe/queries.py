"""The operators restated on the driver's tables, each beside the SQL that DuckDB checks it with.

recording = user, time = ts, coordinate = value, acceleration = change of value, shot = purchase,
sensor = event type; clip = label and frame = position by vec_id for embeddings (64 numbers: 16
quaternions; the first 51: 17 joints of three; the first 34: 17 of two).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import numbers, points, text, times, vector
from .operators import aggregates, asof, contained, fixtures, markers, medians, pose, resample, series, spans
from .plans import seven_metre, shots
from .session import new_folder, table
from .sources import animations, arrays, sinks, tables, text_files
from .streaming import windows as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

USER = ["user_id"]
CLIP = ["label"]


def query(sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c: Column) -> Column:
    return F.round(c, 6)


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def track(spark: SparkSession, d: str) -> DataFrame:
    """Events with idx, t (microseconds), x and a."""
    p = series.indexed(events(spark, d), USER, ["ts", "event_id"])
    return p.withColumn("t", times.micros("ts")).withColumn("x", F.col("value")).withColumn("a", F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("idx")))


P = """p AS (SELECT *, epoch_us(ts) AS t, value AS x, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx,
  value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM events)"""
DOWN = "OVER (PARTITION BY user_id ORDER BY idx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def frames(spark: SparkSession, d: str) -> DataFrame:
    """label, frame, e (array of doubles)."""
    e = table(spark, d, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    return series.indexed(e, CLIP, ["vec_id"], "frame").select("label", "frame", "vec_id", "e")


V = "v AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS frame FROM embeddings)"


def at(i: int) -> Column:
    return F.element_at("e", i + 1)


def long17(spark: SparkSession, d: str) -> DataFrame:
    """clip_id, frame, joint, x, y, z of 17 joints."""
    f = frames(spark, d).withColumnRenamed("label", "clip_id")
    return f.select("clip_id", "frame", F.posexplode(F.array(*(vector.vec(at(3 * j), at(3 * j + 1), at(3 * j + 2)) for j in range(17)))).alias("joint", "p")).select("clip_id", "frame", "joint", "p.x", "p.y", "p.z")


L17 = V + ", l AS (SELECT label AS clip_id, frame, CAST(j AS INTEGER) AS joint, e[3*j+1] AS x, e[3*j+2] AS y, e[3*j+3] AS z FROM v, range(17) AS r(j))"


# Scans, filters, projections


@query("SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx FROM events")
def series_index(spark, d):
    return track(spark, d).select("event_id", "user_id", "idx")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE trim(o_orderstatus) = 'F' AND coalesce(o_orderpriority, '') NOT IN ('1-URGENT', '5-LOW')")
def success_and_clock_filter(spark, d):
    o = table(spark, d, "orders").withColumn("success", F.when(text.strip("o_orderstatus") == "F", " 1").otherwise("0"))
    clock = F.when(F.col("o_orderpriority") == "1-URGENT", "30:00").when(F.col("o_orderpriority") == "5-LOW", " 60:00 ").otherwise(F.col("o_orderpriority"))
    return shots.wanted_events(o.withColumn("game_clock", clock)).select("o_orderkey", "o_orderstatus")


@query("SELECT event_id, value FROM events WHERE event_id = 17")
def point_lookup(spark, d):
    e = events(spark, d).withColumn("id", F.col("event_id").cast("string")).withColumn("game_clock", F.lit("10:00"))
    return shots.wanted_events(e, event_id="17", include_unsuccessful=True).select("event_id", "value")


@query("SELECT event_id, x, y FROM (SELECT event_id, event_type, round((value - 250) / 10, 3) AS x, round(CAST(event_id % 400 AS DOUBLE) / 100 - 2, 3) AS y FROM events) WHERE event_type <> 'view' AND abs(x) BETWEEN 16 AND 20 AND abs(y) <= 1.5")
def goal_area_box(spark, d):
    text_of = lambda c: F.round(c, 3).cast("string")
    e = events(spark, d)
    raw = e.select(
        F.lit("f").alias("fixture_file"), F.lit(0).cast("long").alias("file_ord"), F.date_format("ts", "d.M.yyyy, HH:mm:ss.SSS").alias("formatted local time"), F.col("event_id").cast("string").alias("ts in ms"), F.when(F.col("event_type") == "view", "Ball").otherwise("Away").alias("group name"),
        text_of((F.col("value") - 250) / 10).alias("x in m"), text_of((F.col("event_id") % 400).cast("double") / 100 - 2).alias("y in m"), F.lit("0").alias("z in m"), *(F.lit(None).cast("string").alias(c) for c in tables.KEEPER_NAMES),
    )
    return tables.keeper_candidates(raw).select(F.col("ts_ms").alias("event_id"), "x", "y")


@query("SELECT event_id * 1000 AS ts_ms, round(value, 3) AS speed FROM events WHERE event_type = 'click' OR event_id % 7 = 0")
def contains_any_case(spark, d):
    e = events(spark, d)
    name = F.when(F.col("event_type") == "click", "the BaLL 3").when(F.col("event_id") % 7 == 0, "Football").otherwise(F.nullif(F.col("event_type"), F.lit("view")))
    raw = e.select(name.alias("full name"), F.format_number(F.col("event_id") * 1000, 0).alias("ts in ms"), F.round("value", 3).cast("string").alias("speed in m/s"), *(F.lit("1").alias(c) for c in ("x in m", "y in m", "z in m", "acceleration in m/s2", "direction of movement in deg")))
    return tables.shot_ball_rows(raw).select("ts_ms", "speed")


@query("SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_mktsegment END), ''), nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_name END), ''), 'unknown') AS who FROM customer")
def coalesce_id(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", text.first_filled(F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_mktsegment")), F.when(F.col("c_custkey") % 2 != 0, F.col("c_name"))).alias("who"))


@query("SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END, ''), o_orderstatus, '') AS player FROM orders")
def player_fallback(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.coalesce(F.nullif(F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.col("o_orderpriority")), F.lit("")), "o_orderstatus", F.lit("")).alias("player"))


@query("SELECT l_orderkey, l_linenumber, concat_ws(';', CASE WHEN l_quantity > 25 THEN 'size:large' END, CASE WHEN l_discount > 0.05 THEN 'price:cut' END, CASE WHEN l_returnflag = 'R' THEN 'state:returned' END) AS flags FROM lineitem")
def flag_join(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", text.joined_flags(F.when(F.col("l_quantity") > 25, "size:large"), F.when(F.col("l_discount") > 0.05, "price:cut"), F.when(F.col("l_returnflag") == "R", "state:returned")).alias("flags"))


# Joins


@query(f"""WITH {P}, f AS (SELECT *, min(CASE WHEN value > 100 THEN idx END) {DOWN} AS next_cross FROM p)
SELECT a.event_id, a.idx AS start_idx, a.next_cross, b.event_id AS hit_event_id FROM f a LEFT JOIN p b ON b.user_id = a.user_id AND b.idx = a.next_cross WHERE a.event_type = 'purchase'""")
def next_crossing(spark, d):
    f = track(spark, d).withColumn("hit", series.next_match(F.col("value") > 100, USER, also=("event_id",))).where("event_type = 'purchase'")
    return f.select("event_id", F.col("idx").alias("start_idx"), F.col("hit.idx").alias("next_cross"), F.col("hit.event_id").alias("hit_event_id"))


def _sides(spark, d):
    p = track(spark, d)
    return p.where("event_type = 'purchase'"), p.where("event_type = 'view'")


ASOF = "WITH {p} SELECT a.event_id, b.event_id AS hit_event_id FROM (SELECT * FROM p WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM p WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts {op} b.ts"


@query(ASOF.format(p=P, op="<="))
def asof_forward(spark, d):
    a, b = _sides(spark, d)
    return asof.asof(a, b, USER, "t", "t", ["event_id"], True, "idx").select("event_id", "hit_event_id")


@query(ASOF.format(p=P, op=">="))
def asof_backward(spark, d):
    a, b = _sides(spark, d)
    return asof.asof(a, b, USER, "t", "t", ["event_id"], False, "idx").select("event_id", "hit_event_id")


@query(ASOF.format(p=P, op="<="))
def asof_forward_in_spans(spark, d):
    a, b = _sides(spark, d)
    return asof.asof(a, b, USER, "t", "t", ["event_id"], True, "idx", span=86_400_000_000).select("event_id", "hit_event_id")


@query(ASOF.format(p=P, op=">="))
def asof_backward_in_spans(spark, d):
    a, b = _sides(spark, d)
    return asof.asof(a, b, USER, "t", "t", ["event_id"], False, "idx", span=86_400_000_000).select("event_id", "hit_event_id")


@query(f"""WITH {P}, a AS (SELECT * FROM p WHERE event_type = 'purchase'), b AS (SELECT * FROM p WHERE event_type = 'view'),
x AS (SELECT a.event_id, a.user_id, a.t, b.event_id AS e1, b.t AS t1 FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts),
y AS (SELECT x.*, b.event_id AS e2, b.t AS t2 FROM x ASOF LEFT JOIN b ON x.user_id = b.user_id AND x.t < b.t)
SELECT event_id, CASE WHEN e1 IS NULL THEN e2 WHEN e2 IS NOT NULL AND t2 - t < t - t1 THEN e2 ELSE e1 END AS near_event_id FROM y""")
def asof_nearest(spark, d):
    a, b = _sides(spark, d)
    return asof.nearest(a, b, USER, "t", "t", ["event_id"], "idx").select("event_id", "near_event_id")


@query(f"WITH {P} SELECT a.event_id, b.event_id AS other_id, b.t - a.t AS offset_us FROM p a JOIN p b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'view' AND b.t BETWEEN a.t - 7200000000 AND a.t + 7200000000")
def range_join_window(spark, d):
    a, b = _sides(spark, d)
    met = asof.within(a.select("event_id", "user_id", "t"), b.select("user_id", F.col("event_id").alias("other_id"), F.col("t").alias("bt")), USER, "t", "bt", 7_200_000_000, 7_200_000_000)
    return met.select("event_id", "other_id", (F.col("bt") - F.col("t")).alias("offset_us"))


@query(f"WITH {P}, a AS (SELECT *, 1000 + event_id % 60 AS m FROM p WHERE event_id % 29 = 0), b AS (SELECT *, 1000 + event_id % 60 AS m FROM p WHERE event_id % 31 = 0) SELECT a.m, count(*) AS pairs, sum(b.event_id - a.event_id)::BIGINT AS gaps FROM a JOIN b ON b.m BETWEEN a.m - 5 AND a.m + 5 GROUP BY a.m")
def range_join_dense(spark, d):
    """All rows of one recording in one minute: rows of equal time meet as one, and dense buckets of times are grids of tasks."""
    second = (1000 + F.col("event_id") % 60).cast("long")
    e = events(spark, d).select("event_id", second.alias("m"), F.lit("all").alias("recording"))
    left, right = e.where("event_id % 29 = 0"), e.where("event_id % 31 = 0").select("recording", F.col("event_id").alias("other_id"), F.col("m").alias("other_m"))
    met = asof.within_sums(left, right, ONE, "m", "other_m", 5, 5, {"here": F.col("event_id")}, {"there": F.col("other_id")}, dense=20)
    return met.select("m", "pairs", (F.col("there") - F.col("here")).cast("long").alias("gaps"))


TRACKS = f"""WITH {P}, m AS (SELECT a.event_id, b.t - a.t AS o, b.t AS bt, b.value AS v, b.a AS acc, b.idx AS dir FROM p a JOIN p b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type <> 'purchase' AND b.t BETWEEN a.t - 14400000000 AND a.t + 14400000000),
g AS (SELECT event_id, count(*) AS num_points, max(v) AS max_speed, max(acc) AS max_acceleration, max(bt) - min(bt) AS flight_ms, CASE WHEN count(*) > 2 THEN round(stddev_samp(dir), 6) END AS angle_spread,
  coalesce(arg_max(v, o) FILTER (WHERE o <= 0), arg_min(v, o)) AS release_v FROM m GROUP BY event_id HAVING count(*) >= 2)"""


def _tracks(spark, d):
    p = track(spark, d)
    shot = p.where("event_type = 'purchase'").select("event_id", "user_id", F.col("t").alias("ts_ms"), (F.col("value") / 50).alias("distance"), (F.col("value") / 40).alias("shot_position_x"), F.when(F.col("event_id") % 2 == 0, "penalty").otherwise("field").alias("shot_category"))
    ball = p.where("event_type <> 'purchase'").select("user_id", F.col("t").alias("ts_ms"), F.col("value").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.col("value").alias("speed"), F.col("a").alias("accel"), F.col("idx").cast("double").alias("direction"))
    return seven_metre.shot_tracks(shot, ball, 14_400_000_000, USER)


@query(TRACKS + " SELECT event_id, num_points, round(max_speed, 6) AS max_speed, round(max_acceleration, 6) AS max_acceleration, flight_ms, angle_spread, round(release_v, 6) AS release_v FROM g")
def min_points_guard(spark, d):
    t = _tracks(spark, d)
    return t.select("event_id", "num_points", r6(F.col("max_speed")).alias("max_speed"), r6(F.col("max_acceleration")).alias("max_acceleration"), "flight_ms", r6(F.col("angle_spread")).alias("angle_spread"), r6(F.col("release.x")).alias("release_v"))


@query(TRACKS + ", k AS (SELECT g.*, e.value AS val FROM g JOIN events e USING (event_id)) SELECT event_id, (val/50 BETWEEN 6.5 AND 7.5) AS is_7m_distance, max_speed > 12 AS is_high_speed, (val/40 BETWEEN 6.5 AND 7.5) AS is_7m_spot, coalesce(angle_spread < 15, false) AS is_straight, (event_id % 2 = 0 AND val/50 BETWEEN 6.5 AND 7.5 AND max_speed > 12) AS is_7m_penalty FROM k")
def detector_7m(spark, d):
    return seven_metre.detected(_tracks(spark, d)).select("event_id", "is_7m_distance", "is_high_speed", "is_7m_spot", "is_straight", "is_7m_penalty")


@query("""WITH q AS (SELECT event_id, event_type, epoch_us(ts) // 1000000 AS s, value FROM events),
sh AS (SELECT * FROM q WHERE event_type = 'purchase' AND event_id % 2 = 0 ORDER BY s, event_id LIMIT 300),
g AS (SELECT sh.event_id, count(*) AS n, max(b.value) AS mx FROM sh JOIN q b ON b.event_type <> 'purchase' AND b.s BETWEEN sh.s - 3000 AND sh.s + 3000 GROUP BY 1 HAVING count(*) >= 2)
SELECT sh.event_id AS id, g.n AS num_points, round(coalesce(g.mx, sh.value / 30), 6) AS max_speed, coalesce(sh.value / 50 BETWEEN 6.5 AND 7.5 AND g.mx > 12, false) AS is_7m_penalty FROM sh LEFT JOIN g ON g.event_id = sh.event_id""")
def seven_metre_batch(spark, d):
    """All penalties up to a number, whether or not they have a track."""
    e = events(spark, d).withColumn("ts_ms", F.expr("unix_micros(cast(ts as timestamp)) div 1000000"))
    penalty = F.when(F.col("event_id") % 2 == 0, "penalty").otherwise("field")
    shot = e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), "ts_ms", penalty.alias("shot_category"), (F.col("value") / 50).alias("distance"), (F.col("value") / 40).alias("shot_position_x"), (F.col("value") / 30).alias("speed_ball"))
    ball = e.where("event_type <> 'purchase'").select("ts_ms", *(F.lit(0.0).alias(c) for c in "xyz"), F.col("value").alias("speed"), F.lit(0.0).alias("accel"), F.lit(0.0).alias("direction"))
    return seven_metre.analysed(shot, ball, 300).select("id", "num_points", r6(F.col("max_speed")).alias("max_speed"), "is_7m_penalty")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_incremental(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return fixtures.not_yet_there(o, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("SELECT o_custkey AS custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_difference(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("custkey")).subtract(table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"))


RESOLVE = """WITH i AS (SELECT lower(c_mktsegment) || '_' || right(c_name, 1) AS k, lower(n_name) AS n, list(c_name ORDER BY c_name) AS fs FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2),
e AS (SELECT s_suppkey, s_name, lower(n_name) AS n, CASE s_suppkey % 3 WHEN 0 THEN 'building' WHEN 1 THEN 'machinery' ELSE 'furniture' END || '_' || right(s_name, 1) AS k FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""


@query(RESOLVE + " SELECT s_suppkey, CASE WHEN len(fs) = 1 THEN fs[1] END AS file, CASE WHEN len(fs) > 1 THEN 'fixture_not_unique:' || array_to_string(fs, '|') WHEN fs IS NULL THEN 'no_fixture_match' END AS issue FROM e LEFT JOIN i ON i.k = e.k AND i.n = e.n")
def fixture_resolve(spark, d):
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    index = c.groupBy(text.canonical_name(F.concat_ws(" ", "c_mktsegment", F.right("c_name", F.lit(1)))).alias("home_key"), text.canonical_name("n_name").alias("away_key")).agg(F.array_sort(F.collect_list("c_name")).alias("files"))
    s = table(spark, d, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey"))
    kind = F.when(F.col("s_suppkey") % 3 == 0, "BUILDING").when(F.col("s_suppkey") % 3 == 1, "MACHINERY").otherwise("FURNITURE")
    ev = s.select("s_suppkey", F.concat_ws(" ", kind, F.right("s_name", F.lit(1))).alias("home_team"), F.col("n_name").alias("away_team"))
    return fixtures.resolve(ev, index).select("s_suppkey", F.col("fixture_file").alias("file"), "issue")


@query("SELECT n_nationkey, (SELECT min(c_name) FROM customer WHERE contains(c_name, '0' || CAST(n_nationkey AS VARCHAR))) AS file FROM nation")
def edge_fallback(spark, d):
    n = table(spark, d, "nation")
    edges = n.select("n_nationkey", F.concat(F.lit("0"), F.col("n_nationkey").cast("string")).alias("fragment"))
    found = contained.containing(table(spark, d, "customer").select("c_name"), "c_name", edges, "fragment").groupBy("n_nationkey").agg(F.min("c_name").alias("file"))
    return n.select("n_nationkey").join(found, "n_nationkey", "left")


@query("SELECT p_partkey, s_suppkey FROM part JOIN (SELECT s_suppkey, right(s_name, 2) AS f FROM supplier WHERE s_suppkey % 3 = 0) s ON contains(p_name || ' ' || p_partkey, f)")
def substring_join(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_partkey").alias("name"))
    s = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select("s_suppkey", F.right("s_name", F.lit(2)).alias("f"))
    return contained.containing(p, "name", s, "f").select("p_partkey", "s_suppkey")


@query("SELECT issue, count(*) AS n FROM (SELECT 'no_lines' AS issue FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) UNION ALL SELECT 'large' FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT 'open' FROM orders WHERE o_orderstatus = 'O') GROUP BY issue")
def issue_union(spark, d):
    o = table(spark, d, "orders")
    none = anti_incremental(spark, d).select(F.lit("no_lines").alias("issue"))
    parts = none.unionByName(o.where("o_totalprice > 300000").select(F.lit("large").alias("issue"))).unionByName(o.where("o_orderstatus = 'O'").select(F.lit("open").alias("issue")))
    return parts.groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


# Windows


@query(f"WITH {P} SELECT event_id, min(CASE WHEN abs(value) BETWEEN 200 AND 210 THEN idx END) {DOWN} AS next_gate FROM p")
def next_gate(spark, d):
    return track(spark, d).select("event_id", series.next_match(series.gate(F.col("value"), 200, 210), USER).alias("next_gate"))


@query(f"WITH {P}, q AS (SELECT event_id, x, min(x) OVER w AS lo, max(x) OVER w AS hi FROM p WINDOW w AS (PARTITION BY user_id ORDER BY idx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT event_id, coalesce(lo < x AND hi > x, false) AS reversal FROM q")
def reversal_flag(spark, d):
    return track(spark, d).select("event_id", series.reversal("x", USER).alias("reversal"))


@query(f"WITH {P}, q AS (SELECT event_id, user_id, idx, a, lag(a) OVER (PARTITION BY user_id ORDER BY idx) AS b FROM p) SELECT event_id, max(CASE WHEN idx = 0 OR a IS NULL OR b IS NULL OR b < a THEN idx END) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_start FROM q")
def run_start(spark, d):
    return track(spark, d).select("event_id", series.run_start("a", USER).alias("run_start"))


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND CURRENT ROW) AS peak FROM events")
def trailing_peak(spark, d):
    return track(spark, d).select("event_id", series.trailing_peak(F.col("value"), USER, F.col("t"), 3 * 86_400_000_000).alias("peak"))


@query(f"WITH {P}, m AS (SELECT user_id, max(x) AS peak FROM p GROUP BY user_id) SELECT user_id, peak, max(idx) AS last_idx FROM p JOIN m USING (user_id) WHERE abs(x - peak) <= 0.5 GROUP BY user_id, peak")
def peak_last_tie(spark, d):
    return aggregates.last_near_max(track(spark, d), USER, "x", "idx", 0.5)


@query(f"WITH {P} SELECT event_id, CASE WHEN count(*) OVER (PARTITION BY user_id) < 4 THEN x ELSE round(sum(x) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4, 6) END AS smooth FROM p")
def moving_average_same(spark, d):
    return track(spark, d).select("event_id", r6(series.moving_average("x", USER, 4)).alias("smooth"))


@query(f"WITH {P} SELECT event_id, idx FROM p WHERE idx % 7 = 0")
def decimation(spark, d):
    return series.decimated(track(spark, d), 7).select("event_id", "idx")


@query(f"WITH {P}, q AS (SELECT event_id, x, lag(x) OVER w AS b, lead(x) OVER w AS n FROM p WINDOW w AS (PARTITION BY user_id ORDER BY idx)) SELECT event_id, round(CASE WHEN b IS NULL THEN (n - x) / 0.05 WHEN n IS NULL THEN (x - b) / 0.05 ELSE (n - b) / 0.1 END, 6) AS slope FROM q")
def gradient(spark, d):
    return track(spark, d).select("event_id", r6(series.gradient("x", USER, 0.05)).alias("slope"))


def _hat(i: int, j: int, half: int = 5) -> float:
    """Weight of row j in the value that a parabola fitted over rows -half to half has at row i: by orthogonal polynomials."""
    at_ = range(-half, half + 1)
    second = lambda t: t * t - sum(k * k for k in at_) / len(at_)
    return 1 / len(at_) + i * j / sum(k * k for k in at_) + second(i) * second(j) / sum(second(k) ** 2 for k in at_)


HAT = "[" + ", ".join("[" + ", ".join(repr(_hat(i, j)) for j in range(-5, 6)) + "]" for i in range(-5, 6)) + "]::DOUBLE[][]"


@query(f"""WITH {V}, s AS (SELECT label, count(*) AS n, list(e[1] ORDER BY frame) AS xs FROM v GROUP BY label),
b AS (SELECT v.label, v.frame, xs, greatest(0, least(v.frame - 5, n - 11)) AS first FROM v JOIN s ON s.label = v.label WHERE n >= 11)
SELECT label, frame, round(list_dot_product(xs[first+1:first+11], ({HAT})[frame - first + 1]), 6) AS smooth FROM b""")
def savgol(spark, d):
    """Ends included: there the fit over the first or last window."""
    f = frames(spark, d).withColumn("e0", at(0))
    n = F.count(F.lit(1)).over(Window.partitionBy("label"))
    return f.select("label", "frame", n.alias("n"), r6(series.smoothed("e0", CLIP, idx="frame")).alias("smooth")).where("n >= 11").select("label", "frame", "smooth")


@query(f"WITH {P} SELECT event_id, last_value(CASE WHEN x > 300 THEN x END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM p")
def carry_forward(spark, d):
    return track(spark, d).select("event_id", series.carried_forward(F.when(F.col("x") > 300, F.col("x")), USER).alias("carried"))


@query(f"WITH {P} SELECT event_id, round(x - first_value(x) OVER (PARTITION BY user_id ORDER BY idx), 6) AS moved, round(x - min(x) OVER (PARTITION BY user_id), 6) AS height FROM p")
def rebased_root(spark, d):
    return track(spark, d).select("event_id", r6(series.from_first("x", USER)).alias("moved"), r6(series.above_lowest("x", USER)).alias("height"))


@query("SELECT user_id, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 / (count(*) - 1), 4) AS frame_s FROM events GROUP BY user_id")
def frame_rate(spark, d):
    return track(spark, d).groupBy("user_id").agg(F.round(series.frame_seconds(F.col("t") / 1e6), 4).alias("frame_s"))


# Windows in spans: all events are one recording, a day is a span

ONE = ["recording"]
DAY = 86_400_000_000
O = """o AS (SELECT *, epoch_us(ts) AS t, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS idx, value - lag(value) OVER (ORDER BY ts, event_id) AS a FROM events)"""
O_DOWN = "OVER (ORDER BY idx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def recording(spark: SparkSession, d: str) -> DataFrame:
    """event_id, event_type, t, value, idx and a of one recording that holds all rows; its points don't meet in one task."""
    e = events(spark, d).select("event_id", "event_type", times.micros("ts").alias("t"), "value").withColumn("recording", F.lit("all"))
    p = spans.scanned(e, ONE, ["t", "event_id"], day(), idx=spans.Scan("sum", F.lit(1).cast("long")), _before=spans.before(F.col("value")))
    return p.withColumn("idx", F.col("idx") - 1).withColumn("a", F.col("value") - F.col("_before.v")).drop("_before")


def day() -> Column:
    return F.expr(f"t div {DAY}")


@query(f"WITH {O} SELECT event_id, idx, round(a, 6) AS a FROM o")
def series_index_in_spans(spark, d):
    return recording(spark, d).select("event_id", "idx", r6(F.col("a")).alias("a"))


@query(f"""WITH {O}, f AS (SELECT *, min(CASE WHEN value > 495 THEN idx END) {O_DOWN} AS next_cross FROM o)
SELECT f.event_id, f.next_cross, h.event_id AS hit_event_id FROM f LEFT JOIN o h ON h.idx = f.next_cross""")
def next_crossing_in_spans(spark, d):
    p = spans.scanned(recording(spark, d), ONE, ["idx"], day(), hit=spans.next_match(F.col("value") > 495, F.struct("idx", "event_id")))
    return p.select("event_id", F.col("hit.idx").alias("next_cross"), F.col("hit.event_id").alias("hit_event_id"))


@query(f"WITH {O} SELECT event_id, min(CASE WHEN abs(value) BETWEEN 200 AND 202 THEN idx END) {O_DOWN} AS next_gate, last_value(CASE WHEN value > 490 THEN value END IGNORE NULLS) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM o")
def gates_and_carried_in_spans(spark, d):
    gate = spans.next_match(series.gate(F.col("value"), 200, 202), F.col("idx"))
    p = spans.scanned(recording(spark, d), ONE, ["idx"], day(), next_gate=gate, carried=spans.carried_forward(F.when(F.col("value") > 490, F.col("value"))))
    return p.select("event_id", "next_gate", "carried")


@query(f"WITH {O}, q AS (SELECT event_id, value AS x, min(value) OVER w AS lo, max(value) OVER w AS hi FROM o WINDOW w AS (ORDER BY idx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT event_id, coalesce(lo < x AND hi > x, false) AS reversal FROM q")
def reversal_in_spans(spark, d):
    return spans.reversals(recording(spark, d), "value", ONE, ["idx"], day()).select("event_id", "reversal")


@query(f"WITH {O}, q AS (SELECT event_id, idx, a, lag(a) OVER (ORDER BY idx) AS b FROM o) SELECT event_id, max(CASE WHEN idx = 0 OR a IS NULL OR b IS NULL OR b < a THEN idx END) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_start FROM q")
def run_start_in_spans(spark, d):
    return spans.run_starts(recording(spark, d), "a", ONE, ["idx"], day()).select("event_id", "run_start")


@query("SELECT event_id, max(value) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 3 HOUR PRECEDING AND CURRENT ROW) AS peak FROM events")
def trailing_peak_in_spans(spark, d):
    return spans.trailing_peaks(recording(spark, d), F.col("value"), ONE, "t", 3 * 3_600_000_000, DAY).select("event_id", "peak")


@query(f"WITH {O} SELECT event_id, round(sum(value) OVER (ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4, 6) AS smooth, round(CASE WHEN lag(value) OVER (ORDER BY idx) IS NULL THEN (lead(value) OVER (ORDER BY idx) - value) / 0.05 WHEN lead(value) OVER (ORDER BY idx) IS NULL THEN (value - lag(value) OVER (ORDER BY idx)) / 0.05 ELSE (lead(value) OVER (ORDER BY idx) - lag(value) OVER (ORDER BY idx)) / 0.1 END, 6) AS slope FROM o")
def smoothing_in_spans(spark, d):
    p = spans.moving_averages(recording(spark, d), "value", ONE, 4, "idx", 1000, "smooth")
    return spans.gradients(p, "value", ONE, 0.05, "idx", 1000, "slope").select("event_id", r6(F.col("smooth")).alias("smooth"), r6(F.col("slope")).alias("slope"))


@query(f"""WITH {O}, a AS (SELECT * FROM o WHERE event_type = 'purchase'), b AS (SELECT t, min(event_id) AS lo, max(event_id) AS hi FROM o WHERE event_type = 'view' GROUP BY t),
x AS (SELECT a.event_id, a.t, b.hi AS e1, b.t AS t1 FROM a ASOF LEFT JOIN b ON a.t >= b.t),
y AS (SELECT x.*, b.lo AS e2, b.t AS t2 FROM x ASOF LEFT JOIN b ON x.t < b.t)
SELECT event_id, CASE WHEN e1 IS NULL OR t2 - t < t - t1 THEN e2 ELSE e1 END AS near_event_id FROM y""")
def asof_nearest_in_spans(spark, d):
    p = recording(spark, d)
    return asof.nearest(p.where("event_type = 'purchase'"), p.where("event_type = 'view'"), ONE, "t", "t", ["event_id"], "event_id", span=DAY).select("event_id", "near_event_id")


# Correction


def court(spark: SparkSession, d: str) -> DataFrame:
    """Events as annotated points of one recording a user: on a court of 40 m, a second or so apart."""
    p = track(spark, d).withColumn("fixture_file", F.col("user_id").cast("string")).withColumn("local_dt", F.timestamp_micros(F.expr("t div 40000")))
    y = (F.col("event_id") % 400).cast("double") / 100 - 2
    return shots.annotated(p.select("fixture_file", "event_id", "event_type", "value", "local_dt", F.col("idx").alias("ts_ms"), F.col("event_id").alias("file_ord"), (F.col("value") / 12.5 - 20).alias("x"), y.alias("y"), F.col("value").alias("speed"), F.col("a").alias("accel")))


COURT = """c AS (SELECT *, value / 12.5 - 20 AS x, CAST(event_id % 400 AS DOUBLE) / 100 - 2 AS y, epoch_us(ts) // 40000 AS t, CAST(row_number() OVER w - 1 AS BIGINT) AS idx, value - lag(value) OVER w AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
q AS (SELECT *, lag(a) OVER (PARTITION BY user_id ORDER BY idx) AS b FROM c),
f AS (SELECT *, max(CASE WHEN idx = 0 OR a IS NULL OR b IS NULL OR b < a THEN idx END) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rs,
  min(CASE WHEN abs(x) BETWEEN 12 AND 14 THEN idx END) OVER (PARTITION BY user_id ORDER BY idx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gate FROM q)"""


@query(f"""WITH {COURT}, s AS (SELECT *, CAST(event_id % 100 AS DOUBLE) / 20 + 5 AS d FROM f WHERE event_type = 'purchase'),
near AS (SELECT s.event_id, k.idx, k.a, k.rs FROM s JOIN f k ON k.user_id = s.user_id AND k.a IS NOT NULL AND k.t BETWEEN s.t - 3000000 AND s.t WHERE s.d < 6.95),
peak AS (SELECT event_id, max(a) AS m FROM near GROUP BY 1),
rel AS (SELECT event_id, arg_max(rs, idx) AS rs FROM near JOIN peak USING (event_id) WHERE abs(a - m) <= 1e-6 GROUP BY 1),
mv AS (SELECT s.event_id, min(k.idx) AS moved FROM rel JOIN s USING (event_id) JOIN f r ON r.user_id = s.user_id AND r.idx = rel.rs JOIN f k ON k.user_id = s.user_id AND k.t >= r.t - 1000000 GROUP BY 1)
SELECT s.event_id, CASE WHEN d < 6.95 THEN coalesce(moved, idx) WHEN d > 8 THEN coalesce(gate, idx) ELSE idx END AS start_idx,
  CASE WHEN d < 6.95 THEN CASE WHEN moved IS NULL THEN 'short_distance_correction:no_release_detected' ELSE 'short_distance_correction:applied' END
  WHEN d > 8 THEN CASE WHEN gate IS NULL THEN 'long_distance_correction:no_x_gate_match' ELSE 'long_distance_correction:applied' END ELSE 'distance_check:in_range' END AS flag
FROM s LEFT JOIN mv USING (event_id)""")
def start_correction(spark, d):
    p = court(spark, d)
    purchases = p.where("event_type = 'purchase'")
    ev = purchases.select(F.col("event_id").alias("event_no"), "fixture_file", F.col("idx").alias("start0"), F.col("t").alias("start0_t"), F.col("next_gate").alias("start0_gate"), ((F.col("event_id") % 100).cast("double") / 20 + 5).alias("dist"))
    return shots.corrected_start(ev, p).select(F.col("event_no").alias("event_id"), "start_idx", F.col("correction_flag").alias("flag"))


@query(f"""WITH {COURT}, g AS (SELECT *, sqrt(power(x - CASE WHEN first_value(x) OVER (PARTITION BY user_id ORDER BY idx) > 0 THEN 20 ELSE -20 END, 2) + y * y) AS dist FROM f),
h AS (SELECT *, CASE WHEN a IS NOT NULL AND dist BETWEEN 6.5 AND 7.5 THEN 3 WHEN a IS NOT NULL THEN 2 ELSE 1 END AS tier FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tier DESC, CASE WHEN tier >= 2 THEN a ELSE value END DESC, idx) AS r FROM h)
SELECT user_id, event_id, 'release_point:' || CASE tier WHEN 3 THEN 'max_a' WHEN 2 THEN 'max_a_fallback_global' ELSE 'max_v_fallback' END AS flag FROM r WHERE r = 1""")
def release_argmax(spark, d):
    point = F.struct("idx", "x", "y", "speed", "accel", "t", "event_id")
    whole = court(spark, d).groupBy("fixture_file").agg(F.array_sort(F.collect_list(point)).alias("points"))
    best = whole.select(F.col("fixture_file").cast("long").alias("user_id"), shots.select_release(F.col("points")).alias("b"))
    return best.select("user_id", "b.p.event_id", "b.flag")


@query("SELECT o.event_id, k.event_id AS point_id, epoch_us(k.ts) - epoch_us(o.ts) AS time_from_shot FROM events o JOIN events k ON k.user_id = o.user_id AND abs(epoch_us(k.ts) - epoch_us(o.ts)) <= 14400000000 WHERE o.event_type = 'purchase'")
def track_offsets(spark, d):
    p = track(spark, d)
    shot = p.where("event_type = 'purchase'").select("event_id", "user_id", F.col("t").alias("ts_ms"))
    ball = p.select("user_id", F.col("t").alias("ts_ms"), F.col("event_id").alias("point_id"))
    return seven_metre.track_points(shot, ball, 14_400_000_000, USER).select("event_id", "point_id", F.col("time_from_shot_ms").alias("time_from_shot"))


# Shots from events to results


def shot_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(shots, points, keepers): one recording a user, a purchase is a shot, each event type a keeper's sensor."""
    p = track(spark, d)
    day = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    p = p.select(
        F.col("user_id").cast("string").alias("fixture_file"), "event_id", "event_type", F.timestamp_add("MICROSECOND", F.expr("t div 40000"), day).alias("local_dt"), F.col("idx").alias("ts_ms"), F.col("event_id").alias("file_ord"),
        (F.col("value") / 7 - 21).alias("x"), ((F.col("event_id") % 400).cast("double") / 100 - 2).alias("y"), F.lit(0.0).alias("z"), F.col("value").alias("speed"), F.col("a").alias("accel"), F.col("value").alias("direction"),
    )
    no = F.col("event_id")
    asked = p.where("event_type = 'purchase'").select(
        no.alias("row_idx"), no.cast("string").alias("id"), F.lit("a").alias("home_team"), F.lit("b").alias("away_team"), F.when(no % 89 == 0, "none").otherwise(F.col("fixture_file")).alias("fixture_file"),
        F.lit("").alias("player_id"), F.lit(None).cast("string").alias("player_name"), F.lit("c").alias("name"), F.when(no % 4 == 0, "0").otherwise("1").alias("success"),
        ((no % 100).cast("double") / 20 + 5).cast("string").alias("distance"), F.when(no % 97 == 0, "").otherwise(F.date_format("local_dt", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("timestamp_local_timezone"),
    )
    keepers = p.select("fixture_file", F.col("event_type").alias("sensor_id"), "local_dt", "ts_ms", "file_ord", "x", "y", "z")
    return asked, p.drop("event_id", "event_type"), keepers


def _pick(start: str, table: str) -> str:
    """SQL of the release point behind ``start``; w has the points near each shot."""
    return f"""{table}d AS (SELECT w.*, {start} AS st, first_value(x) OVER (PARTITION BY event_id ORDER BY idx) > 0 AS right_side FROM w WHERE idx >= {start}),
{table}t AS (SELECT *, CASE WHEN a IS NULL THEN 1 WHEN sqrt(power(x - CASE WHEN right_side THEN 20 ELSE -20 END, 2) + y * y) BETWEEN 6.5 AND 7.5 THEN 3 ELSE 2 END AS tier FROM {table}d),
{table} AS (SELECT event_id, idx AS r_idx, t AS r_t, x AS r_x, y AS r_y, value AS r_v, tier FROM {table}t QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY tier DESC, CASE WHEN tier >= 2 THEN a ELSE value END DESC, idx) = 1)"""


SHOTS = f"""WITH {COURT.replace("value / 12.5 - 20", "value / 7 - 21")},
p AS (SELECT *, min(CASE WHEN abs(x) > 20 THEN idx END) OVER d1 AS hit, coalesce(min(x) OVER d2 < x AND max(x) OVER d2 > x, false) AS rev, max(idx) OVER (PARTITION BY user_id) AS last_idx FROM f
  WINDOW d1 AS (PARTITION BY user_id ORDER BY idx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), d2 AS (PARTITION BY user_id ORDER BY idx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s0 AS (SELECT o.event_id, o.user_id, o.t, CAST(o.event_id % 100 AS DOUBLE) / 20 + 5 AS d, o.event_id % 4 <> 0 AS ok, min(k.idx) AS start0 FROM p o JOIN p k ON k.user_id = o.user_id AND k.t >= o.t WHERE o.event_type = 'purchase' AND o.event_id % 89 <> 0 AND o.event_id % 97 <> 0 GROUP BY ALL),
s AS (SELECT s0.*, k.gate FROM s0 JOIN p k ON k.user_id = s0.user_id AND k.idx = start0),
near AS (SELECT s.event_id, k.idx, k.a, k.rs FROM s JOIN p k ON k.user_id = s.user_id AND k.a IS NOT NULL AND k.t BETWEEN s.t - 3000000 AND s.t WHERE s.d < 6.95),
peak AS (SELECT event_id, max(a) AS m FROM near GROUP BY 1),
rel AS (SELECT event_id, arg_max(rs, idx) AS rs FROM near JOIN peak USING (event_id) WHERE abs(a - m) <= 1e-6 GROUP BY 1),
mv AS (SELECT s.event_id, min(k.idx) AS moved FROM rel JOIN s USING (event_id) JOIN p r ON r.user_id = s.user_id AND r.idx = rel.rs JOIN p k ON k.user_id = s.user_id AND k.t >= r.t - 1000000 GROUP BY 1),
b0 AS (SELECT s.*, CASE WHEN d < 6.95 THEN coalesce(moved, start0) WHEN d > 8 THEN coalesce(gate, start0) ELSE start0 END AS start_idx,
  CASE WHEN d < 6.95 THEN 'short_distance_correction:' || CASE WHEN moved IS NULL THEN 'no_release_detected' ELSE 'applied' END WHEN d > 8 THEN 'long_distance_correction:' || CASE WHEN gate IS NULL THEN 'no_x_gate_match' ELSE 'applied' END ELSE 'distance_check:in_range' END AS flag1
  FROM s LEFT JOIN mv USING (event_id)),
b AS (SELECT b0.*, k.t AS start_t, d BETWEEN 6.5 AND 7.5 AND NOT k.rev AS plausible, CASE WHEN k.hit IS NULL AND NOT ok THEN k.last_idx ELSE k.hit END AS end_idx, CASE WHEN k.hit IS NULL AND NOT ok THEN 'unsuccessful:using_last_point' END AS flag2 FROM b0 JOIN p k ON k.user_id = b0.user_id AND k.idx = start_idx),
e AS (SELECT b.*, (SELECT min(k.idx) FROM p k WHERE k.user_id = b.user_id AND k.t >= b.start_t) AS es, (SELECT min(k.idx) FROM p k WHERE k.user_id = b.user_id AND k.t >= b.start_t - 5200000) AS lo, (SELECT max(k.idx) FROM p k WHERE k.user_id = b.user_id AND k.t <= z.t + 300000) AS ee FROM b JOIN p z ON z.user_id = b.user_id AND z.idx = b.end_idx),
w AS (SELECT e.event_id, e.es, k.* EXCLUDE (event_id) FROM e JOIN p k ON k.user_id = e.user_id AND k.idx BETWEEN greatest(lo - 5, 0) AND ee),
{_pick("es", "one")},
need AS (SELECT e.*, one.*  EXCLUDE (event_id), sqrt(power(r_x - CASE WHEN r_x > 0 THEN 20 ELSE -20 END, 2) + r_y * r_y) AS gd FROM e JOIN one USING (event_id)),
aim AS (SELECT *, r_t - CAST(round(((7.5 - gd) / nullif(r_v, 0) + 0.1) * 1e6) AS BIGINT) AS target, NOT plausible AND gd < 6.5 AND r_v > 0 AND (7.5 - gd) / nullif(r_v, 0) BETWEEN 1e-300 AND 4.999999999999 AS wants FROM need),
back AS (SELECT aim.*, (SELECT min(w.idx) FROM w WHERE w.event_id = aim.event_id AND w.t >= aim.target) AS fi, (SELECT w.t FROM w WHERE w.event_id = aim.event_id AND w.idx = aim.es) AS es_t FROM aim),
ext AS (SELECT *, CASE WHEN wants AND target < es_t AND fi < es THEN fi END AS ns FROM back),
v AS (SELECT w.* EXCLUDE (es), coalesce(ns, ext.es) AS es FROM w JOIN ext USING (event_id)),
{_pick("es", "two").replace("FROM w WHERE", "FROM v AS w WHERE")},
cut AS (SELECT ext.event_id, ext.user_id, flag1, flag2, plausible, ns, coalesce(ns, es) AS xs, ee, CASE WHEN plausible THEN start_t ELSE coalesce(CASE WHEN ns IS NOT NULL THEN two.r_t END, ext.r_t) END AS rel_t,
  'release_point:' || CASE WHEN plausible THEN 'start_timestamp_plausible' ELSE CASE ext.tier WHEN 3 THEN 'max_a' WHEN 2 THEN 'max_a_fallback_global' ELSE 'max_v_fallback' END END AS flag3 FROM ext JOIN two USING (event_id)),
traj AS (SELECT cut.event_id, w.* EXCLUDE (event_id, es) FROM cut JOIN w ON w.event_id = cut.event_id AND w.idx BETWEEN xs - least(xs, 5) AND ee),
sums AS (SELECT event_id, any_value(user_id) AS user_id, count(*) AS n, min(t) AS t0, max(t) AS t1, max(value) AS max_v, max(a) AS max_a, sum(x) AS sx, CASE WHEN avg(x) < 0 THEN -1 ELSE 1 END AS side FROM traj GROUP BY event_id),
seen AS (SELECT m.event_id, k.* EXCLUDE (event_id) FROM sums m JOIN p k ON k.user_id = m.user_id AND k.t BETWEEN t0 AND t1 AND sign(k.x) = side WHERE n < 60),
best AS (SELECT event_id, event_type AS sensor FROM seen GROUP BY event_id, event_type QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY count(*) DESC, avg(abs(x)) DESC, avg(abs(y)), event_type) = 1),
pair AS (SELECT traj.event_id, traj.idx, seen.x FROM traj JOIN best USING (event_id) JOIN seen ON seen.event_id = traj.event_id AND seen.event_type = sensor
  QUALIFY row_number() OVER (PARTITION BY traj.event_id, traj.idx ORDER BY abs(seen.t - traj.t), seen.t > traj.t, CASE WHEN seen.t > traj.t THEN seen.idx ELSE -seen.idx END) = 1),
kept AS (SELECT event_id, sum(x) AS kx FROM pair GROUP BY 1)"""


@query(SHOTS + """ SELECT CAST(event_id AS VARCHAR) AS id, strftime(make_timestamp(t0), '%Y-%m-%dT%H:%M:%S.%g') AS start_time_local, strftime(make_timestamp(t1), '%Y-%m-%dT%H:%M:%S.%g') AS end_time_local, strftime(make_timestamp(rel_t), '%Y-%m-%dT%H:%M:%S.%g') AS release_time_local,
  round(max_v, 6) AS max_v, round(max_a, 6) AS max_a, n AS points, round(sx, 4) AS ball_x, round(coalesce(kx, 0), 4) AS keeper_x, coalesce(sensor, '') AS sensor,
  concat_ws(';', flag1, flag2, flag3, CASE WHEN ns IS NOT NULL THEN 'release_point:dynamic_extended' END, CASE WHEN xs > 0 THEN 'ball_prepend_frames:' || least(xs, 5) END, 'goalkeeper_points:' || CASE WHEN sensor IS NULL THEN 0 ELSE n END, CASE WHEN sensor IS NOT NULL THEN 'goalkeeper_aligned_with_ball:1' END) AS flags
FROM cut JOIN sums USING (event_id) LEFT JOIN best USING (event_id) LEFT JOIN kept USING (event_id) WHERE n < 60""")
def matched_shots(spark, d):
    results, _, _ = shots.match_shots(*shot_tables(spark, d), include_unsuccessful=True)
    whole = lambda c: F.round(F.aggregate(F.from_json(c, "array<struct<x:double>>"), F.lit(0.0), lambda s, q: s + q["x"]), 4)
    return results.select(
        "id", "start_time_local", "end_time_local", "release_time_local", *(F.col(c).try_cast("double").alias(c) for c in ("max_v", "max_a")), F.col("trajectory_point_count").cast("long").alias("points"),
        whole("trajectory_json").alias("ball_x"), whole("goalkeeper_trajectory_json").alias("keeper_x"), F.col("goalkeeper_sensor_id").alias("sensor"), "flags",
    )


@query(SHOTS + """ SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 89 = 0 THEN 'no_ball_points' ELSE 'invalid_shot_local_time' END AS issue FROM events WHERE event_type = 'purchase' AND (event_id % 89 = 0 OR event_id % 97 = 0)
UNION ALL SELECT CAST(event_id AS VARCHAR), 'no_goalline_crossing_found' FROM b WHERE end_idx IS NULL UNION ALL SELECT CAST(event_id AS VARCHAR), 'points:' || n FROM sums WHERE n >= 60""")
def shot_issues(spark, d):
    _, issues, skipped = shots.match_shots(*shot_tables(spark, d), include_unsuccessful=True)
    return issues.select(F.col("penalty_id").alias("id"), "issue").union(skipped.select("id", F.concat(F.lit("points:"), F.col("points").cast("string"))))


@query(SHOTS + """ SELECT (SELECT count(*) FROM events WHERE event_type = 'purchase') AS events, (SELECT count(*) FROM sums WHERE n < 60) AS resolved, (SELECT count(*) FROM sums WHERE n >= 60) AS skipped,
  (SELECT count(*) FROM events WHERE event_type = 'purchase' AND (event_id % 89 = 0 OR event_id % 97 = 0)) + (SELECT count(*) FROM b WHERE end_idx IS NULL) AS unresolved""")
def penalty_run(spark, d):
    """Events to recordings by team names, matching and the summary, as one run."""
    asked, points, keepers = shot_tables(spark, d)
    name = F.concat(F.lit("Team_"), "fixture_file", F.lit("_vs_Gaeste_2_phases_positions.csv"))
    index, bad = fixtures.fixture_index(points.select(name.alias("file_name")).distinct())
    teams = asked.withColumn("home_team", F.concat_ws(" ", F.lit("Team"), "fixture_file")).withColumn("away_team", F.lit(" Gäste")).drop("fixture_file")
    _, _, summary = shots.run(teams, index, bad, points.withColumn("fixture_file", name), keepers.withColumn("fixture_file", name), include_unsuccessful=True)
    return summary


@query(f"WITH {P} SELECT a.event_id, count(*) AS n, max(b.x) AS max_v, max(b.a) AS max_a, round(avg(b.x), 6) AS mean_x FROM p a JOIN p b ON a.user_id = b.user_id AND b.idx BETWEEN greatest(a.idx - 3, 0) AND a.idx + 3 WHERE a.event_type = 'purchase' GROUP BY a.event_id")
def window_slice_agg(spark, d):
    p = track(spark, d)
    ev = p.where("event_type = 'purchase'").select("event_id", "user_id", F.greatest(F.col("idx") - 3, F.lit(0)).alias("lo"), (F.col("idx") + 3).alias("hi"))
    cut = asof.slices(ev, p, USER, "lo", "hi", "idx", ["x", "a"])
    get = lambda k: F.transform("points", lambda q: q[k])
    return cut.select("event_id", F.size("points").cast("long").alias("n"), F.array_max(get("x")).alias("max_v"), F.array_max(get("a")).alias("max_a"), r6(F.aggregate(get("x"), F.lit(0.0), lambda s, q: s + q) / F.size("points")).alias("mean_x"))


@query(f"WITH {P} SELECT event_id, least(idx, 5) AS prepended, greatest(idx - 5, 0) AS first_idx FROM p WHERE event_type = 'purchase'")
def prepend_slice(spark, d):
    p = track(spark, d).where("event_type = 'purchase'")
    return p.select("event_id", F.least("idx", F.lit(shots.PREPEND)).alias("prepended"), F.greatest(F.col("idx") - shots.PREPEND, F.lit(0)).alias("first_idx"))


@query("SELECT event_id, (value/50 BETWEEN 6.5 AND 7.5 AND event_id % 3 <> 0) AS plausible FROM events")
def plausible_release(spark, d):
    return events(spark, d).select("event_id", shots.plausible(F.col("value") / 50, F.col("event_id") % 3 == 0).alias("plausible"))


# Aggregates


@query("SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, mx DESC, mn, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS n, round(avg(value), 6) AS mx, min(value) AS mn FROM events GROUP BY 1, 2)) WHERE r = 1")
def sensor_top1(spark, d):
    g = events(spark, d).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mx"), F.min("value").alias("mn"))
    return aggregates.top_one(g, USER, F.desc("n"), F.desc("mx"), F.asc("mn"), F.asc("event_type")).select("user_id", "event_type", "n")


@query("SELECT user_id, CASE WHEN count(value) > 2 THEN round(stddev_samp(value), 6) END AS spread, CASE WHEN avg(value - 250) < 0 THEN -1 ELSE 1 END AS side FROM events GROUP BY user_id")
def direction_std(spark, d):
    return events(spark, d).groupBy("user_id").agg(r6(aggregates.spread_if_enough(F.col("value"))).alias("spread"), aggregates.side(F.avg(F.col("value") - 250)).alias("side"))


@query("SELECT event_type, count(*) FILTER (WHERE value > 400) AS resolved, count(*) FILTER (WHERE value BETWEEN 100 AND 400) AS skipped, count(*) FILTER (WHERE value < 100) AS unresolved FROM events GROUP BY event_type")
def conditional_counts(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count_if(F.col("value") > 400).alias("resolved"), F.count_if(F.col("value").between(100, 400)).alias("skipped"), F.count_if(F.col("value") < 100).alias("unresolved"))


@query(f"WITH {P} SELECT user_id, arg_max(event_id, x - idx * 1e-9) AS first_best FROM p GROUP BY user_id")
def argmax_first(spark, d):
    return track(spark, d).groupBy("user_id").agg(aggregates.argmax_first(F.col("event_id"), F.col("x"), F.col("idx")).alias("first_best"))


@query(f"WITH {P} SELECT user_id, count(*) AS n, array_to_string(list(CAST(event_id AS VARCHAR) ORDER BY idx), ',') AS series FROM p GROUP BY user_id")
def nested_series(spark, d):
    g = track(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("idx", "event_id"))).alias("s"))
    return g.select("user_id", "n", F.array_join(F.transform("s", lambda x: x["event_id"].cast("string")), ",").alias("series"))


@query(f"WITH {V}, w AS (SELECT label, e[1] AS x, e[2] AS y, e[3] AS z FROM v), b AS (SELECT label, min(x) a1, max(x) a2, min(y) b1, max(y) b2, min(z) c1, max(z) c2 FROM w GROUP BY label), h AS (SELECT *, greatest(a2-a1, b2-b1, c2-c1)/2 AS h FROM b) SELECT label, round((a1+a2)/2-h, 6) AS x_low, round((a1+a2)/2+h, 6) AS x_high, round((b1+b2)/2-h, 6) AS y_low, round((b1+b2)/2+h, 6) AS y_high, round((c1+c2)/2-h, 6) AS z_low, round((c1+c2)/2+h, 6) AS z_high FROM h")
def bbox(spark, d):
    f = frames(spark, d).select("label", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))
    out = f.groupBy("label").agg(*aggregates.bounding_box("x", "y", "z"))
    return out.select("label", *(r6(F.col(c)).alias(c) for c in out.columns if c != "label"))


@query(f"WITH {V}, n AS (SELECT label, e[1] AS x, sqrt(list_sum(list_transform(e, lambda q: q * q))) AS norm FROM v) SELECT label, round(min(x), 6) AS x_min, round(max(x), 6) AS x_max, round(avg(x), 6) AS x_mean, round(avg(norm), 6) AS mean_norm FROM n GROUP BY label")
def vector_stats(spark, d):
    f = frames(spark, d).select("label", at(0).alias("x"), vector.array_norm(F.col("e")).alias("norm"))
    out = f.groupBy("label").agg(*aggregates.axis_stats("x"), F.avg("norm").alias("mean_norm"))
    return out.select("label", *(r6(F.col(c)).alias(c) for c in ("x_min", "x_max", "x_mean", "mean_norm")))


@query(f"WITH {V} SELECT a.label, round(avg(abs(a.e[1] - b.e[1])), 6) AS mad, count(*) AS n FROM v a JOIN v b ON a.frame = b.frame AND b.label = a.label + 1 GROUP BY a.label")
def run_mad(spark, d):
    """Each run against the next one."""
    f = frames(spark, d).withColumn("x", at(0))
    return aggregates.mean_differences(f, f.withColumn("label", F.col("label") - 1), CLIP, ["frame"], "x").select("label", r6(F.col("mad")).alias("mad"), "n")


@query(f"WITH {V}, c AS (SELECT label, frame, round(list_sum(list_transform(e[1:51], lambda q: q * q)) / 17, 9) AS calm FROM v) SELECT label, frame, round(calm, 6) AS calm FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY calm, frame) AS r FROM c) WHERE r = 1")
def calm_frame(spark, d):
    f = frames(spark, d).withColumn("sq", F.round(F.aggregate(F.slice("e", 1, 51), F.lit(0.0), lambda s, x: s + x * x) / 17, 9))
    return aggregates.calm_frame(f, CLIP, "frame", F.col("sq")).select("label", "frame", r6(F.col("calm")).alias("calm"))


@query(f"WITH {L17} SELECT clip_id, joint, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM l WHERE frame < 10 GROUP BY clip_id, joint")
def rest_pose(spark, d):
    out = aggregates.rest_pose(long17(spark, d), ["clip_id", "joint"], "frame", ["x", "y", "z"])
    return out.select("clip_id", "joint", *(r6(F.col(c)).alias(c) for c in "xyz"))


@query("SELECT coalesce(max(CAST(regexp_extract('run_' || CAST(n_nationkey AS VARCHAR) || '__x', '^run_([0-9]+)(?:__.*)?$', 1) AS BIGINT)), 0) + 1 AS next_run FROM nation")
def next_run(spark, d):
    names = table(spark, d, "nation").select(F.concat(F.lit("run_"), F.col("n_nationkey").cast("string"), F.lit("__x")).alias("name"))
    return aggregates.next_run(names, text.run_number("name"))


# Scalars


@query("SELECT doc_id, lower(trim(regexp_replace(regexp_replace(strip_accents(replace(replace(replace(replace(replace(replace(replace(replace(replace(trim(text), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue'), 'ß', 'ss'), '-', '_'), ' ', '_')), '[^A-Za-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_')) AS key FROM documents")
def canonical_name(spark, d):
    return table(spark, d, "documents").select("doc_id", text.canonical_name("text").alias("key"))


@query("WITH s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' \"' || replace(CAST(value AS VARCHAR), '.', ',') || '\" ' WHEN 1 THEN CAST(value AS VARCHAR) WHEN 2 THEN '  ' WHEN 3 THEN CAST(value AS VARCHAR) || 'd' ELSE '-' || CAST(value AS VARCHAR) END AS s FROM events), n AS (SELECT event_id, CASE event_id % 5 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE TRY_CAST(replace(trim(trim(s), '\"'), ',', '.') AS DOUBLE) END AS v FROM s) SELECT event_id, v, CAST(trunc(v) AS BIGINT) AS whole FROM n")
def parse_numbers(spark, d):
    e = events(spark, d)
    s = F.col("value").cast("string")
    kind = F.col("event_id") % 5
    raw = F.when(kind == 0, F.concat(F.lit(' "'), F.replace(s, F.lit("."), F.lit(",")), F.lit('" '))).when(kind == 1, s).when(kind == 2, "  ").when(kind == 3, F.concat(s, F.lit("d"))).otherwise(F.concat(F.lit("-"), s))
    return e.select("event_id", raw.alias("s")).select("event_id", numbers.to_double("s").alias("v"), numbers.to_long("s").alias("whole"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(CAST(floor(microsecond(ts) % 1000000 / 1000) AS BIGINT) AS VARCHAR), 3, '0') AS iso, epoch_us(ts) AS us FROM events")
def parse_times(spark, d):
    e = events(spark, d)
    form = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "M/d/yyyy, h:mm:ss.SSSSSS a")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "d.M.yyyy, H:mm:ss.SSSSSS")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    t = e.select("event_id", form.alias("s")).withColumn("t", F.when(F.col("event_id") % 3 == 2, times.event_time("s")).otherwise(times.track_time("s")))
    return t.select("event_id", times.iso_millis("t").alias("iso"), times.micros("t").alias("us"))


@query("SELECT event_id, (CAST(strftime(ts, '%M') AS INTEGER) > 37) AS late FROM events")
def clock_minute(spark, d):
    return events(spark, d).select("event_id", (times.clock_minute(F.date_format("ts", "d.M.yyyy, H:mm:ss")) > 37).alias("late"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, d):
    return events(spark, d).select("event_id", F.from_json("props", "struct<k:bigint>")["k"].alias("k"))


@query(f"WITH {P} SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(CAST(floor(microsecond(ts) % 1000000 / 1000) AS BIGINT) AS VARCHAR), 3, '0') AS t_local, idx AS ts_ms, value AS x, a AS v FROM p")
def json_roundtrip(spark, d):
    none = F.lit(None).cast("double")
    p = track(spark, d).withColumn("p", F.struct(F.col("ts").alias("local_dt"), F.col("idx").alias("ts_ms"), "x", none.alias("y"), none.alias("z"), F.col("a").alias("speed"), none.alias("accel"), none.alias("direction")))
    back = p.select("event_id", points.parse_series(points.json_text(F.array(points.ball_point(F.col("p"))))).alias("s"))
    q = F.element_at("s", 1)
    return back.select("event_id", q["t_local"].alias("t_local"), q["ts_ms"].alias("ts_ms"), q["x"].alias("x"), q["v"].alias("v"))


@query("SELECT l_orderkey, l_linenumber, round(sqrt(power(x - CASE WHEN x > 0 THEN 20 ELSE -20 END, 2) + y * y), 6) AS distance FROM (SELECT l_orderkey, l_linenumber, l_quantity - 25 AS x, l_discount * 10 AS y FROM lineitem)")
def goal_distance(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 25).alias("x"), (F.col("l_discount") * 10).alias("y"))
    return li.select("l_orderkey", "l_linenumber", r6(numbers.goal_distance(F.col("x"), F.col("y"), F.col("x"))).alias("distance"))


@query("SELECT event_id, round(greatest(-1.0, least(1.0, CASE WHEN g >= 0 THEN g / 80 ELSE g / 40 END)), 6) AS muscle FROM (SELECT event_id, value - 250 AS g FROM events)")
def muscle_limits(spark, d):
    return events(spark, d).select("event_id", r6(numbers.muscle(F.col("value") - 250, -40, 80)).alias("muscle"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 <> 0 THEN round(greatest(-1.0, least(1.0, (l_quantity - b) / b)), 6) END AS stretch FROM (SELECT *, CASE WHEN l_linenumber % 5 = 0 THEN 0 ELSE CAST(l_linenumber AS DOUBLE) * 4 END AS b FROM lineitem)")
def stretch_ratio(spark, d):
    li, n = table(spark, d, "lineitem"), F.col("l_linenumber")
    bind = F.when(n % 5 == 0, 0.0).otherwise(n.cast("double") * 4)
    return li.select("l_orderkey", "l_linenumber", r6(numbers.stretch(F.col("l_quantity").cast("double"), bind)).alias("stretch"))


@query("SELECT event_id, '(' || printf('%.2f', value) || ', ' || printf('%.2f', value + 1) || ', 0.00)' AS label FROM events")
def point_labels(spark, d):
    return events(spark, d).select("event_id", text.point_label(F.col("value"), F.col("value") + 1, F.lit(0.0)).alias("label"))


# Poses


@query(f"WITH {V}, s AS (SELECT label, frame, e, greatest(sqrt(power(e[23]-e[29],2)+power(e[24]-e[30],2)), 1e-6) AS k FROM v) SELECT label, frame, round((e[7]-e[1])/k, 6) AS x3, round((e[8]-e[2])/k, 6) AS y3, round(k, 6) AS scale FROM s")
def pose_normalize(spark, d):
    j = F.array(*(F.struct(at(2 * i).alias("x"), at(2 * i + 1).alias("y")) for i in range(17)))
    n = frames(spark, d).select("label", "frame", pose.normalised(j).alias("n"))
    p = F.element_at(F.col("n.joints"), 4)
    return n.select("label", "frame", r6(p["x"]).alias("x3"), r6(p["y"]).alias("y3"), r6(F.col("n.scale")).alias("scale"))


@query(f"""WITH {V}, k AS (SELECT label, frame, list_transform(range(17), lambda i: e[2*i+1]) AS x, list_transform(range(17), lambda i: abs(e[35+i])) AS c FROM v),
m AS (SELECT *, (x[1]+x[2]+x[3]+x[4]+x[5])*0.2 AS face, (x[6]+x[7])/2 AS thorax FROM k)
SELECT label, frame, round((x[12]+x[13])/2, 6) AS pelvis_x, round(0.65*thorax+0.35*face, 6) AS neck_x, round(0.7*x[1]+0.3*face, 6) AS head_x, round(least(c[12], c[13]), 6) AS pelvis_conf, round((c[1]+c[2]+c[3])/3, 6) AS head_conf, round(0.7*(x[1]+0.8*(x[1]-thorax))+0.3*face, 6) AS halpe_head_x FROM m""")
def midpoint_map(spark, d):
    k = F.array(*(pose.kp(at(2 * i), at(2 * i + 1), F.abs(at(34 + i))) for i in range(17)))
    f = frames(spark, d).select("label", "frame", k.alias("k")).select("label", "frame", pose.coco_to_h36m(F.col("k")).alias("h"), pose.coco_to_halpe(F.col("k")).alias("p"))
    j = lambda c, i, a: r6(F.element_at(c, i + 1)[a])
    return f.select("label", "frame", j("h", 0, "x").alias("pelvis_x"), j("h", 9, "x").alias("neck_x"), j("h", 10, "x").alias("head_x"), j("h", 0, "conf").alias("pelvis_conf"), j("h", 10, "conf").alias("head_conf"), j("p", 17, "x").alias("halpe_head_x"))


TREE = "t(joint, parent) AS (VALUES " + ", ".join(f"({j}, {p})" for j, p in enumerate(pose.H36M_PARENTS) if p >= 0) + ")"
SEGMENTS = f"WITH {L17}, {TREE}, g AS (SELECT c.clip_id, c.frame, c.joint, sqrt(power(c.x-q.x,2)+power(c.y-q.y,2)+power(c.z-q.z,2)) AS len FROM l c JOIN t ON t.joint = c.joint JOIN l q ON q.clip_id = c.clip_id AND q.frame = c.frame AND q.joint = t.parent)"


@query(SEGMENTS + " SELECT clip_id, joint, round(median(len), 6) AS bone FROM g GROUP BY clip_id, joint")
def bone_length_median(spark, d):
    return pose.segments(long17(spark, d)).groupBy("clip_id", "joint").agg(r6(F.median("length")).alias("bone"))


@query(SEGMENTS + " SELECT g.clip_id, g.frame, g.joint, round(m.bone, 4) AS length FROM g JOIN (SELECT clip_id, joint, median(len) AS bone FROM g GROUP BY 1, 2) m ON m.clip_id = g.clip_id AND m.joint = g.joint")
def constant_bones(spark, d):
    fixed = pose.constant_lengths(long17(spark, d))
    return pose.segments(fixed).select("clip_id", "frame", "joint", F.round("length", 4).alias("length"))


CLOSURE = "k(joint, bone_of) AS (VALUES " + ", ".join(f"({j}, {b})" for j, b in pose.ancestors(pose.H36M_PARENTS)) + ")"


@query(SEGMENTS.replace(" AS len FROM", " AS len, c.x-q.x AS dx, c.y-q.y AS dy, c.z-q.z AS dz FROM") + f""", {CLOSURE}, m AS (SELECT clip_id, joint, median(len) AS bone FROM g GROUP BY 1, 2),
b AS (SELECT g.clip_id, g.frame, g.joint, dx / len * bone AS b1, dy / len * bone AS b2, dz / len * bone AS b3 FROM g JOIN m ON m.clip_id = g.clip_id AND m.joint = g.joint),
s AS (SELECT b.clip_id, b.frame, k.joint, sum(b1) AS sx, sum(b2) AS sy, sum(b3) AS sz FROM b JOIN k ON k.bone_of = b.joint GROUP BY 1, 2, 3)
SELECT r.clip_id, r.frame, l.joint, round(r.x + coalesce(sx, 0), 6) AS x, round(r.y + coalesce(sy, 0), 6) AS y, round(r.z + coalesce(sz, 0), 6) AS z FROM l JOIN l r ON r.clip_id = l.clip_id AND r.frame = l.frame AND r.joint = 0 LEFT JOIN s ON s.clip_id = l.clip_id AND s.frame = l.frame AND s.joint = l.joint""")
def constant_positions(spark, d):
    return pose.constant_lengths(long17(spark, d)).select("clip_id", "frame", "joint", *(r6(F.col(c)).alias(c) for c in "xyz"))


@query(f"""WITH {V}, q AS (SELECT label, frame, e[10] AS x, e[11] AS y, e[12] AS z, e[13] AS w, sqrt(e[10]*e[10]+e[11]*e[11]+e[12]*e[12]+e[13]*e[13]) * CASE WHEN e[13] < 0 THEN -1 ELSE 1 END AS n FROM v)
SELECT label, frame, round(x / n, 5) AS x, round(y / n, 5) AS y, round(z / n, 5) AS z, round(w / n, 5) AS w FROM q""")
def best_rotation(spark, d):
    """Three vectors turned by a known rotation: the best fit finds it again."""
    turn = vector.q_unit(vector.quat(*(at(k) for k in range(9, 13))))
    f = frames(spark, d).select("label", "frame", F.array(*(vector.vec(*(at(3 * k + i) for i in range(3))) for k in range(3))).alias("rest"), turn.alias("q"))
    f = f.withColumn("pose", F.transform("rest", lambda p: vector.rotate(F.col("q"), p)))
    q = vector.best_rotation(F.col("rest"), F.col("pose"))
    return f.select("label", "frame", q.alias("b")).select("label", "frame", *(F.round(F.col("b")[k], 5).alias(k) for k in "xyzw"))


@query("SELECT l_returnflag, round(median(l_extendedprice), 6) AS price FROM lineitem GROUP BY l_returnflag")
def median_of_long_groups(spark, d):
    return medians.medians(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", bins=64, enough=100, name="price").withColumn("price", r6(F.col("price")))


@query("SELECT round(median(l_extendedprice * l_discount), 6) AS middle FROM lineitem")
def median_of_all(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_extendedprice") * F.col("l_discount")).alias("x"))
    return medians.medians(li, [], "x", name="middle").select(r6(F.col("middle")).alias("middle"))


@query(f"WITH {L17}, m AS (SELECT clip_id, min(y) AS low FROM l WHERE joint IN (3, 6) GROUP BY clip_id) SELECT l.clip_id, frame, joint, round(y - low, 6) AS y FROM l JOIN m ON m.clip_id = l.clip_id")
def ground_shift(spark, d):
    return pose.grounded(long17(spark, d)).select("clip_id", "frame", "joint", r6(F.col("y")).alias("y"))


@query(f"WITH {L17}, h AS (SELECT clip_id, frame, max(y) - min(y) AS h FROM l GROUP BY 1, 2), f AS (SELECT clip_id, 1.8 / greatest(median(h), 1e-6) AS f FROM h GROUP BY 1) SELECT l.clip_id, frame, joint, round(x*f, 6) AS x, round(y*f, 6) AS y, round(z*f, 6) AS z FROM l JOIN f ON f.clip_id = l.clip_id")
def scale_height(spark, d):
    return pose.scaled(long17(spark, d), 1.8).select("clip_id", "frame", "joint", *(r6(F.col(c)).alias(c) for c in "xyz"))


@query(f"WITH {V} SELECT label, vec_id, CAST(k AS INTEGER) AS marker, e[3*k+1] AS x, e[3*k+2] AS y, e[3*k+3] AS z FROM v, range(21) AS r(k) WHERE e[3*k+1] > 0")
def unpivot_markers(spark, d):
    f = frames(spark, d)
    wide = f.select("label", "vec_id", *(F.when(at(3 * k + i) > 0, at(3 * k + i)).otherwise(at(3 * k + i) if i else None).alias(f"{k} {a}") for k in range(21) for i, a in enumerate("XYZ")), at(63).alias("lone X"))
    return tables.unpivoted(wide, ["label", "vec_id"]).select("label", "vec_id", F.col("marker").cast("int").alias("marker"), "x", "y", "z")


def quats(spark: SparkSession, d: str) -> DataFrame:
    """label, vec_id, a, b: two unit quaternions of each row."""
    q = lambda i: vector.q_unit(vector.quat(at(4 * i), at(4 * i + 1), at(4 * i + 2), at(4 * i + 3)))
    return frames(spark, d).select("label", "vec_id", q(0).alias("a"), q(1).alias("b"))


def _unit(i: int, name: str) -> str:
    e = [f"e[{4 * i + k + 1}]" for k in range(4)]
    n = f"sqrt({' + '.join(f'{x}*{x}' for x in e)})"
    return ", ".join(f"CASE WHEN {e[3]} < 0 THEN -{x} ELSE {x} END / {n} AS {name}{k}" for x, k in zip(e, "xyzw"))


Q = f"WITH {V}, q AS (SELECT label, vec_id, {_unit(0, 'a')}, {_unit(1, 'k')} FROM v)"


@query(Q + " SELECT vec_id, round(ax, 6) AS x, round(ay, 6) AS y, round(az, 6) AS z, round(aw, 6) AS w FROM q")
def quat_normalize(spark, d):
    return quats(spark, d).select("vec_id", *(r6(F.col("a")[k]).alias(k) for k in "xyzw"))


@query(Q + " SELECT vec_id, round(-ax, 6) AS x, round(ay, 6) AS y, round(-az, 6) AS z, round(aw, 6) AS w FROM q")
def basis_flip(spark, d):
    return quats(spark, d).select("vec_id", *(r6(vector.q_flip_y(F.col("a"))[k]).alias(k) for k in "xyzw"))


@query(Q + " SELECT vec_id, round(aw*kx - ax*kw - ay*kz + az*ky, 6) AS x, round(aw*ky + ax*kz - ay*kw - az*kx, 6) AS y, round(aw*kz - ax*ky + ay*kx - az*kw, 6) AS z, round(aw*kw + ax*kx + ay*ky + az*kz, 6) AS w FROM q")
def quat_local(spark, d):
    return quats(spark, d).select("vec_id", *(r6(vector.q_local(F.col("a"), F.col("b"))[k]).alias(k) for k in "xyzw"))


@query(Q + ", d AS (SELECT *, ax*kx+ay*ky+az*kz+aw*kw AS d FROM q), h AS (SELECT *, CASE WHEN d < 0 THEN -1 ELSE 1 END AS s, sqrt(2 + 2*abs(d)) AS n FROM d) SELECT vec_id, round((ax + s*kx)/n, 6) AS x, round((ay + s*ky)/n, 6) AS y, round((az + s*kz)/n, 6) AS z, round((aw + s*kw)/n, 6) AS w FROM h")
def slerp_middle(spark, d):
    return quats(spark, d).select("vec_id", *(r6(vector.slerp(F.col("a"), F.col("b"), F.lit(0.5))[k]).alias(k) for k in "xyzw"))


@query(Q + " SELECT vec_id, round(degrees(asin(greatest(-1.0, least(1.0, 2*(ay*az + aw*ax))))), 4) AS x, round(degrees(atan2(2*(aw*az - ax*ay), 1 - 2*(ax*ax + az*az))), 4) AS z, round(degrees(atan2(2*(aw*ay - ax*az), 1 - 2*(ax*ax + ay*ay))), 4) AS y FROM q")
def euler_angles(spark, d):
    return quats(spark, d).select("vec_id", *(F.round(vector.euler_zxy(F.col("a"))[k], 4).alias(k) for k in "xyz"))


@query(f"WITH {V}, u AS (SELECT vec_id, e[1:3] AS p, e[4:6] AS r FROM v), n AS (SELECT vec_id, list_transform(p, lambda q: q / (sqrt(list_sum(list_transform(p, lambda s: s*s))) + 1e-8)) AS a, list_transform(r, lambda q: q / (sqrt(list_sum(list_transform(r, lambda s: s*s))) + 1e-8)) AS b FROM u), c AS (SELECT vec_id, a[2]*b[3]-a[3]*b[2] AS x, a[3]*b[1]-a[1]*b[3] AS y, a[1]*b[2]-a[2]*b[1] AS z, 1 + a[1]*b[1]+a[2]*b[2]+a[3]*b[3] AS w FROM n) SELECT vec_id, round(x/k, 5) AS x, round(y/k, 5) AS y, round(z/k, 5) AS z, round(w/k, 5) AS w FROM (SELECT *, sqrt(x*x+y*y+z*z+w*w) AS k FROM c)")
def direction_rotation(spark, d):
    f = frames(spark, d)
    q = vector.between(vector.vec(at(0), at(1), at(2)), vector.vec(at(3), at(4), at(5)))
    return f.select("vec_id", q.alias("q")).select("vec_id", *(F.round(F.col("q")[k], 5).alias(k) for k in "xyzw"))


@query(Q + " SELECT label, count(*) FILTER (WHERE abs(aw) > 0.9) AS near_identity, count(*) AS n FROM q GROUP BY label")
def identity_rotations(spark, d):
    return quats(spark, d).groupBy("label").agg(F.sum(markers.identity_count(F.array("a"), 0.1)).cast("long").alias("near_identity"), F.count(F.lit(1)).alias("n"))


@query("""WITH b AS (SELECT n_nationkey AS rank, 'rig:' || n_name AS bone FROM nation), w AS (SELECT r_name AS joint, n_name AS alias, n_nationkey AS priority FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT joint, bone FROM (SELECT joint, bone, row_number() OVER (PARTITION BY joint ORDER BY priority, rank) AS r FROM w JOIN b ON regexp_replace(lower(split_part(bone, ':', 2)), '[^a-z0-9]', '', 'g') = regexp_replace(lower(alias), '[^a-z0-9]', '', 'g')) WHERE r = 1""")
def bone_lookup(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    bones = n.select(F.col("n_nationkey").alias("rank"), F.concat(F.lit("rig:"), F.col("n_name")).alias("bone"))
    wanted = n.join(r, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("joint"), F.col("n_name").alias("alias"), F.col("n_nationkey").alias("priority"))
    return markers.bone_map(wanted, bones)


# Resampling and sampling


@query(f"WITH {V}, n AS (SELECT label, count(*) AS n FROM v GROUP BY label), r AS (SELECT label, n, unnest(range(0, CAST(ceil(n / 0.37) AS BIGINT) + 4)) AS k FROM n), g AS (SELECT label, n, k, (k * CAST(0.37 AS DOUBLE)) % n AS pos FROM r), h AS (SELECT *, least(CAST(floor(pos) AS BIGINT), n-1) AS lo FROM g), i AS (SELECT *, CASE WHEN lo + 1 < n THEN lo + 1 ELSE 0 END AS hi FROM h) SELECT i.label, i.k, round(a.e[1] + (b.e[1]-a.e[1])*(i.pos - i.lo), 6) AS x FROM i JOIN v a ON a.label = i.label AND a.frame = i.lo JOIN v b ON b.label = i.label AND b.frame = i.hi")
def resample_lerp(spark, d):
    f = frames(spark, d).withColumn("x", at(0))
    n = f.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    grid = n.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / 0.37) + 3)))  # a loop and some positions more
    grid = grid.withColumn("pos", resample.frame_position(F.col("k") * 0.37, F.lit(1.0), F.col("n")))
    low, high, share = resample.neighbours(F.col("pos"), F.col("n"))
    grid = grid.select("label", "k", low.alias("low"), high.alias("high"), share.alias("share"))
    return resample.resampled(f, grid, CLIP, "frame", scalars=["x"]).select("label", "k", r6(F.col("x")).alias("x"))


@query(f"WITH {V}, n AS (SELECT label, count(*) AS n FROM v GROUP BY label), r AS (SELECT label, n, unnest(range(0, CAST(ceil(n / 1.25) AS BIGINT) + 4)) AS k FROM n) SELECT label, k, greatest(0, least(CAST(floor(k * 1.25) AS BIGINT), n - 1)) AS frame FROM r")
def frame_clamp(spark, d):
    n = frames(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    grid = n.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / 1.25) + 3)))
    return grid.select("label", "k", resample.truncated_frame(F.col("k") * 1.25, F.col("n")).alias("frame"))


@query("SELECT least(100, count(*)) AS n, least(100, count(*)) AS different, least(100, count(*)) AS members FROM orders")
def sample_exact_n(spark, d):
    orders = table(spark, d, "orders")
    picked = shots.first_or_sample(orders, sample=100, order="o_orderkey", seed=7).select("o_orderkey")
    one = F.count(F.lit(1))
    own = picked.join(orders.select("o_orderkey"), "o_orderkey", "left_semi").agg(one.alias("members"))
    return picked.agg(one.alias("n"), F.countDistinct("o_orderkey").alias("different")).join(own)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'")
def home_and_away(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("home_team"), F.col("o_orderpriority").alias("away_team"))
    return shots.chosen(o, home="F", away="2-HIGH").select("o_orderkey")


@query("SELECT event_id, user_id, first_event, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS nth FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id) AS first_event FROM events)")
def file_order(spark, d):
    e = shots.in_file_order(events(spark, d).select("event_id", "user_id"), "user_id", "event_id")
    return e.withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")).select("event_id", "user_id", "first_event", "nth")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50")
def limit_first_n(spark, d):
    return shots.first_or_sample(table(spark, d, "orders"), limit=50, order="o_orderkey").select("o_orderkey")


# Extension


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_hours(spark, d):
    return streams.tumbling(events(spark, d)).select("start", "event_type", "n", F.round("total", 4).alias("total"))


# Files: the driver's rows are written in the file formats and scanned back

SAID = "strftime(ts, '%d.%m.%Y, %H:%M:%S.%g')"


def position_files(spark: SparkSession, d: str) -> str:
    """Position files of events: balls on their way, and others in front of a goal; decimal commas, blanks and gaps."""
    e = events(spark, d)
    clock = F.concat(F.date_format("ts", "dd.MM.yyyy, HH:mm:ss.SSS"))
    comma = lambda c: F.replace(F.round(c, 3).cast("string"), F.lit("."), F.lit(","))
    ball = F.col("event_type") == "view"
    rows = e.select(
        clock.alias("formatted local time"), F.when(ball, " Ball ").otherwise("Home").alias("group name"), F.when(F.col("event_id") % 17 != 0, comma(F.col("value") / 13 - 20)).alias("x in m"),
        comma((F.col("event_id") % 40).cast("double") / 10 - 2).alias("y in m"), F.lit("0").alias("z in m"), comma(F.col("value")).alias("speed in m/s"), F.lit("").alias("acceleration in m/s2"), F.lit("x").alias("direction of movement in deg"),
        F.col("event_id").cast("string").alias("ts in ms"), F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).alias("sensor id"), F.concat(F.lit('"K" ;'), F.col("user_id")).alias("full name"),
    )
    path = new_folder(spark, "positions")
    sinks.write_table(rows, path)
    return path


POS = """q AS (SELECT event_id AS ts_ms, date_trunc('millisecond', ts) AS local_dt, CASE WHEN event_id % 17 <> 0 THEN round(value / 13 - 20, 3) END AS x, round(CAST(event_id % 40 AS DOUBLE) / 10 - 2, 3) AS y, round(value, 3) AS speed, event_type, user_id FROM events)"""


@query(f"WITH {POS} SELECT ts_ms, local_dt, x, y, speed FROM q WHERE event_type = 'view' AND x IS NOT NULL")
def scan_ball_positions(spark, d):
    raw, _ = tables.positions(spark, position_files(spark, d), glob="*.csv")
    return tables.ball_points(raw).where("accel is null and direction is null and z = 0").select("ts_ms", "local_dt", "x", "y", "speed")


@query(f"WITH {POS} SELECT ts_ms, x, y, CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE '\"K\" ;' || user_id END AS sensor_id FROM q WHERE event_type <> 'view' AND abs(x) BETWEEN 16 AND 20 AND abs(y) <= 1.5")
def scan_keeper_positions(spark, d):
    raw, _ = tables.positions(spark, position_files(spark, d), tables.KEEPER_REQUIRED, glob="*.csv")
    return tables.keeper_candidates(raw).select("ts_ms", "x", "y", "sensor_id")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority || '; \"' || o_orderstatus || '\"' AS home_team, CASE WHEN o_custkey % 3 > 0 THEN o_orderpriority END AS away_team, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS row_idx, CAST(NULL AS VARCHAR) AS player_name FROM orders")
def scan_event_files(spark, d):
    o = table(spark, d, "orders").select(F.when(F.col("o_custkey") % 3 > 0, F.col("o_orderpriority")).alias("away_team"), F.col("o_orderkey").cast("string").alias("id"), F.concat("o_orderpriority", F.lit('; "'), "o_orderstatus", F.lit('"')).alias("home_team"), "o_orderkey")
    path = new_folder(spark, "events")
    sinks.write_table(o, path, ("away_team", "id", "home_team"), order=("o_orderkey",))
    return tables.events(spark, path).select("id", "home_team", "away_team", "row_idx", "player_name")


@query("SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS id, CAST(floor(l_extendedprice) AS BIGINT) AS ts_ms, l_quantity::DOUBLE AS distance, l_returnflag AS success FROM lineitem")
def scan_shot_files(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.select(F.col("l_returnflag").alias("success"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.format_number(F.floor("l_extendedprice"), 0).alias("timestamp_ms"), F.replace(F.col("l_quantity").cast("double").cast("string"), F.lit("."), F.lit(",")).alias("distance"))
    path = new_folder(spark, "shots")
    sinks.write_table(rows, path)
    return tables.shots(spark, path).select("id", "ts_ms", "distance", "success")


@query("SELECT p_partkey AS line_no, p_name || '; ' || coalesce(p_type, '') AS value FROM (SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS p_partkey, p_name, p_type FROM part)")
def scan_lines(spark, d):
    p = table(spark, d, "part")
    path = new_folder(spark, "lines")
    sinks.write_documents(p.select(F.lit("parts").alias("clip_id"), F.col("p_partkey").alias("at"), F.concat("p_name", F.lit("; "), F.coalesce("p_type", F.lit(""))).alias("line")), path)
    return tables.lines(spark, path).where("file_name = 'parts'").select("line_no", "value")


@query(f"WITH {V} SELECT label || ' clip' AS clip_id, frame, m AS marker, round(e[3*k+1], 5) AS x, round(e[3*k+3], 5) AS y, round(e[3*k+2], 5) AS z FROM v, (VALUES (0, 'A'), (1, 'B C')) AS t(k, m) WHERE NOT (k = 1 AND frame % 5 = 0)")
def scan_marker_files(spark, d):
    f = frames(spark, d).withColumn("clip_id", F.concat("label", F.lit(" clip")))
    mm = lambda i: F.format_string("%.2f", at(i) * 1000)
    gap = F.col("frame") % 5 == 0
    body = f.select("clip_id", F.col("frame").alias("at"), F.concat_ws("\t", F.col("frame").cast("string"), F.format_string("%.3f", F.col("frame") / 300), mm(0), mm(1), mm(2), F.when(gap, "").otherwise(mm(3)), mm(4), mm(5)).alias("line"))
    head = f.select("clip_id").distinct().select("clip_id", F.lit(-1).cast("long").alias("at"), F.lit("FREQUENCY\t300\nMARKER_NAMES\tA\tB C\nFrame\tTime\tA X\tA Y\tA Z\tB C X\tB C Y\tB C Z").alias("line"))
    path = new_folder(spark, "markers")
    sinks.write_documents(body.union(head), path)
    points, _, _ = tables.markers(spark, path, axes="xzy")
    return points.select("clip_id", "frame", "marker", *(F.round(c, 5).alias(c) for c in "xyz"))


QUATS = ", ".join(f"e[{k}]" for k in range(1, 65))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """clip_id, frame, root, quats (16) of embeddings."""
    f = frames(spark, d).withColumn("clip_id", F.concat(F.lit("no "), F.col("label").cast("string")))
    quats = F.array(*(vector.quat(*(at(4 * j + k) for k in range(4))) for j in range(16)))
    return f.select("clip_id", "frame", vector.vec(at(0), at(1), at(2)).alias("root"), quats.alias("quats"))


@query(f"WITH {V} SELECT 'no ' || label AS clip_id, frame, CAST(j AS INTEGER) AS joint, 'joint ' || j AS name, round(e[4*j+1], 6) AS qx, round(e[4*j+2], 6) AS qy, round(e[4*j+3], 6) AS qz, round(e[4*j+4], 6) AS qw FROM v, range(16) AS r(j)")
def scan_animation_documents(spark, d):
    path = new_folder(spark, "animations")
    sinks.write_documents(sinks.animation_lines(_documents(spark, d), [f"joint {j}" for j in range(16)]), path)
    q = animations.frame_rotations(animations.clips(spark, path).frames)
    return q.select("clip_id", F.col("frame").cast("long").alias("frame"), "joint", "name", *(r6(F.element_at("q", k + 1)).alias(f"q{a}") for k, a in enumerate("xyzw")))


@query(f"WITH {V} SELECT 'no ' || label AS clip_id, frame, 51 AS channels, round(e[1], 6) AS x, round(e[2], 6) AS y, round(e[3], 6) AS z FROM v")
def scan_bvh_documents(spark, d):
    names, parents = [f"j{j}" for j in range(16)], [-1, *range(15)]
    path = new_folder(spark, "bvh")
    sinks.write_documents(sinks.bvh_lines(_documents(spark, d), sinks.bvh_hierarchy(names, parents, [(0.0, 0.0, 0.0)] * 16), parents), path)
    m = tables.bvh_motion(spark, path)
    return m.select(F.col("file_name").alias("clip_id"), F.col("frame").cast("long").alias("frame"), F.size("channels").alias("channels"), *(r6(F.element_at("channels", k + 1)).alias(a) for k, a in enumerate("xyz")))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS row_idx, o_orderpriority AS penalty_id, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS home_team, 'a;b' AS away_team, 'late \"' || o_orderpriority || '\"' AS issue FROM orders WHERE o_totalprice > 100000")
def written_issues(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 100000")
    rows = o.select(F.concat(F.lit('late "'), "o_orderpriority", F.lit('"')).alias("issue"), F.col("o_orderkey").cast("string").alias("row_idx"), F.col("o_orderpriority").alias("penalty_id"), F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus")).alias("home_team"), F.lit("a;b").alias("away_team"))
    path = sinks.run_folder(spark, new_folder(spark, "runs")) + "/issues"
    sinks.write_issues(rows, path)
    ((_, back),) = text_files.delimited(spark, text_files.by_header(spark, path))
    return back.select("row.*")


@query(f"WITH {V} SELECT 'no ' || label || '.npy' AS clip_id, frame, CAST(j AS INTEGER) AS joint, CAST(a AS INTEGER) AS axis, CASE WHEN (j + frame) % 9 > 0 THEN round(e[3*j+a+1], 9) END AS value FROM v, range(17) AS r(j), range(3) AS s(a)")
def scan_array_files(spark, d):
    f = frames(spark, d).select(F.concat(F.lit("no "), F.col("label")).alias("clip_id"), "frame", F.posexplode(F.slice("e", 1, 51)).alias("k", "value"))
    long = f.select("clip_id", "frame", F.expr("k div 3").cast("int").alias("joint"), (F.col("k") % 3).alias("axis"), "value").where("(joint + frame) % 9 > 0")
    path = new_folder(spark, "arrays")
    arrays.write_arrays(long, path, 17)
    back = arrays.array_points(spark, path)
    return back.select("clip_id", "frame", "joint", "axis", F.round(F.nanvl("value", F.lit(None).cast("double")), 9).alias("value"))
