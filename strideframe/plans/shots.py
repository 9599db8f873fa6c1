"""Entry A: events matched to recordings, corrected, cut and enriched (COR01-COR06, AGG02-AGG04, JOIN07, WIN07, WIN08).

Everything that depends on a point alone (next crossing, next gate, reversal, back-walk) is one windowed
pass over the points. Events then need as-of lookups and slices: no event looks at a series row by row.
Rejected events carry a reason and end in the issues table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import goal_distance, six_decimals, to_double
from ..functions.points import ball_point, json_text, keeper_point
from ..functions.text import blank_to_null, joined_flags, strip
from ..functions.times import event_time, iso_millis, micros
from ..functions.vector import let
from ..operators import asof, series
from ..operators.fixtures import resolve, split_issues
from ..schemas import ISSUE_COLUMNS, RESULT_COLUMNS
from ..session import materialised

PREPEND = 5
MOST_POINTS = 60
BACK = 3_000_000  # microseconds looked back for the peak
AFTER = 300_000
LEAD = 5_200_000  # the furthest that a release can move a window's start, and the margin
KEY = ["fixture_file"]


def wanted_events(events: DataFrame, event_id: str | None = None, include_unsuccessful: bool = False) -> DataFrame:
    """Successful events (or all) whose clock isn't one of the two that are tracked wrongly."""
    if event_id is not None:
        events = events.where(strip(F.coalesce("id", F.lit(""))) == event_id)
    if not include_unsuccessful:
        events = events.where(strip(F.coalesce("success", F.lit(""))) == "1")
    return events.where(~strip(F.coalesce("game_clock", F.lit(""))).isin("30:00", "60:00"))


def chosen(events: DataFrame, event_id: str | None = None, home: str | None = None, away: str | None = None) -> DataFrame:
    """The event of that id; without id, the events of home and away team; without both teams, all of them."""
    if event_id:
        return events.where(F.col("id") == event_id)
    return events.where((F.col("home_team") == home) & (F.col("away_team") == away)) if home and away else events


def with_first_event(results: DataFrame, file: str = "fixture_file", event: str = "event_no") -> DataFrame:
    """``results`` with ``first_event`` of their recording, aggregated before it is joined, so that a recording
    with most rows isn't one group.
    """
    first = results.groupBy(F.col(file).alias("_file")).agg(F.min(event).alias("first_event"))
    return results.join(first, F.col(file).eqNullSafe(F.col("_file"))).drop("_file")


def in_file_order(results: DataFrame, file: str = "fixture_file", event: str = "event_no") -> DataFrame:
    """``results`` by recording, the one with the earliest event first, then by event; ``first_event`` is added."""
    return with_first_event(results, file, event).orderBy("first_event", F.asc_nulls_last(file), event)


def first_or_sample(events: DataFrame, limit: int | None = None, sample: int | None = None, order: str = "row_idx", seed: int | None = None) -> DataFrame:
    """``sample`` events without replacement, exactly that many; else the first ``limit``; else all."""
    if sample:
        return events.orderBy(F.rand(seed)).limit(sample)
    return events.orderBy(order).limit(limit) if limit else events


def annotated(points: DataFrame) -> DataFrame:
    """Points with idx, t (microseconds) and what follows or precedes each of them."""
    p = points.withColumn("t", micros("local_dt"))
    p = series.indexed(p, KEY, ["local_dt", F.coalesce("ts_ms", F.lit(-1)), "file_ord"])
    w = series._ahead(KEY, "idx", True)
    return p.select(
        "*",
        series.next_match(series.crossing(F.col("x")), KEY).alias("next_cross"),
        series.next_match(series.gate(F.col("x")), KEY).alias("next_gate"),
        series.reversal("x", KEY).alias("reversal"),
        series.run_start("accel", KEY).alias("run_start"),
        F.max("idx").over(w).alias("last_idx"),
    )


def _at(events: DataFrame, points: DataFrame, idx: str, columns: dict[str, str]) -> DataFrame:
    """``events`` with columns of the point at position ``idx``."""
    side = points.select(*KEY, F.col("idx").alias("_i"), *(F.col(c).alias(n) for c, n in columns.items()))
    return events.join(side.withColumnRenamed("fixture_file", "_f"), (F.col("fixture_file") == F.col("_f")) & (F.col(idx) == F.col("_i")), "left").drop("_f", "_i")


def corrected_start(events: DataFrame, points: DataFrame) -> DataFrame:
    """``start_idx`` after the distance rules, and their flag. Events have start0 and start0_t.

    Below 6.95 m: back from the last strongest acceleration of the three seconds before to where its rise
    began, then one second earlier. Above 8 m: forward to the gate in front of the goal.
    """
    short = events.where(F.col("dist") < 6.95).select("event_no", *KEY, "start0_t")
    accel = points.where("accel is not null").select(*KEY, "idx", "t", "accel", "run_start")
    near = asof.within(short, accel, KEY, "start0_t", "t", BACK, 0)
    peaks = near.groupBy("event_no", *KEY).agg(F.max("accel").alias("peak"), F.collect_list(F.struct("idx", "accel", "run_start")).alias("ps"))
    tied = F.filter("ps", lambda p: F.abs(p["accel"] - F.col("peak")) <= 1e-6)
    # structs compare by their first field: the largest position
    released = peaks.withColumn("release_idx", F.array_max(F.transform(tied, lambda p: F.struct(p["idx"].alias("idx"), p["run_start"].alias("run_start"))))["run_start"]).select("event_no", *KEY, "release_idx")
    released = _at(released, points, "release_idx", {"t": "_rt"}).withColumn("_from", F.col("_rt") - 1_000_000)
    moved = asof.asof(released, points, KEY, "_from", "t", ["idx"], True, "idx", "moved_").select("event_no", "release_idx", "moved_idx")
    out = events.join(moved, "event_no", "left")
    d = F.col("dist")
    start = F.when(d < 6.95, F.coalesce("moved_idx", "start0")).when(d > 8, F.coalesce("start0_gate", "start0")).otherwise(F.col("start0"))
    flag = (
        F.when(d.isNull(), "distance_check:missing_distance")
        .when(d < 6.95, F.when(F.col("moved_idx").isNull(), "short_distance_correction:no_release_detected").otherwise("short_distance_correction:applied"))
        .when(d > 8, F.when(F.col("start0_gate").isNull(), "long_distance_correction:no_x_gate_match").otherwise("long_distance_correction:applied"))
        .otherwise("distance_check:in_range")
    )
    return out.withColumn("start_idx", start).withColumn("correction_flag", flag).drop("moved_idx", "start0_gate")


def plausible(dist: Column, reversal: Column) -> Column:
    return F.coalesce(dist.between(6.5, 7.5) & ~reversal, F.lit(False))


def select_release(points: Column) -> Column:
    """The release point of an array of points, and its flag: strongest acceleration 6.5 to 7.5 m before the
    goal on the first point's side, else anywhere, else highest speed, else the first point; first of equals.
    """
    side = F.get(points, F.lit(0))["x"]

    def ranked(p: Column) -> Column:
        zone = goal_distance(p["x"], p["y"], side).between(6.5, 7.5)
        tier = F.when(p["accel"].isNotNull() & zone, 3).when(p["accel"].isNotNull(), 2).when(p["speed"].isNotNull(), 1).otherwise(0)
        metric = F.when(tier >= 2, p["accel"]).when(tier == 1, p["speed"]).otherwise(0.0)
        return F.struct(tier.alias("tier"), metric.alias("metric"), (-p["idx"]).alias("back"), p.alias("p"))

    best = F.array_max(F.transform(points, ranked))
    names = F.array(F.lit("first_point_fallback"), F.lit("max_v_fallback"), F.lit("max_a_fallback_global"), F.lit("max_a"))
    return F.struct(best["p"].alias("p"), F.concat(F.lit("release_point:"), F.element_at(names, best["tier"] + 1)).alias("flag"))


def _released(df: DataFrame) -> DataFrame:
    """Release point, and the window's start moved back where the release is already too near the goal."""
    inside = lambda lo: F.filter("wide", lambda p: p["idx"].between(F.col(lo), F.col("ext_end")))
    own = F.get(F.filter("wide", lambda p: p["idx"] == F.col("start_idx")), F.lit(0))
    df = df.withColumn("_sel", select_release(inside("ext_start"))).withColumn("_own", own)
    begin = F.get(F.filter("wide", lambda q: q["idx"] == F.col("ext_start")), F.lit(0))["t"]

    def moved(p: Column, d: Column, need: Column) -> Column:
        target = p["t"] - F.round((need + 0.1) * 1e6).cast("long")
        wants = ~F.col("is_plausible") & (d < 6.5) & (p["speed"] > 0) & (need > 0) & (need < 5.0) & (target < begin)
        # bound, or it would be computed for each point
        first = let(target)(lambda t: F.get(F.filter("wide", lambda q: q["t"] >= t), F.lit(0))["idx"])
        return F.when(F.coalesce(wants, F.lit(False)), let(first)(lambda i: F.when(i < F.col("ext_start"), i)))

    p = F.col("_sel.p")
    new = let(goal_distance(p["x"], p["y"], p["x"]))(lambda d: let(F.try_divide(7.5 - d, p["speed"]))(lambda need: moved(p, d, need)))
    df = df.withColumn("_new", new)
    df = df.withColumn("ext_start", F.coalesce("_new", "ext_start")).withColumn("_again", F.when(F.col("_new").isNotNull(), select_release(inside("ext_start"))))
    release = F.when(F.col("is_plausible"), F.col("_own")).otherwise(F.coalesce(F.col("_again.p"), F.col("_sel.p")))
    flag = F.when(F.col("is_plausible"), F.lit("release_point:start_timestamp_plausible")).otherwise(F.col("_sel.flag"))
    extended = F.when(F.col("_new").isNotNull(), F.lit("release_point:dynamic_extended"))
    return df.withColumn("release", release).withColumn("release_flag", flag).withColumn("extended_flag", extended).drop("_sel", "_own", "_new", "_again")


def align_keeper(segment: Column, traj: Column) -> Column:
    """The keeper's nearest sample for each ball point, on the ball's times; the earlier of two equally near."""

    def pick(b: Column) -> Column:
        # samples are in order of time: the last one up to the ball's, and the next
        n = F.size(F.filter(segment, lambda s: s["t"] <= b["t"]))
        near = let(n, b["t"])(lambda n, t: let(F.get(segment, n - 1), F.get(segment, n))(lambda last, next_: F.when(last.isNull() | (next_["t"] - t < t - last["t"]), next_).otherwise(last)))
        return let(near)(lambda s: F.struct(b["local_dt"].alias("local_dt"), b["ts_ms"].alias("ts_ms"), s["x"].alias("x"), s["y"].alias("y"), s["z"].alias("z")))

    return F.transform(traj, pick)


def with_keeper(shots: DataFrame, keepers: DataFrame) -> DataFrame:
    """``keeper`` (aligned points) and ``goalkeeper_sensor_id``: the sensor on the ball's side with most samples in
    the window, then nearest to the line, then to the middle, then of lowest id.
    """
    mean_x = F.aggregate("traj", F.lit(0.0), lambda s, p: s + p["x"]) / F.size("traj")
    shots = shots.withColumn("_side", F.when(mean_x < 0, -1).otherwise(1)).withColumn("_t0", F.get("traj", F.lit(0))["t"]).withColumn("_t1", F.try_element_at("traj", F.lit(-1))["t"])
    bucket = 10_000_000
    one = shots.select("event_no", *KEY, "_side", "_t0", "_t1", F.explode(F.sequence(F.floor(F.col("_t0") / bucket), F.floor(F.col("_t1") / bucket))).alias("_bucket"))
    two = keepers.withColumn("t", micros("local_dt")).withColumn("_bucket", F.floor(F.col("t") / bucket))
    met = one.join(two, [*KEY, "_bucket"]).where(F.col("t").between(F.col("_t0"), F.col("_t1")) & (F.signum("x") == F.col("_side")))
    sample = F.struct("t", F.coalesce("ts_ms", F.lit(-1)).alias("o"), "file_ord", "x", "y", "z")
    scores = met.groupBy("event_no", "sensor_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("x")).alias("ax"), F.avg(F.abs("y")).alias("ay"), F.array_sort(F.collect_list(sample)).alias("segment"))
    # largest by score; sensor ids break ties towards the lowest, so they are ranked apart
    from ..operators.aggregates import top_one

    best = top_one(scores, ["event_no"], F.desc("n"), F.desc("ax"), F.asc("ay"), F.asc("sensor_id")).select("event_no", "sensor_id", "segment")
    out = shots.drop("_side", "_t0", "_t1").join(best, "event_no", "left")
    keeper = F.when(F.col("segment").isNotNull(), align_keeper(F.col("segment"), F.col("traj")))
    return out.withColumn("keeper", keeper).withColumn("goalkeeper_sensor_id", F.coalesce("sensor_id", F.lit(""))).drop("segment", "sensor_id")


def match_shots(events: DataFrame, points: DataFrame, keepers: DataFrame, include_unsuccessful: bool = False, extend_start_ms: int = 0, load_issues: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, issues, skipped) of events that have ``fixture_file`` (see ``resolve``) and ``row_idx``.

    points and keepers are the typed rows of the recordings. skipped: events with too many points, which
    are counted and neither results nor issues.

    keep: materialises a table (``session.materialised`` by default, ``DataFrame.cache``, a written table); used where
    several results branch off, so that asking for all three doesn't compute the common part three times.
    """
    keep = keep or materialised
    ev = events.withColumn("event_no", F.col("row_idx").cast("long")).withColumn("dist", to_double("distance")).withColumn("shot_t", micros(event_time("timestamp_local_timezone")))
    ev = ev.withColumn("is_success", strip(F.coalesce("success", F.lit(""))) == "1")
    # only recordings that events ask for are looked at
    asked = ev.select(*KEY).distinct()
    pts = keep(annotated(points.join(asked, KEY, "left_semi")))
    have = points.select(*KEY).distinct().withColumn("_has", F.lit(True))
    ev = ev.join(have, KEY, "left")
    if load_issues is not None:
        ev = ev.join(load_issues.select(*KEY, F.col("issue").alias("_load")), KEY, "left")
    else:
        ev = ev.withColumn("_load", F.lit(None).cast("string"))
    started = asof.asof(ev, pts, KEY, "shot_t", "t", ["idx", "t", "next_gate"], True, "idx", "s_")
    issue = F.when(F.col("_load").isNotNull(), F.col("_load")).when(F.col("_has").isNull(), "no_ball_points").when(F.col("shot_t").isNull(), "invalid_shot_local_time").when(F.col("s_idx").isNull(), "shot_start_after_last_ball_point")
    started = keep(started.withColumn("issue", issue))
    early, ev = started.where("issue is not null"), started.where("issue is null").drop("issue", "_has", "_load")
    ev = corrected_start(ev.withColumnRenamed("s_idx", "start0").withColumnRenamed("s_t", "start0_t").withColumnRenamed("s_next_gate", "start0_gate"), pts)
    ev = _at(ev, pts, "start_idx", {"t": "start_t", "next_cross": "_cross", "reversal": "_reversal", "last_idx": "_last"})
    use_last = F.col("_cross").isNull() & ~F.col("is_success") & F.lit(include_unsuccessful)
    ev = ev.withColumn("end_idx", F.when(use_last, F.col("_last")).otherwise(F.col("_cross"))).withColumn("last_flag", F.when(use_last, F.lit("unsuccessful:using_last_point")))
    ev = keep(ev)
    late, ev = ev.where("end_idx is null").withColumn("issue", F.lit("no_goalline_crossing_found")), ev.where("end_idx is not null")
    ev = _at(ev, pts, "end_idx", {"t": "end_t"})
    ev = ev.withColumn("is_plausible", plausible(F.col("dist"), F.col("_reversal"))).drop("_cross", "_reversal", "_last")
    ev = ev.withColumn("_from", F.col("start_t") - 1000 * extend_start_ms).withColumn("_wide", F.col("start_t") - 1000 * extend_start_ms - LEAD).withColumn("_to", F.col("end_t") + AFTER)
    ev = asof.lookups(ev, pts, KEY, "event_no", {"f_": ("_from", True), "w_": ("_wide", True), "e_": ("_to", False)}, "t", ["idx"], "idx")
    ev = ev.withColumn("ext_start", F.col("f_idx")).withColumn("ext_end", F.col("e_idx")).withColumn("_lo", F.greatest(F.col("w_idx") - PREPEND, F.lit(0)))
    ev = ev.drop("_from", "_wide", "_to", "f_idx", "w_idx", "e_idx")
    said = pts.withColumn("t_local", iso_millis("local_dt"))  # once a point, not for each shot that has it
    cut = asof.slices(ev, said, KEY, "_lo", "ext_end", "idx", ["t", "local_dt", "t_local", "ts_ms", "x", "y", "z", "speed", "accel", "direction"]).withColumnRenamed("points", "wide")
    cut = _released(cut)
    before = F.least(F.col("ext_start"), F.lit(PREPEND))
    cut = cut.withColumn("traj", F.filter("wide", lambda p: p["idx"].between(F.col("ext_start") - before, F.col("ext_end")))).withColumn("_n", F.size("traj")).withColumn("_before", before).drop("wide")
    cut = keep(cut)
    skipped, cut = cut.where(F.col("_n") >= MOST_POINTS), cut.where(F.col("_n") < MOST_POINTS)
    out = with_keeper(cut, keepers)
    n = F.col("_n")
    size = F.coalesce(F.size("keeper"), F.lit(0))
    flags = joined_flags(
        F.col("correction_flag"), F.col("last_flag"), F.col("release_flag"), F.col("extended_flag"),
        F.when(F.col("_before") > 0, F.concat(F.lit("ball_prepend_frames:"), F.col("_before").cast("string"))),
        F.concat(F.lit("goalkeeper_points:"), size.cast("string")), F.when(size > 0, F.lit("goalkeeper_aligned_with_ball:1")),
    )
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    best = lambda k: let(F.array_max(F.transform("traj", lambda p: p[k])))(six_decimals)
    values = {
        **{c: text(c) for c in ("id", "home_team", "away_team", "fixture_file", "player_id", "success", "distance", "timestamp_local_timezone", "goalkeeper_sensor_id")},
        "player_name": F.coalesce(blank_to_null("player_name"), text("name")),
        "start_time_local": iso_millis(F.get("traj", F.lit(0))["local_dt"]),
        "end_time_local": iso_millis(F.try_element_at("traj", F.lit(-1))["local_dt"]),
        "release_point_json": json_text(ball_point(F.col("release"))),
        "release_time_local": iso_millis(F.col("release")["local_dt"]),
        "max_v": best("speed"),
        "max_a": best("accel"),
        "release_angle": six_decimals(F.col("release")["direction"]),
        "trajectory_point_count": n.cast("string"),
        "trajectory_json": json_text(F.transform("traj", lambda p: ball_point(p, p["t_local"]))),
        "goalkeeper_trajectory_json": F.coalesce(json_text(F.zip_with("keeper", "traj", lambda k, p: keeper_point(k, p["t_local"]))), F.lit("[]")),
        "flags": flags,
    }
    results = out.select("event_no", *(values[c].alias(c) for c in RESULT_COLUMNS))
    issues = early.select(*_issue()).union(late.select(*_issue()))
    return results, issues, skipped.select("event_no", "id", F.col("_n").alias("points"))


def _issue() -> list[Column]:
    return [F.col("row_idx").cast("string").alias("row_idx"), F.coalesce("id", F.lit("")).alias("penalty_id"), F.coalesce("home_team", F.lit("")).alias("home_team"), F.coalesce("away_team", F.lit("")).alias("away_team"), F.col("issue")]


def run(events: DataFrame, index: DataFrame, index_issues: DataFrame, points: DataFrame, keepers: DataFrame, load_issues: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entry A from wanted events to (results, issues, summary). The summary has one row of counts."""
    resolved, unresolved = split_issues(resolve(events, index))
    results, issues, skipped = match_shots(resolved, points, keepers, load_issues=load_issues, **options)
    of_index = index_issues.select(F.lit("").alias("row_idx"), F.lit("").alias("penalty_id"), F.lit("").alias("home_team"), F.lit("").alias("away_team"), F.concat(F.lit("fixture_index:"), F.col("issue")).alias("issue"))
    all_issues = unresolved.select(*_issue()).union(issues).union(of_index).toDF(*ISSUE_COLUMNS)
    one = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    summary = one(events, "events").crossJoin(one(results, "resolved")).crossJoin(one(skipped, "skipped")).crossJoin(one(all_issues.where("row_idx <> ''"), "unresolved"))  # four single rows
    return results, all_issues, summary
