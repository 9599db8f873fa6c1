"""Entry A against a plain restatement of its rules, on random recordings and on micro-fixtures F1-F12."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import DataFrame

from strideframe.operators import fixtures
from strideframe.plans import seven_metre, shots

T0 = dt.datetime(2024, 3, 1, 18, 0, 0)
EVENT = "id string, home_team string, away_team string, timestamp_local_timezone string, distance string, success string, game_clock string, player_id string, player_name string, name string, row_idx long, fixture_file string"
POINT = "fixture_file string, file_ord long, local_dt timestamp_ntz, ts_ms long, x double, y double, z double, speed double, accel double, direction double"
KEEPER = "fixture_file string, file_ord long, local_dt timestamp_ntz, ts_ms long, x double, y double, z double, sensor_id string"


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


def text(ms):
    return at(ms).strftime("%Y-%m-%d %H:%M:%S.%f")


# The rules in plain loops


def release_of(pts):
    side = 20.0 if pts[0]["x"] > 0 else -20.0
    def zone(p):
        return 6.5 <= math.hypot(p["x"] - side, p["y"]) <= 7.5
    for name, rows, key in (("max_a", [p for p in pts if p["accel"] is not None and zone(p)], "accel"), ("max_a_fallback_global", [p for p in pts if p["accel"] is not None], "accel"), ("max_v_fallback", [p for p in pts if p["speed"] is not None], "speed")):
        if rows:
            top = max(p[key] for p in rows)
            return next(p for p in rows if p[key] == top), name
    return pts[0], "first_point_fallback"


def keeper_of(cands, traj):
    side = -1 if sum(p["x"] for p in traj) / len(traj) < 0 else 1
    lo, hi = traj[0]["t"], traj[-1]["t"]
    by = {}
    for c in sorted(cands, key=lambda c: (c["sensor"], c["t"], c["ts"])):
        if (c["x"] > 0) == (side > 0) and lo <= c["t"] <= hi:
            by.setdefault(c["sensor"], []).append(c)
    best = None
    for s in sorted(by):
        own = by[s]
        score = (len(own), sum(abs(c["x"]) for c in own) / len(own), -sum(abs(c["y"]) for c in own) / len(own))
        if best is None or score > best[0]:
            best = score, s, own
    if best is None:
        return "", []
    out = []
    for p in traj:
        own, i = best[2], 0
        while i + 1 < len(own) and own[i + 1]["t"] <= p["t"]:
            i += 1
        if i + 1 < len(own) and abs(own[i + 1]["t"] - p["t"]) < abs(p["t"] - own[i]["t"]):
            i += 1
        out.append((p["t"], own[i]["x"], own[i]["y"]))
    return best[1], out


def process(ev, pts, cands, unsuccessful=False, extend=0):
    """('issue', text), ('skipped', n) or a dict."""
    if not pts:
        return "issue", "no_ball_points"
    if ev["t"] is None:
        return "issue", "invalid_shot_local_time"
    first = lambda t: next((i for i, p in enumerate(pts) if p["t"] >= t), None)
    last = lambda t: next((i for i in reversed(range(len(pts))) if pts[i]["t"] <= t), None)
    s = first(ev["t"])
    if s is None:
        return "issue", "shot_start_after_last_ball_point"
    d, flags = ev["d"], []
    if d is None:
        flags.append("distance_check:missing_distance")
    elif d < 6.95:
        near = [i for i, p in enumerate(pts) if pts[s]["t"] - 3000 <= p["t"] <= pts[s]["t"] and p["accel"] is not None]
        if near:
            top = max(pts[i]["accel"] for i in near)
            r = max(i for i in near if abs(pts[i]["accel"] - top) <= 1e-6)
            while r > 0 and pts[r]["accel"] is not None and pts[r - 1]["accel"] is not None and pts[r - 1]["accel"] >= pts[r]["accel"]:
                r -= 1
            s = first(pts[r]["t"] - 1000)
            flags.append("short_distance_correction:applied")
        else:
            flags.append("short_distance_correction:no_release_detected")
    elif d > 8:
        g = next((i for i in range(s, len(pts)) if 12 <= abs(pts[i]["x"]) <= 14), None)
        flags.append("long_distance_correction:" + ("applied" if g is not None else "no_x_gate_match"))
        s = s if g is None else g
    else:
        flags.append("distance_check:in_range")
    e = next((i for i in range(s, len(pts)) if abs(pts[i]["x"]) > 20), None)
    if e is None:
        if not (unsuccessful and not ev["ok"]):
            return "issue", "no_goalline_crossing_found"
        e = len(pts) - 1
        flags.append("unsuccessful:using_last_point")
    later = [p["x"] for p in pts[s + 1 :]]
    straight = not (any(x < pts[s]["x"] for x in later) and any(x > pts[s]["x"] for x in later))
    lo, hi = first(pts[s]["t"] - extend), last(pts[e]["t"] + 300)
    if d is not None and 6.5 <= d <= 7.5 and straight:
        rel = pts[s]
        flags.append("release_point:start_timestamp_plausible")
    else:
        rel, name = release_of(pts[lo : hi + 1])
        flags.append("release_point:" + name)
        por = math.hypot(rel["x"] - (20.0 if rel["x"] > 0 else -20.0), rel["y"])
        if por < 6.5 and rel["speed"] is not None and rel["speed"] > 0:
            need = (7.5 - por) / rel["speed"]
            if 0 < need < 5:
                target = rel["t"] - round((need + 0.1) * 1e6) / 1000
                n = first(target)
                if target < pts[lo]["t"] and n < lo:
                    lo = n
                    rel, _ = release_of(pts[lo : hi + 1])
                    flags.append("release_point:dynamic_extended")
    k = min(5, lo)
    traj = pts[lo - k : hi + 1]
    if k:
        flags.append(f"ball_prepend_frames:{k}")
    sensor, aligned = keeper_of(cands, traj)
    flags += [f"goalkeeper_points:{len(aligned)}"] + (["goalkeeper_aligned_with_ball:1"] if aligned else [])
    if len(traj) >= 60:
        return "skipped", len(traj)
    top = lambda key: max((p[key] for p in traj if p[key] is not None), default=None)
    return "result", {"flags": ";".join(flags), "n": len(traj), "start": traj[0]["t"], "end": traj[-1]["t"], "release": rel["t"], "rx": rel["x"], "sensor": sensor, "keeper": aligned, "v": top("speed"), "a": top("accel")}


def recording(r, n):
    """A ball that wanders and is shot now and then; times may repeat, values may be missing."""
    pts, x, t = [], r.uniform(-10, 10), 0
    for i in range(n):
        t += r.choice([0, 50, 50, 50, 50, 100])
        x = r.choice([x + r.uniform(-3, 3)] * 8 + [12.5, 13.5, -13.0, 20.0, 20.4, -20.6])
        x = max(-22.0, min(22.0, x))
        pts.append({"t": t, "ts": t if r.random() < 0.95 else None, "x": round(x, 3), "y": round(r.uniform(-4, 4), 3), "z": 1.0, "speed": r.choice([None, 0.0, 1.5, 9.0, 15.0]), "accel": r.choice([None, 1.0, 2.0, 2.0, 5.0]), "direction": r.choice([None, 10.0])})
    return sorted(pts, key=lambda p: (p["t"], -1 if p["ts"] is None else p["ts"]))


def keepers(r, span):
    return [{"sensor": r.choice(["s1", "s2", "s3"]), "t": r.randrange(0, span, 25), "ts": i, "x": r.choice([-1, 1]) * r.uniform(16, 20), "y": r.uniform(-1.5, 1.5)} for i in range(span // 20)]


def tables(spark, events, recs, cands):
    ev = [(str(i), "h", "a", None if e["t"] is None else text(e["t"]), e["raw"], "1" if e["ok"] else "0", "", "p", "", "N", i, e["f"]) for i, e in enumerate(events)]
    pts = [(f, i, at(p["t"]), p["ts"], p["x"], p["y"], p["z"], p["speed"], p["accel"], p["direction"]) for f, ps in recs.items() for i, p in enumerate(ps)]
    kps = [(f, i, at(k["t"]), k["ts"], k["x"], k["y"], 1.0, k["sensor"]) for f, ks in cands.items() for i, k in enumerate(ks)]
    return spark.createDataFrame(ev, EVENT), spark.createDataFrame(pts, POINT), spark.createDataFrame(kps, KEEPER)


@pytest.mark.parametrize("seed,unsuccessful,extend", [(1, False, 0), (2, True, 250)])
def test_random_recordings(spark, seed, unsuccessful, extend):
    r = random.Random(seed)
    recs = {f"f{i}": recording(r, r.choice([3, 40, 90, 160])) for i in range(8)}
    cands = {f: keepers(r, max(p["t"] for p in ps) + 50) for f, ps in recs.items()}
    events = []
    for i in range(140):
        f = r.choice([*recs, "none"])
        raw = r.choice(["", "x", "6,94", "6.95", "7.0", "7.2", "6.5", "8", "8.01", "5.5", "9"])
        d = None if raw in ("", "x") else float(raw.replace(",", "."))
        events.append({"f": f, "raw": raw, "d": d, "ok": r.random() < 0.6, "t": r.choice([None] + [r.randrange(-500, 9000, 10)] * 9)})
    ev, pts, kps = tables(spark, events, recs, cands)
    got, issues, skipped = shots.match_shots(ev, pts, kps, include_unsuccessful=unsuccessful, extend_start_ms=extend, keep=DataFrame.cache)
    got, issues, skipped = {x.event_no: x for x in got.collect()}, {int(x.row_idx): x.issue for x in issues.collect()}, {x.event_no: x.points for x in skipped.collect()}
    kinds = set()
    for i, e in enumerate(events):
        kind, want = process(e, recs.get(e["f"], []), cands.get(e["f"], []), unsuccessful, extend)
        kinds.add(kind)
        if kind == "issue":
            assert issues[i] == want, (i, e)
        elif kind == "skipped":
            assert skipped[i] == want
        else:
            x = got[i]
            assert x.flags == want["flags"], (i, e)
            iso = lambda ms: at(ms).isoformat(timespec="milliseconds")
            assert (x.start_time_local, x.end_time_local, x.release_time_local) == (iso(want["start"]), iso(want["end"]), iso(want["release"]))
            assert json.loads(x.release_point_json)["x"] == want["rx"] and len(json.loads(x.trajectory_json)) == want["n"] == int(x.trajectory_point_count)
            assert x.goalkeeper_sensor_id == want["sensor"]
            assert [(p["t_local"], p["x"], p["y"]) for p in json.loads(x.goalkeeper_trajectory_json)] == [(iso(t), a, b) for t, a, b in want["keeper"]]
            assert x.max_v == ("" if want["v"] is None else f"{want['v']:.6f}") and x.max_a == ("" if want["a"] is None else f"{want['a']:.6f}")
    assert len(got) + len(issues) + len(skipped) == len(events) and "result" in kinds and "issue" in kinds


def test_point_limit_and_prepend(spark):
    """59 points pass, 60 don't; starts near the file's begin have fewer points in front."""
    line = lambda n: [{"t": 50 * i, "ts": i, "x": 10.0 if i < n - 1 else 20.5, "y": 0.0, "z": 0.0, "speed": 1.0, "accel": None, "direction": None} for i in range(n)]
    recs = {"a": line(59), "b": line(60), "c": line(20)}
    events = [{"f": "a", "raw": "7", "ok": True, "t": 0}, {"f": "b", "raw": "7", "ok": True, "t": 0}] + [{"f": "c", "raw": "7", "ok": True, "t": 50 * i} for i in range(8)]
    ev, pts, kps = tables(spark, events, recs, {})
    got, issues, skipped = shots.match_shots(ev, pts, kps, keep=DataFrame.cache)
    got = {x.event_no: x for x in got.collect()}
    assert got[0].trajectory_point_count == "59" and [x.event_no for x in skipped.collect()] == [1] and issues.count() == 0
    for i in range(8):
        want = min(5, i)
        assert (f"ball_prepend_frames:{want}" in got[2 + i].flags) == (want > 0) and int(got[2 + i].trajectory_point_count) == 20 - i + want


def test_run_with_fixture_issues(spark):
    files = spark.createDataFrame([(f"{n}_2_phases_positions.csv",) for n in ("A_vs_B", "Füchse_vs_C", "X_vs_Y", "x_vs_y", "bad", "HBW_Balingen-Weilstetten_vs_T_old")], "file_name string")
    index, bad = fixtures.fixture_index(files)
    assert [r.issue for r in bad.collect()] == ["invalid_fixture_filename:bad_2_phases_positions.csv"]
    rows = [("1", "A", "B"), ("2", "Fuechse", "c"), ("3", "X", "Y"), ("4", "Q", "Z"), ("5", "HBW Balingen-Weilstetten", "ThSV Eisenach")]
    ev = spark.createDataFrame([(i, h, a, text(0), "7", "1", "", "p", "", "n", k, None) for k, (i, h, a) in enumerate(rows)], EVENT).drop("fixture_file")
    got = {r.id: (r.fixture_file, r.issue) for r in fixtures.resolve(ev, index).collect()}
    assert got == {
        "1": ("A_vs_B_2_phases_positions.csv", None), "2": ("Füchse_vs_C_2_phases_positions.csv", None), "3": (None, "fixture_not_unique:X_vs_Y_2_phases_positions.csv|x_vs_y_2_phases_positions.csv"),
        "4": (None, "no_fixture_match"), "5": ("HBW_Balingen-Weilstetten_vs_T_old_2_phases_positions.csv", None),
    }
    pts, kps = spark.createDataFrame([], POINT), spark.createDataFrame([], KEEPER)
    results, issues, summary = shots.run(ev, index, bad, pts, kps, keep=DataFrame.cache)
    assert results.count() == 0
    assert sorted(r.issue.split(":")[0] for r in issues.collect()) == ["fixture_index", "fixture_not_unique", "no_ball_points", "no_ball_points", "no_ball_points", "no_fixture_match"]
    assert tuple(summary.first()) == (5, 0, 0, 5)


def test_wanted_events(spark):
    df = spark.createDataFrame([("1", "1", "12:00"), ("2", "0", "12:00"), (" 3 ", " 1 ", None), ("4", "1", " 30:00"), ("5", "1", "60:00")], "id string, success string, game_clock string")
    ids = lambda d: sorted(r.id.strip() for r in d.collect())
    assert ids(shots.wanted_events(df)) == ["1", "3"] and ids(shots.wanted_events(df, include_unsuccessful=True)) == ["1", "2", "3"] and ids(shots.wanted_events(df, "3")) == ["3"]
    n = spark.range(50).withColumnRenamed("id", "row_idx")
    assert [r[0] for r in shots.first_or_sample(n, limit=3).collect()] == [0, 1, 2] and shots.first_or_sample(n, limit=3, sample=10).distinct().count() == 10


def test_detector(spark):
    s = spark.createDataFrame([("a", "p", "t", "penalty", 10_000, "1", 7.0, 20.0, 7.0, 0.0), ("b", "p", "t", "field", 10_000, "1", 7.0, 20.0, 7.0, 0.0), ("c", "p", "t", "penalty", 90_000, "1", 7.0, 21.0, 7.0, 0.0)], "id string, player_id string, shot_type string, shot_category string, ts_ms long, success string, distance double, speed_ball double, shot_position_x double, shot_position_y double")
    ball = spark.createDataFrame([(7_000, 1.0, 0.0, 0.0, 5.0, 1.0, 10.0), (9_990, 2.0, 0.0, 0.0, 13.0, 1.0, 20.0), (10_001, 3.0, 0.0, 0.0, 11.0, 9.0, 30.0), (13_000, None, 0.0, 0.0, 99.0, 9.0, 30.0), (13_001, 4.0, 0.0, 0.0, 99.0, 9.0, 30.0)], "ts_ms long, x double, y double, z double, speed double, accel double, direction double")
    d = {r.id: r for r in seven_metre.strict_rule(seven_metre.detected(seven_metre.shot_tracks(s, ball))).collect()}
    assert set(d) == {"a", "b"} and d["a"].num_points == 3 and d["a"].max_speed == 13.0 and d["a"].flight_ms == 3001 and d["a"].release.x == 2.0
    assert d["a"].is_7m_penalty and not d["b"].is_7m_penalty and d["a"].is_straight and not d["a"].is_7m_strict and d["a"].angle_spread == pytest.approx(10.0)
    full = {r.id: r for r in seven_metre.analysed(s, ball).collect()}
    assert set(full) == {"a", "c"} and full["c"].max_speed == 21.0 and not full["c"].is_7m_penalty
