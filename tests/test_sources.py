"""Files in and out: micro-fixtures F7, F15, F21; streams."""

import pytest
from pyspark.sql import functions as F

from strideframe.operators import fixtures
from strideframe.plans import shots
from strideframe.schemas import RESULT_COLUMNS
from strideframe.sources import sinks, tables
from strideframe.streaming import windows

BALL = "formatted local time;group name;x in m;y in m;z in m;speed in m/s;acceleration in m/s2;direction of movement in deg;ts in ms;sensor id;full name"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("positions")
    rows = ["1.3.2024, 18:00:00.100; Ball ;1,5;0;1;10;2;5;100;;Ball 1", "1.3.2024, 18:00:00.050;Ball;1.0;0;1;;;;50;;", "1.3.2024, 18:00:00.050;Ball;1.1;0;1;9;1;;50;;", "x;Ball;1;0;1;1;1;1;1;;", "1.3.2024, 18:00:00;Ball;;0;1;1;1;1;1;;", "1.3.2024, 18:00:00.200;Home;-17;1,5;0;;;;200;;Keeper K", "1.3.2024, 18:00:00.200;;15.9;0;0;;;;200;7;"]
    (d / "A_vs_B_2_phases_positions.csv").write_text("\n".join([BALL, *rows]) + "\n")
    swapped = BALL.replace("x in m;y in m", "y in m;x in m")
    (d / "C_vs_D_2_phases_positions.csv").write_text(swapped + "\n3/1/2024, 6:00:00.5 PM;Ball;9;8;7;1;1;1;;;\n")
    (d / "E_vs_F_2_phases_positions.csv").write_text("formatted local time;group name\n1;Ball\n")
    (d / "notes.txt").write_text("not a position file")
    return d


def test_positions_by_name(spark, folder):
    raw, issues = tables.positions(spark, str(folder))
    assert [r.fixture_file for r in issues.collect()] == ["E_vs_F_2_phases_positions.csv"] and issues.first().issue.startswith("positions_load_error:")
    ball = tables.ball_points(raw).orderBy("fixture_file", "local_dt", F.coalesce("ts_ms", F.lit(-1)), "file_ord").collect()
    assert [(r.x, r.y) for r in ball] == [(1.0, 0.0), (1.1, 0.0), (1.5, 0.0), (8.0, 9.0)] and ball[0].speed is None and ball[3].ts_ms is None
    keep = tables.keeper_candidates(raw).collect()
    assert [(r.sensor_id, r.x, r.y) for r in keep] == [("Keeper K", -17.0, 1.5)]
    assert [r.file_name for r in tables.files(spark, str(folder)).collect()] == [f"{n}_2_phases_positions.csv" for n in ("A_vs_B", "C_vs_D", "E_vs_F")]


def test_events_and_results(spark, folder, tmp_path):
    (tmp_path / "penalties.csv").write_text('id;home_team;away_team;timestamp_local_timezone;distance;success;game_clock;name\n1;A;B;2024-03-01 18:00:00.00;7;1;12:00;"N ""x"" N"\n2;C;D;bad;7;1;12:00;M\n3;E;F;2024-03-01 18:00:00;7;1;13:00;O\n')
    ev = shots.wanted_events(tables.events(spark, str(tmp_path / "penalties.csv")))
    assert ev.count() == 3 and ev.where("player_name is not null").count() == 0
    index, bad = fixtures.fixture_index(tables.files(spark, str(folder)))
    raw, load = tables.positions(spark, str(folder))
    results, issues, summary = shots.run(ev, index, bad, tables.ball_points(raw), tables.keeper_candidates(raw), load, include_unsuccessful=True, keep=lambda df: df.cache())
    got = {r.penalty_id: r.issue.split(":")[0] for r in issues.collect()}
    assert got == {"1": "no_goalline_crossing_found", "2": "invalid_shot_local_time", "3": "positions_load_error"} and tuple(summary.first()) == (3, 0, 0, 3)
    base = str(tmp_path / "runs")
    first = sinks.run_folder(spark, base)
    assert "/run_1__" in first
    sinks.write_issues(issues, first + "/issues")
    sinks.write_results(results, first + "/results")
    assert "/run_2__" in sinks.run_folder(spark, base)
    back = spark.read.csv(first + "/issues", sep=";", header=True)
    assert back.columns == ["row_idx", "penalty_id", "home_team", "away_team", "issue"] and back.count() == 3
    assert sinks.run_summary(spark, {"b": "2", "a": "1"}).first().artifact == "a"


def test_shot_profile(spark, tmp_path):
    (tmp_path / "shots.csv").write_text("id;player_id;shot_category;timestamp_ms;distance\n1;p;penalty;1,234,567;7,1\n")
    row = tables.shots(spark, str(tmp_path / "shots.csv")).first()
    assert (row.ts_ms, row.distance, row.speed_ball) == (1234567, 7.1, None)


TSV = ["FREQUENCY\t300", "MARKER_NAMES\tA\tB", "Frame\tTime\tA X\tA Y\tA Z\tB X\tB Y\tB Z\tUnnamed", "1\t0.0\t1000\t2000\t3000\t\t5\t6\tx", "2\t0.1\t1\t2\t3\tnan\t5\t6", "3\t0.2\t1\t2", "junk"]


def test_markers(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("\r\n".join(TSV))
    (tmp_path / "b.tsv").write_text("no header here\n1\t2\n")
    pts, meta, rejects = tables.markers(spark, str(tmp_path), axes="xzy")
    rows = sorted((r.clip_id, r.frame, r.marker, r.x, r.y, r.z) for r in pts.collect())
    assert rows == [("a.tsv", 1, "A", 1.0, 3.0, 2.0), ("a.tsv", 2, "A", 0.001, 0.003, 0.002)]
    assert meta.first().frequency == 300.0 and list(meta.first().marker_names) == ["A", "B"] and rejects.collect()[0].issue == "no_header"
    filled, _, _ = tables.markers(spark, str(tmp_path / "a.tsv"), zero_fill=True)
    assert filled.count() == 6
    none, _, lacking = tables.markers(spark, str(tmp_path / "a.tsv"), required=["A", "Q"])
    assert none.count() == 0 and lacking.first().issue == "missing_markers:Q"
    wide = spark.createDataFrame([(1, 1.0, 2.0, 3.0, None, 1.0, 1.0)], "Frame int, `A X` double, `A Y` double, `A Z` double, `B X` double, `B Y` double, `B Z` double")
    assert [(r.marker, r.z) for r in tables.unpivoted(wide, ["Frame"]).collect()] == [("A", 3.0)]
    assert tables.column_times(spark, str(tmp_path / "b.tsv"), "\t").first().time == "2"


def test_arrays(spark, tmp_path):
    import numpy as np

    from strideframe.sources.arrays import array_points

    a = np.arange(24, dtype=np.float32).reshape(2, 4, 3)
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "flat.npy", a.ravel())
    np.save(tmp_path / "objects.npy", np.array([{"x": 1}], dtype=object))
    rows = array_points(spark, str(tmp_path)).collect()
    assert {r.clip_id for r in rows} == {"a.npy"} and all(r.value == a[r.frame, r.joint, r.axis] for r in rows) and len(rows) == 24


def test_court(spark):
    from strideframe.functions import court

    row = spark.range(1).select(court.arc(F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(0.0), F.lit(90.0), 2).alias("a"), court.dashes(F.lit(1.0), 0.15, 0.2).alias("d")).first()
    assert [(round(p.x, 6), round(p.y, 6)) for p in row.a] == [(2.0, 1.0), (1.414214, 2.414214), (0.0, 3.0)]
    assert [(round(d.begin, 2), round(d.end, 2)) for d in row.d] == [(0.0, 0.15), (0.35, 0.5), (0.7, 0.85)]


def test_streams(spark, tmp_path, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    src = str(tmp_path / "src")
    ev.select("event_id", "ts", "user_id", "event_type", "value").repartition(2).write.parquet(src)
    stream = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double").parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))
    q = windows.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    want = {(r.start, r.event_type): r.n for r in windows.tumbling(ev.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    assert {(r.start, r.event_type): r.n for r in spark.table("hours").collect()} == want


def test_results_are_written_by_file_and_event(spark, tmp_path):
    rows = [(7, "b", "p7"), (1, "c", "p1"), (3, "b", "p3"), (2, "a", "p2"), (9, "c", "p9"), (4, None, "p4")]
    df = spark.createDataFrame(rows, "event_no long, fixture_file string, id string")
    want = ["p1", "p9", "p2", "p3", "p7", "p4"]
    assert [r.id for r in shots.in_file_order(df).collect()] == want
    for c in RESULT_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    sinks.write_results(df, str(tmp_path / "one"))
    (file,) = (tmp_path / "one").glob("*.csv")
    at = RESULT_COLUMNS.index("id")
    assert [line.split(";")[at].strip('"') for line in file.read_text().splitlines()[1:]] == want


def test_a_folder_without_events(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert tables.events(spark, str(tmp_path / "none")).collect() == []


def test_the_chosen_events(spark):
    df = spark.createDataFrame([("1", "a", "b"), ("2", "b", "a"), ("3", "a", None)], "id string, home_team string, away_team string")
    ids = lambda **k: sorted(r.id for r in shots.chosen(df, **k).collect())
    assert ids(home="a", away="b") == ["1"] and ids(event_id="3", home="a", away="b") == ["3"] and ids(home="a") == ["1", "2", "3"]


def test_two_runs_at_once_get_two_numbers(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    base = str(tmp_path / "runs")
    (tmp_path / "runs/run_4__01_01_2024_00_00").mkdir(parents=True)
    with ThreadPoolExecutor(6) as pool:
        found = list(pool.map(lambda _: sinks.run_folder(spark, base), range(6)))
    assert sorted(int(f.rsplit("/run_", 1)[1].split("__")[0]) for f in found) == list(range(5, 11))


def test_documents_are_whole_or_not_there(spark, tmp_path):
    """Lines of many clips come in any order; a job that dies half way leaves no document."""
    lines = spark.range(0, 4000, 1, 8).select(F.concat(F.lit("c "), F.col("id") % 7).alias("clip_id"), (-F.col("id")).alias("at"), F.col("id").cast("string").alias("line"))
    sinks.write_documents(lines, str(tmp_path / "good"))
    files = sorted((tmp_path / "good").glob("clip_id=*/part-*"))
    assert len(files) == 7
    for k, f in enumerate(files):
        assert f.read_text().split() == [str(i) for i in range(3999, -1, -1) if i % 7 == k]
    assert {r.file_name for r in tables.lines(spark, str(tmp_path / "good")).select("file_name").distinct().collect()} == {f"c {k}" for k in range(7)}
    broken = lines.withColumn("line", F.when(F.col("at") == -3, F.raise_error(F.lit("dies")).cast("string")).otherwise(F.col("line")))
    with pytest.raises(Exception, match="dies"):
        sinks.write_documents(broken, str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").glob("clip_id=*/part-*")) and not (tmp_path / "bad/_SUCCESS").exists()


def test_array_files_are_written_whole_or_not_at_all(spark, tmp_path):
    import numpy as np

    from strideframe.sources import arrays

    rows = [(c, f, j, a, float(1000 * f + 10 * j + a)) for c, n in (("x y", 5), ("z", 1)) for f in range(n) for j in range(2) for a in range(3) if (f, j, a) != (3, 1, 2)]
    df = spark.createDataFrame(rows, "clip_id string, frame long, joint int, axis int, value double").repartition(4)
    arrays.write_arrays(df, str(tmp_path / "good"), 2)
    assert sorted(f.name for f in (tmp_path / "good").iterdir()) == ["x y.npy", "z.npy"]
    got = np.load(tmp_path / "good/x y.npy")
    assert got.shape == (5, 2, 3) and np.isnan(got[3, 1, 2]) and got[4, 1, 0] == 4010.0
    dies = df.withColumn("value", F.when(F.col("frame") == 3, F.raise_error(F.lit("dies")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="dies"):
        arrays.write_arrays(dies, str(tmp_path / "bad"), 2)
    assert not (tmp_path / "bad").exists() or not list((tmp_path / "bad").iterdir())


def test_animation_documents_in_lines_and_whole(spark, tmp_path):
    """Documents of lines and others give the same frames and issues; the check of a frame doesn't parse the document again."""
    import json

    from strideframe.sources import animations

    frame = lambda k, n=2: {"root_position": [k, 0.5, 0], "rotations_flat": [float(k + i) for i in range(4 * n)], "rotations": []}
    head = {"frame_rate": 25.0, "joint_names": ["A", "B"]}
    lined = lambda h, own: json.dumps(h)[:-1] + ', "frames": [\n' + "\n,".join(map(json.dumps, own)) + "\n]}\n"
    good = lined(head, [frame(k) for k in range(40)])
    texts = {
        "lined": good, "plain": json.dumps({**head, "frames": [frame(k) for k in range(3)]}), "pretty": json.dumps({**head, "frames": [frame(7)]}, indent=1), "two a line": good.replace("\n,", ",", 1),
        "no rate": lined({"joint_names": ["A"]}, [frame(1)]), "short": lined(head, [frame(0), frame(1, 1)]), "no joints": lined({"joint_names": []}, [frame(0)]), "none": lined(head, []), "cut": good[:-4], "broken": good.replace("[7.0,", "[7.0,,"),
        "no comma": good.replace("\n,", "\n", 1), "blank": good.replace("\n,", "\n\n,", 1), "odd": good.replace("[7.0,", '["x",'), "string": lined(head, [{**frame(0), "note": "}, {"}]), "empty": "",
    }
    for name, text in texts.items():
        (tmp_path / f"in/clip_id={name}").mkdir(parents=True)
        (tmp_path / f"in/clip_id={name}/part-0.txt").write_text(text)
    documents, rejects = animations.animations(spark, str(tmp_path / "in"))
    got = animations.clips(spark, str(tmp_path / "in"))
    rows = lambda df: sorted(map(repr, df.collect()))
    bad = rows(got.rejects)
    assert bad == rows(rejects) and all(any(f"'{c}'" in r for r in bad) for c in ("short", "no joints", "none", "cut", "broken"))
    assert rows(got.documents) == rows(documents.drop("frames")) and rows(animations.frame_rotations(got.frames)) == rows(animations.rotations(documents))
    lines = animations.text_lines(spark, str(tmp_path / "in"))
    assert {r.clip_id for r in animations._lined(animations.Blocks.of(lines).numbered(lines), 30.0).collect()} == {"lined", "no rate", "short", "no joints"}
    plan = documents._jdf.queryExecution().optimizedPlan().toString()
    assert all("from_json" not in part.split(" Project ")[0] for part in plan.split("lambdafunction(")[1:] if "rotations_flat" in part.split(",")[0])
