"""Scalar rules: micro-fixtures F13, F14, F16, F17, F20, F23."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.functions import numbers, points, text, times, vector


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


NAMES = ["TSV Hannover-Burgdorf", "Füchse Berlin", "Größe", "Frisch Auf! Göppingen", "öl", "É Ø å", "  a--b  ", None, "", "___", "ſ Ǆ"]


def test_canonical_names(spark):
    got = one(spark, NAMES[:10], text.canonical_name)
    assert got == ["tsv_hannover_burgdorf", "fuechse_berlin", "groesse", "frisch_auf_goeppingen", "ol", "e_a", "a_b", "", "", ""]


def test_fixture_names(spark):
    names = ["TSV_vs_Füchse_Berlin_2_phases_positions.csv", "a_b_2_phases_positions.csv", "_vs_x_2_phases_positions.csv", "x_vs_y_vs_z_2_phases_positions.csv", "other.csv"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    h, a, i = text.fixture_sides("f")
    rows = [tuple(r) for r in df.select(h, a, i).collect()]
    assert rows[0] == ("tsv", "fuechse_berlin", None) and rows[3] == ("x", "y_vs_z", None)
    assert [r[2] for r in rows[1:3] + rows[4:]] == [f"invalid_fixture_filename:{names[1]}", f"invalid_fixture_parts:{names[2]}", f"invalid_fixture_filename:{names[4]}"]


def test_run_and_bone_names(spark):
    assert one(spark, ["run_3", "run_12__01_02_2024_10_00", "run_x", "run_4_", None], text.run_number) == [3, 12, None, None, None]
    assert one(spark, ["mixamorig:Left Arm", "a:b:C-1", "tail:", " Hips "], text.bone_key) == ["leftarm", "c1", "tail", "hips"]
    assert text.marker_stems(["b X", "b Y", "a Z", "Frame", "cX"]) == ["a", "b"]
    df = spark.createDataFrame([(" ", None, "z"), ("s", "m", "z"), (None, " m ", None), (None, None, None)], "a string, b string, c string")
    assert [r[0] for r in df.select(text.first_filled("a", "b", "c")).collect()] == ["z", "s", "m", "unknown"]


def test_numbers(spark):
    raw = ["1,5", '"2.5"', "1,234.5", "1.0d", "nan", "inf", "", " ", None, "-.5", "1e3", "1_000", "+7", "0x1"]
    assert one(spark, raw, numbers.to_double) == [1.5, 2.5, None, None, None, None, None, None, None, -0.5, 1000.0, 1000.0, 7.0, None]
    assert math.isnan(one(spark, ["nan"], lambda c: numbers.to_double(c, special=True))[0])
    assert one(spark, ["-3,9", "2.99", "1e30", "nan"], numbers.to_long) == [-3, 2, None, None]
    assert one(spark, ["1,234,567", "12.9", "x"], numbers.thousands_to_long) == [1234567, 12, None]
    assert one(spark, [0.5, None, float("nan")], numbers.six_decimals, "double") == ["0.500000", "", ""]
    assert one(spark, [90.0, -20.0, 10.0], lambda c: numbers.muscle(c, -40, 80), "double") == [1.0, -0.5, 0.125]


def test_times(spark):
    t = dt.datetime
    raw = ["2/3/2024, 1:02:03 PM", "02/03/2024, 12:00:00.5 am", "3.2.2024, 13:02:03", "03.02.2024, 13:02:03.123456", '"31.3.2024, 02:30:00"', "31.2.2024, 10:00:00", "2/3/2024, 13:00:00 PM", "x", None]
    want = [t(2024, 2, 3, 13, 2, 3), t(2024, 2, 3, 0, 0, 0, 500000), t(2024, 2, 3, 13, 2, 3), t(2024, 2, 3, 13, 2, 3, 123456), t(2024, 3, 31, 2, 30), None, None, None, None]
    assert one(spark, raw, times.track_time) == want
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:  # the gap hour of a zone must not move a time
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert one(spark, raw, times.track_time) == want
        assert one(spark, ["2024-03-31 02:30:00.25"], lambda c: times.iso_millis(times.event_time(c))) == ["2024-03-31T02:30:00.250"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert one(spark, ["2024-01-02 03:04:05", "2024-01-02 03:04:05.1", " 2024-1-2 3:4:5 ", "2024-01-02", "2024-01-02 03:04:60"], times.event_time) == [t(2024, 1, 2, 3, 4, 5), t(2024, 1, 2, 3, 4, 5, 100000), t(2024, 1, 2, 3, 4, 5), None, None]
    assert one(spark, [t(1970, 1, 1, 0, 0, 1, 5)], times.micros, "timestamp_ntz") == [1_000_005]
    assert one(spark, [t(2024, 1, 1, 0, 0, 0, 999900)], times.iso_millis, "timestamp_ntz") == ["2024-01-01T00:00:00.999"]
    assert one(spark, [t(2024, 1, 1)], lambda c: times.shifted(c, -1.5), "timestamp_ntz") == [t(2023, 12, 31, 23, 59, 58, 500000)]


def test_json_cells(spark):
    good = '[{"t_local":"a","ts_ms":1,"x":1.5,"y":null,"z":0.0,"v":null,"a":2.0,"dir":null}]'
    got = one(spark, [good, '"' + good.replace('"', '""') + '"', "[broken", "", None, "{}"], points.parse_series)
    assert [len(g) for g in got] == [1, 1, 0, 0, 0, 0] and got[1][0].x == 1.5
    assert one(spark, ['{"x":2.0}', "[1]", "x", None], points.parse_point)[1:] == [None] * 3
    frame = spark.createDataFrame([([0.0] * 4 + [1.0, 2.0, 3.0, 4.0], None), (None, [[9.0] * 4, [5.0, 6.0, 7.0, 8.0]]), ([1.0], [[1.0] * 4])], "rotations_flat array<double>, rotations array<array<double>>")
    rows = frame.select(points.frame_rotation({"rotations_flat": F.col("rotations_flat"), "rotations": F.col("rotations")}, F.lit(1))).collect()
    assert [r[0] for r in rows] == [[1, 2, 3, 4], [5, 6, 7, 8], None]


def quaternion_matrix(q):
    x, y, z, w = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def random_quats(n, seed=0):
    q = np.random.default_rng(seed).normal(size=(n, 4))
    return q / np.linalg.norm(q, axis=1, keepdims=True)


def test_rotations_between_directions(spark):
    r = np.random.default_rng(3)
    pairs = [(r.normal(size=3), r.normal(size=3)) for _ in range(40)]
    pairs += [(np.array([0, 0, 2.0]), np.array([0, 0, 5.0])), (np.array([0, 1.0, 0]), np.array([0, -2.0, 0])), (np.array([3.0, 0, 0]), np.array([-1.0, 0, 0])), (np.array([1.0, 0, 0]), np.array([0, 1.0, 0]))]
    df = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in pairs], "a double, b double, c double, d double, e double, f double")
    q = vector.between(vector.vec(F.col("a"), F.col("b"), F.col("c")), vector.vec(F.col("d"), F.col("e"), F.col("f")))
    for (a, b), row in zip(pairs, df.select(q.alias("q")).collect()):
        m = quaternion_matrix(row.q)
        assert np.allclose(m @ (a / np.linalg.norm(a)), b / np.linalg.norm(b), atol=1e-6)
        assert np.isclose(sum(v * v for v in row.q), 1)


def test_euler_slerp_and_frames(spark):
    q, p = random_quats(60), random_quats(60, 1)
    df = spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(q, p))], "i int, x double, y double, z double, w double, x2 double, y2 double, z2 double, w2 double").repartition(1).sortWithinPartitions("i")
    a, b = vector.quat(*(F.col(c) for c in ("x", "y", "z", "w"))), vector.quat(*(F.col(c) for c in ("x2", "y2", "z2", "w2")))
    rows = df.select(vector.euler_zxy(a).alias("e"), vector.slerp(a, b, F.lit(0.25)).alias("s"), vector.q_mul(a, b).alias("m"), vector.rotate(a, vector.vec(1, 2, 3)).alias("r"), vector.q_flip_y(a).alias("f")).collect()
    flip = np.diag([1.0, -1.0, 1.0])
    for u, v, row in zip(q, p, rows):
        z, x, y = (math.radians(row.e[k]) for k in ("z", "x", "y"))
        turn = lambda t, i: quaternion_matrix([*(math.sin(t / 2) * (k == i) for k in range(3)), math.cos(t / 2)])
        assert np.allclose(turn(z, 2) @ turn(x, 0) @ turn(y, 1), quaternion_matrix(u), atol=1e-6)
        assert np.allclose(quaternion_matrix(row.m), quaternion_matrix(u) @ quaternion_matrix(v), atol=1e-9)
        assert np.allclose([row.r.x, row.r.y, row.r.z], quaternion_matrix(u) @ [1, 2, 3], atol=1e-9)
        assert np.allclose(quaternion_matrix(row.f), flip @ quaternion_matrix(u) @ flip, atol=1e-9)
        d = abs(float(u @ v))
        assert math.isclose(abs(float(np.array(row.s) @ u)), math.cos(0.25 * math.acos(min(1, d))), abs_tol=1e-6)


def test_frames_of_two_vectors(spark):
    r = np.random.default_rng(8)
    q = random_quats(50, 4)
    q[0], q[1], q[2] = [1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]
    a, b = r.normal(size=(50, 3)), r.normal(size=(50, 3))
    rows = [(i, *map(float, a[i]), *map(float, b[i]), *map(float, quaternion_matrix(q[i]) @ a[i]), *map(float, quaternion_matrix(q[i]) @ b[i])) for i in range(50)]
    names = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} double" for n in names)).repartition(1).sortWithinPartitions("i")
    v = [vector.vec(*(F.col(c) for c in names[k : k + 3])) for k in (0, 3, 6, 9)]
    for i, row in enumerate(df.select(vector.two_vector_fit(*v).alias("q")).collect()):
        assert np.allclose(quaternion_matrix(row.q), quaternion_matrix(q[i]), atol=1e-5)


@pytest.mark.parametrize("x,want", [(0.0, -1.0), (5.0, 1.0)])
def test_clip(spark, x, want):
    assert one(spark, [x - 2], lambda c: numbers.clip(c, -1, 1), "double") == [want]
