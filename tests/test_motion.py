"""Poses, markers, rigs and playback: micro-fixtures F18-F22 and the invariants of entry B and C."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.operators import markers, pose
from strideframe.plans import motion
from strideframe.sources import sinks

XYZ = "array<struct<x:double,y:double,z:double>>"


def clip(n=14, seed=0):
    """A standing figure of 17 joints that sways."""
    base = np.array([[0, 1, 0], [-0.1, 1, 0], [-0.1, 0.5, 0], [-0.1, 0, 0], [0.1, 1, 0], [0.1, 0.5, 0], [0.1, 0, 0], [0, 1.2, 0], [0, 1.4, 0], [0, 1.5, 0.05], [0, 1.65, 0], [0.2, 1.4, 0], [0.4, 1.4, 0], [0.6, 1.4, 0.1], [-0.2, 1.4, 0], [-0.4, 1.4, 0], [-0.6, 1.4, 0.1]])
    return base + np.cumsum(np.random.default_rng(seed).normal(scale=0.02, size=(n, 17, 3)), axis=0)


def frames(spark, clips):
    rows = [(name, f, [tuple(map(float, p)) for p in joints]) for name, c in clips.items() for f, joints in enumerate(c)]
    return spark.createDataFrame(rows, f"clip_id string, frame long, joints {XYZ}")


def arrays(df, column="joints"):
    out = {}
    for r in df.collect():
        out.setdefault(r.clip_id, {})[r.frame] = np.array([[p.x, p.y, p.z] for p in r[column]])
    return {k: np.stack([v[f] for f in sorted(v)]) for k, v in out.items()}


def test_postprocessing_invariants(spark):
    c = clip()
    c[0, 5] = c[0, 4]  # a bone without length in the first frame and in a later one
    c[6, 13] = c[6, 12]
    got = arrays(pose.to_frames(pose.constant_lengths(pose.to_long(frames(spark, {"a": c})))))["a"]
    for j, p in enumerate(pose.H36M_PARENTS):
        if p >= 0:
            own, want = np.linalg.norm(got[:, j] - got[:, p], axis=1), np.median(np.linalg.norm(c[:, j] - c[:, p], axis=1))
            assert own == pytest.approx(want, abs=1e-9)
    assert np.allclose(got[:, 0], c[:, 0])
    assert np.allclose(got[0, 5] - got[0, 4], [0, np.median(np.linalg.norm(c[:, 5] - c[:, 4], axis=1)), 0])
    assert np.allclose(np.cross(got[6, 13] - got[6, 12], c[5, 13] - c[5, 12]), 0, atol=1e-9)
    ready = arrays(pose.to_frames(motion.postprocessed(frames(spark, {"a": clip()}))))["a"]
    assert ready[:, [3, 6], 1].min() == pytest.approx(0, abs=1e-9)
    assert np.median(ready[:, :, 1].max(axis=1) - ready[:, :, 1].min(axis=1)) == pytest.approx(1.8)


def test_joint_maps(spark):
    k = np.random.default_rng(1).uniform(size=(17, 3))
    df = spark.createDataFrame([([tuple(map(float, p)) for p in k],)], "k array<struct<x:double,y:double,conf:double>>")
    h, p, q, n = df.select(pose.coco_to_h36m(F.col("k")), pose.coco_to_halpe(F.col("k")), pose.h36m_to_halpe(F.col("k")), pose.normalised(F.col("k"))).first()
    assert len(h) == 17 and len(p) == len(q) == 26 and h[1].x == k[12, 0] and h[16].conf == k[10, 2]
    assert p[18].x == pytest.approx((k[5, 0] + k[6, 0]) / 2) and p[20].x == k[15, 0] and q[0].x == k[10, 0] and q[19].x == pytest.approx((k[11, 0] + k[14, 0]) / 2)
    back = spark.createDataFrame([(n,)], "n struct<joints:array<struct<x:double,y:double>>,root_x:double,root_y:double,scale:double>").select(pose.denormalised(F.col("n"))).first()[0]
    assert [b.x for b in back] == pytest.approx(k[:, 0]) and [b.y for b in back] == pytest.approx(k[:, 1])
    face = spark.createDataFrame([([(120.0, 70.0, 1.0), (115.0, 68.0, 1.0), (125.0, 68.0, 1.0), (110.0, 70.0, 1.0), (130.0, 70.0, 1.0), (100.0, 100.0, 1.0), (140.0, 100.0, 1.0)] + [(0.0, 0.0, 0.0)] * 10,)], "k array<struct<x:double,y:double,conf:double>>").select(pose.coco_to_h36m(F.col("k"))).first()[0]
    assert (face[9].y, face[10].y) == pytest.approx((89.22, 69.76))
    edges = df.select(pose.visible_edges(F.col("k"), [(0, 1), (2, 3)], float(k[1, 2]))).first()[0]
    assert ((0, 1) in [(e.a, e.b) for e in edges]) == (k[0, 2] >= k[1, 2])
    assert df.select(pose.model_input(F.lit(3), F.lit("c"), F.col("k"))).first()[0].keypoints[:3] == pytest.approx(list(k[0]))


def matrix(q):
    x, y, z, w = (q[k] for k in "xyzw")
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def test_retargeting(spark):
    df = frames(spark, {"a": clip(12), "b": clip(3, 5)}).withColumn("joints", pose.with_hands(F.col("joints")))
    turned = pose.facing_forward(df)
    first = arrays(turned)["a"][0]
    lateral, up = 0.5 * (first[11] + first[4]) - 0.5 * (first[15] + first[1]), first[8] - first[0]
    ahead = np.cross(lateral, up)
    assert abs(ahead[0]) < 1e-9 and ahead[2] > 0
    out = pose.retargeted(turned)
    rows = out.where("clip_id = 'a'").collect()
    joints = arrays(turned)["a"]
    for r in rows:
        assert len(r.quats) == 19 and all(abs(sum(v * v for v in q) - 1) < 1e-6 for q in r.quats)
        world = []
        for i, q in enumerate(r.quats):
            p = pose.PARENTS[i]
            world.append(matrix(q) if p < 0 else world[p] @ matrix(q))
        rest = np.array([[o.x, o.y, o.z] for o in r.offsets])
        for i in range(19):
            kids = [j for j, p in enumerate(pose.PARENTS) if p == i]
            if len(kids) == 1:  # a single bone points where the pose has it
                d = joints[r.frame, kids[0]] - joints[r.frame, i]
                assert np.allclose(world[i] @ rest[kids[0]] / np.linalg.norm(rest[kids[0]]), d / np.linalg.norm(d), atol=1e-5)
            elif kids:  # several: no rotation fits better than the one found
                a = np.array([rest[k] / np.linalg.norm(rest[k]) for k in kids])
                b = np.array([(joints[r.frame, k] - joints[r.frame, i]) / np.linalg.norm(joints[r.frame, k] - joints[r.frame, i]) for k in kids])
                u, _, vt = np.linalg.svd(b.T @ a)
                m = u @ np.diag([1, 1, np.linalg.det(u @ vt)]) @ vt
                assert np.sum((a @ world[i].T - b) ** 2) <= np.sum((a @ m.T - b) ** 2) + 1e-6


def test_documents(spark, tmp_path):
    ready = motion.animate(frames(spark, {"a": clip(6)})).cache()
    assert min(r.root.y for r in ready.collect()) >= 0 and (ready.orderBy("frame").first().root.x, ready.orderBy("frame").first().root.z) == (0, 0)
    from strideframe.sources.animations import animations, roots, rotations

    sinks.write_documents(sinks.animation_lines(ready, list(pose.JOINTS)), str(tmp_path / "in"))
    (tmp_path / "in/clip_id=bad").mkdir()
    (tmp_path / "in/clip_id=bad/bad.json").write_text('{"joint_names":["A","B"],"frames":[{"root_position":[0,0,0],"rotations":[[0,0,0,1]]}]}')
    good, bad = animations(spark, str(tmp_path / "in"))
    assert [(r.clip_id, r.issue) for r in bad.collect()] == [("bad", "bad_frame")] and rotations(good).count() == 6 * 19 and roots(good).count() == 6
    off = [(0.0, 0.0, 0.0)] * 19
    sinks.write_documents(sinks.bvh_lines(ready, sinks.bvh_hierarchy(list(pose.JOINTS), list(pose.PARENTS), off), list(pose.PARENTS)), str(tmp_path / "bvh"))
    (file,) = (tmp_path / "bvh/clip_id=a").glob("part-*")
    text = file.read_text()
    lines = text.rstrip("\n").split("\n")
    assert lines[0] == "HIERARCHY" and "MOTION" in lines and text.count("End Site") == 5 and "Frames: 6" in lines
    assert all(len(x.split()) == 3 + 3 * 19 for x in lines[-6:]) and sinks.depth_first([-1, 0, 0, 1]) == [0, 1, 3, 2]
    from strideframe.sources.tables import bvh_motion

    got = bvh_motion(spark, str(tmp_path / "bvh")).orderBy("frame").collect()
    assert [r.frame for r in got] == list(range(6)) and len(got[0].channels) == 60


def marker_points(spark, n=11):
    r = np.random.default_rng(2)
    home = {m: r.uniform(-1, 1, size=3) for m in markers.REQUIRED}
    rows = [("c", f, m, *map(float, p + 0.01 * r.normal(size=3))) for f in range(n) for m, p in home.items()]
    return rows, spark.createDataFrame(rows, "clip_id string, frame long, marker string, x double, y double, z double")


def test_marker_solve_and_playback(spark):
    rows, df = marker_points(spark)
    found = {(r.frame, r.joint): np.array([r.x, r.y, r.z]) for r in markers.joints(df).collect()}
    at = {(f, m): np.array(p) for _, f, m, *p in rows}
    assert np.allclose(found[0, "LeftHand"], (at[0, "Q_LWristIn"] + at[0, "Q_LWristOut"]) / 2)
    head = sum(at[0, m] for m in markers.HEAD) / 3
    assert np.allclose(found[0, "Neck"], (at[0, "Q_Chest"] + head) / 2) and len(found) == 11 * 22
    gap = df.where("not (frame = 3 and marker = 'Q_LWristIn')")
    assert (3, "LeftHand") not in {(r.frame, r.joint) for r in markers.joints(gap).collect()}
    loose = {(r.frame, r.joint): np.array([r.x, r.y, r.z]) for r in markers.joints(gap, strict=False).collect()}
    assert np.allclose(loose[3, "LeftHand"], at[3, "Q_LWristOut"])
    solved = motion.solve(df).cache()
    assert solved.count() == 11 and motion.solve(gap).count() == 10
    assert all(abs(sum(v * v for v in q) - 1) < 1e-6 for r in solved.collect() for q in r.quats)
    clocks = spark.createDataFrame([("c", t) for t in (0.0, 0.15, 1.0, 1.1)], "clip_id string, clock double")
    got = {r.clock: r for r in motion.playback(solved, clocks, 10).collect()}
    by = {r.frame: r for r in solved.collect()}
    assert got[0.0].root.x == pytest.approx(by[0].root.x) and got[1.1].root.x == pytest.approx(by[0].root.x)
    assert got[0.15].root.y == pytest.approx((by[1].root.y + by[2].root.y) / 2)
    assert motion.playback(solved, clocks, 10, loop=False).where("clock = 1.1").first().root.x == pytest.approx(by[10].root.x)
    ref = markers.reference_pose(df, 4).first()
    assert ref.markers["q_chest"].x == pytest.approx(at[4, "Q_Chest"][0]) and markers.reference_pose(df, 99).count() == 0
    assert ref.hips.z == pytest.approx(np.mean([at[4, m][2] for m in markers.WAIST]))
    assert markers.bone_positions(df, [("Head", "q_headl"), ("Head", "Q_HEADR"), ("None", "nope")]).select("bone").distinct().count() == 1


def test_bone_names(spark):
    bones = spark.createDataFrame([("mixamorig:Hips", 0), ("Chest", 1), ("LeftToes", 2)], "bone string, rank int")
    wanted = spark.createDataFrame([("Hips", "hips", 1), ("Spine2", "spine2", 1), ("Spine2", "chest", 3), ("Neck", "neck", 1)], "joint string, alias string, priority int")
    got = {r.joint: r.bone for r in markers.bone_map(wanted, bones, spark.createDataFrame([("Neck", "lefttoes")], "joint string, bone string")).collect()}
    assert got == {"Hips": "mixamorig:Hips", "Spine2": "Chest", "Neck": "LeftToes"}
    names = spark.createDataFrame([("chest",), ("pelvis",)], "name string")
    assert {r.name: r.bone for r in markers.exact_bone_map(names, bones.withColumn("bone", F.replace("bone", F.lit("mixamorig:"), F.lit("")))).collect()} == {"chest": "Chest", "pelvis": "Hips"}
    assert markers.exact_bone_map(names, bones, contains=True).where("name = 'chest'").first().bone == "Chest"


def test_model_hook(spark):
    df = spark.createDataFrame([("a", 0, [(1.0, 2.0, 0.5)])], "clip_id string, frame long, joints array<struct<x:double,y:double,conf:double>>")
    assert motion.flat_lift(df).first().joints[0].z == 0
    assert motion.with_model(df.select("clip_id", "frame"), lambda b: b.assign(frame=b.frame + 1), "clip_id string, frame long").first().frame == 1
