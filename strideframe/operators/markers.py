"""Markers to joints and rotations (JOIN12-JOIN15, VEC07, VEC14, VEC15, AGG13, AGG18, AGG19, AGG22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as v
from ..functions.text import bone_key
from .aggregates import calm_frame, top_one
from .series import frame_seconds

# The markers that a solve needs, and the markers of each joint.
REQUIRED = (
    "Q_HeadL", "Q_HeadR", "Q_HeadFront", "Q_Chest", "Q_SpineThoracic2", "Q_SpineThoracic12",
    "Q_LShoulderTop", "Q_LArm", "Q_LElbowOut", "Q_LElbowIn", "Q_LWristIn", "Q_LWristOut", "Q_LHand2",
    "Q_RShoulderTop", "Q_RArm", "Q_RElbowOut", "Q_RElbowIn", "Q_RWristIn", "Q_RWristOut", "Q_RHand2",
    "Q_WaistLFront", "Q_WaistL", "Q_WaistBack", "Q_WaistR", "Q_WaistRFront",
    "Q_LThighFrontLow", "Q_LKneeOut", "Q_LShinFrontHigh", "Q_LAnkleOut", "Q_LForefoot2",
    "Q_RThighFrontLow", "Q_RKneeOut", "Q_RShinFrontHigh", "Q_RAnkleOut", "Q_RForefoot2",
)
HEAD = ("Q_HeadL", "Q_HeadR", "Q_HeadFront")
WAIST = ("Q_WaistLFront", "Q_WaistL", "Q_WaistBack", "Q_WaistR", "Q_WaistRFront")
#: joint, parent, markers (averaged). The neck lies between chest and head and follows below.
RIG = (
    ("Hips", None, WAIST),
    ("RightUpLeg", "Hips", ("Q_RThighFrontLow",)), ("RightLeg", "RightUpLeg", ("Q_RKneeOut",)), ("RightFoot", "RightLeg", ("Q_RAnkleOut",)), ("RightToeBase", "RightFoot", ("Q_RForefoot2",)),
    ("LeftUpLeg", "Hips", ("Q_LThighFrontLow",)), ("LeftLeg", "LeftUpLeg", ("Q_LKneeOut",)), ("LeftFoot", "LeftLeg", ("Q_LAnkleOut",)), ("LeftToeBase", "LeftFoot", ("Q_LForefoot2",)),
    ("Spine", "Hips", ("Q_WaistBack",)), ("Spine1", "Spine", ("Q_SpineThoracic12",)), ("Spine2", "Spine1", ("Q_Chest",)),
    ("Neck", "Spine2", ()), ("Head", "Neck", HEAD),
    ("LeftShoulder", "Spine2", ("Q_LShoulderTop",)), ("LeftArm", "LeftShoulder", ("Q_LArm",)), ("LeftForeArm", "LeftArm", ("Q_LElbowOut", "Q_LElbowIn")), ("LeftHand", "LeftForeArm", ("Q_LWristIn", "Q_LWristOut")),
    ("RightShoulder", "Spine2", ("Q_RShoulderTop",)), ("RightArm", "RightShoulder", ("Q_RArm",)), ("RightForeArm", "RightArm", ("Q_RElbowOut", "Q_RElbowIn")), ("RightHand", "RightForeArm", ("Q_RWristIn", "Q_RWristOut")),
)
RIG_JOINTS = tuple(j for j, _, _ in RIG)
RIG_PARENTS = tuple(RIG_JOINTS.index(p) if p else -1 for _, p, _ in RIG)


def weights() -> list[tuple[str, str, float]]:
    """(joint, marker, weight); the neck is half chest and half head."""
    out = [(j, m, 1 / len(ms)) for j, _, ms in RIG for m in ms]
    return out + [("Neck", "Q_Chest", 0.5)] + [("Neck", m, 0.5 / 3) for m in HEAD]


def joints(points: DataFrame, strict: bool = True) -> DataFrame:
    """clip_id, frame, joint, x, y, z: weighted means of markers (clip_id, frame, marker, x, y, z).

    strict: a joint needs all its markers; else the mean is over those that are there.
    """
    spark = points.sparkSession
    rig = spark.createDataFrame(weights(), "joint string, marker string, w double")
    met = points.join(F.broadcast(rig), "marker")
    need = rig.groupBy("joint").agg(F.count(F.lit(1)).alias("_need"))
    found = met.groupBy("clip_id", "frame", "joint").agg(F.count(F.lit(1)).alias("_n"), *((F.sum(F.col("w") * F.col(a)) / F.sum("w")).alias(a) for a in "xyz"))
    if strict:
        found = found.join(F.broadcast(need), "joint").where("_n = _need")
    return found.select("clip_id", "frame", "joint", "x", "y", "z")


def bone_positions(points: DataFrame, mapping: list[tuple[str, str]]) -> DataFrame:
    """clip_id, frame, bone, x, y, z: the mean of a bone's markers that are present; bones without any have none."""
    table = points.sparkSession.createDataFrame(mapping, "bone string, marker string").withColumn("_key", F.lower("marker")).drop("marker")
    met = points.withColumn("_key", F.lower("marker")).join(F.broadcast(table), "_key")
    return met.groupBy("clip_id", "frame", "bone").agg(*(F.avg(a).alias(a) for a in "xyz"))


def reference_pose(points: DataFrame, frame: int, waist: tuple[str, ...] = WAIST) -> DataFrame:
    """clip_id, markers (map by lower-case name), hips: positions in one frame; clips without that frame have no row."""
    one = points.where(F.col("frame") == frame)
    inside = F.col("marker").isin(*waist)
    return one.groupBy("clip_id").agg(F.map_from_entries(F.collect_list(F.struct(F.lower("marker"), F.struct("x", "y", "z")))).alias("markers"), F.struct(*(F.avg(F.when(inside, F.col(a))).alias(a) for a in "xyz")).alias("hips"))


def calm(points: DataFrame) -> DataFrame:
    return calm_frame(points, ["clip_id"], "frame", F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)


def frame_arrays(found: DataFrame, names: tuple[str, ...] = RIG_JOINTS) -> DataFrame:
    """clip_id, frame, joints: arrays in the rig's order of frames that have every joint."""
    order = found.sparkSession.createDataFrame(list(enumerate(names)), "no int, joint string")
    rows = found.join(F.broadcast(order), "joint").groupBy("clip_id", "frame").agg(F.array_sort(F.collect_list(F.struct("no", F.struct("x", "y", "z").alias("p")))).alias("ps"))
    return rows.where(F.size("ps") == len(names)).select("clip_id", "frame", F.transform("ps", lambda r: r["p"]).alias("joints"))


def solved(frames: DataFrame, parents: tuple[int, ...] = RIG_PARENTS) -> DataFrame:
    """clip_id, frame, root, quats, offsets: rotations against the rest pose of the first frames.

    One child: the turn of its bone; two or more: the frame of the first two bones. Closed forms only.
    """
    from .pose import rest_offsets

    met = frames.join(rest_offsets(frames, parents), "clip_id")
    kids = {i: [j for j, p in enumerate(parents) if p == i] for i in range(len(parents))}
    j = lambda i: F.element_at("joints", i + 1)
    rest = lambda i: F.element_at("offsets", i + 1)
    world: list[Column] = []
    for i, own in kids.items():
        if not own:
            world.append(v.quat(*v.IDENTITY))
        elif len(own) == 1:
            world.append(v.between(rest(own[0]), v.sub(j(own[0]), j(i))))
        else:
            a, b = own[:2]
            world.append(v.two_vector_fit(rest(a), rest(b), v.sub(j(a), j(i)), v.sub(j(b), j(i))))
    met = met.withColumn("_world", F.array(*world))
    at = lambda i: F.element_at("_world", i + 1)
    local = F.array(*(v.q_local(at(p), at(i)) if p >= 0 else at(i) for i, p in enumerate(parents)))
    return met.select("clip_id", "frame", j(0).alias("root"), local.alias("quats"), "offsets")


def delta_rotation(bind: Column, now: Column, bind_rotation: Column) -> Column:
    """Rotation of a segment since the bind pose, on top of its bind rotation."""
    return v.q_mul(v.between(bind, now), bind_rotation)


def identity_count(quats: Column, eps: float = 1e-6) -> Column:
    return F.size(F.filter(quats, lambda q: F.abs(F.abs(q["w"]) - 1) < eps))


def bone_map(wanted: DataFrame, bones: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """joint, bone: a manual override first, then the joint's aliases in order, compared by normalised name.

    wanted: joint, alias, priority (from 1). bones: bone, in rank order. overrides: joint, bone.
    """
    named = bones.withColumn("_key", bone_key("bone"))
    found = wanted.withColumn("_key", bone_key("alias")).join(named, "_key").select("joint", "bone", "priority", "rank")
    if overrides is not None:
        manual = overrides.withColumn("_key", bone_key("bone")).drop("bone").join(named, "_key").select("joint", "bone", F.lit(0).alias("priority"), "rank")
        found = manual.unionByName(found)
    return top_one(found, ["joint"], "priority", "rank").select("joint", "bone")


def exact_bone_map(names: DataFrame, bones: DataFrame, root: str = "Hips", contains: bool = False) -> DataFrame:
    """name, bone: equal names without regard to case (or names that contain it); the root falls back to ``root``."""
    a, b = names.withColumn("_k", F.lower("name")), bones.withColumn("_k", F.lower("bone"))
    rule = F.contains(b["_k"], a["_k"]) if contains else a["_k"] == b["_k"]
    # both tables are skeletons of some dozens of names
    met = top_one(a.join(F.broadcast(b), rule).select("name", "bone", "rank"), ["name"], "rank").select("name", "bone")
    rest = names.join(met, "name", "left_anti").where(F.lower("name").isin("root", "pelvis", root.lower())).crossJoin(F.broadcast(bones.where(F.lower("bone") == root.lower()).select("bone")))
    return met.unionByName(rest.select("name", "bone"))


def rates(points: DataFrame) -> DataFrame:
    """clip_id, seconds a frame, from the data."""
    return points.select("clip_id", "frame", "time_s").distinct().groupBy("clip_id").agg(frame_seconds(F.col("time_s")).alias("frame_s"))
