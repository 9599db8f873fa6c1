"""Pose mathematics: joint maps, normalisation, post-processing and retargeting (VEC01-VEC17, PRJ07-PRJ10, WIN10-WIN14).

A frame is a row (clip_id, frame, joints: array of structs); long form is a row for each joint. Per-frame
rules are column expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as v
from . import series

# Joint orders, parents and source indices.
H36M_PARENTS = (-1, 0, 1, 2, 0, 4, 5, 0, 7, 8, 9, 8, 11, 12, 8, 14, 15)
COCO_TO_H36M = {1: 12, 2: 14, 3: 16, 4: 11, 5: 13, 6: 15, 11: 5, 12: 7, 13: 9, 14: 6, 15: 8, 16: 10}
H36M_TO_HALPE = {0: 10, 5: 11, 6: 14, 7: 12, 8: 15, 9: 13, 10: 16, 11: 4, 12: 1, 13: 5, 14: 2, 15: 6, 16: 3, 17: 0}
FEET = (3, 6)
SKELETON = (
    ("Hips", None), ("RightUpLeg", "Hips"), ("RightLeg", "RightUpLeg"), ("RightFoot", "RightLeg"), ("LeftUpLeg", "Hips"), ("LeftLeg", "LeftUpLeg"), ("LeftFoot", "LeftLeg"),
    ("Spine", "Hips"), ("Spine1", "Spine"), ("Neck", "Spine1"), ("Head", "Neck"),
    ("LeftShoulder", "Spine1"), ("LeftArm", "LeftShoulder"), ("LeftForeArm", "LeftArm"), ("LeftHand", "LeftForeArm"),
    ("RightShoulder", "Spine1"), ("RightArm", "RightShoulder"), ("RightForeArm", "RightArm"), ("RightHand", "RightForeArm"),
)
JOINTS = tuple(n for n, _ in SKELETON)
PARENTS = tuple(JOINTS.index(p) if p else -1 for _, p in SKELETON)


def kp(x, y, conf) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), conf.alias("conf"))


def _mix(conf: Column, *terms: tuple[float, Column]) -> Column:
    part = lambda k: reduce(lambda a, b: a + b, (w * p[k] for w, p in terms))
    return kp(part("x"), part("y"), conf)


def _mean(*values: Column) -> Column:
    return reduce(lambda a, b: a + b, values) / len(values)


def coco_to_h36m(joints: Column) -> Column:
    """17 key points to 17 joints; pelvis, spine, thorax, neck and head are synthesized."""
    c = [F.element_at(joints, i + 1) for i in range(17)]
    conf = lambda *i: F.least(*(c[k]["conf"] for k in i))
    pelvis = _mix(conf(11, 12), (0.5, c[11]), (0.5, c[12]))
    thorax = _mix(conf(5, 6), (0.5, c[5]), (0.5, c[6]))
    spine = _mix(F.least(pelvis["conf"], thorax["conf"]), (0.5, pelvis), (0.5, thorax))
    face_conf = _mean(*(c[i]["conf"] for i in range(5)))
    face = _mix(face_conf, *((0.2, c[i]) for i in range(5)))
    neck = _mix(F.least(thorax["conf"], face_conf), (0.65, thorax), (0.35, face))
    head = _mix(_mean(*(c[i]["conf"] for i in range(3))), (0.7, c[0]), (0.3, face))
    made = {0: pelvis, 7: spine, 8: thorax, 9: neck, 10: head}
    return F.array(*(made[j] if j in made else kp(*(c[COCO_TO_H36M[j]][k] for k in ("x", "y", "conf"))) for j in range(17)))


def coco_to_halpe(joints: Column) -> Column:
    """17 key points to 26: body as it is, head above the nose, neck and hip centre, feet from the ankles."""
    c = [F.element_at(joints, i + 1) for i in range(17)]
    face_conf = _mean(*(c[i]["conf"] for i in range(5)))
    shoulders = _mix(F.least(c[5]["conf"], c[6]["conf"]), (0.5, c[5]), (0.5, c[6]))
    hips = _mix(F.least(c[11]["conf"], c[12]["conf"]), (0.5, c[11]), (0.5, c[12]))
    face = _mix(face_conf, *((0.2, c[i]) for i in range(5)))
    # 0.7 of a point 0.8 beyond the nose as seen from the shoulders, 0.3 of the face's centre
    head = _mix(face_conf, (0.7 * 1.8, c[0]), (-0.7 * 0.8, shoulders), (0.3, face))
    plain = [kp(*(p[k] for k in ("x", "y", "conf"))) for p in c]
    return F.array(*plain, head, shoulders, hips, *(plain[15 + i % 2] for i in range(6)))


def h36m_to_halpe(joints: Column) -> Column:
    c = [F.element_at(joints, i + 1) for i in range(17)]
    zero = kp(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    middle = _mix(F.least(c[11]["conf"], c[14]["conf"]), (0.5, c[11]), (0.5, c[14]))
    out = [zero] * 26
    for to, source in H36M_TO_HALPE.items():
        out[to] = kp(*(c[source][k] for k in ("x", "y", "conf")))
    out[18] = out[19] = middle
    for i in range(6):
        out[20 + i] = kp(*(c[15 + i % 2][k] for k in ("x", "y", "conf")))
    return F.array(*out)


def model_input(frame: Column, clip: Column, joints: Column) -> Column:
    """The row that a lifting model reads: index, image id, and x, y, confidence end to end."""
    return F.struct(frame.alias("idx"), F.concat(clip, F.lit("_"), frame.cast("string")).alias("image_id"), F.flatten(F.transform(joints, lambda p: F.array(p["x"], p["y"], p["conf"]))).alias("keypoints"))


def normalised(joints: Column, root: int = 0, left: int = 11, right: int = 14) -> Column:
    """struct(joints, root_x, root_y, scale): centred on the root, in units of the shoulders' distance."""
    at = lambda i: F.element_at(joints, i + 1)
    size = F.greatest(F.hypot(at(left)["x"] - at(right)["x"], at(left)["y"] - at(right)["y"]), F.lit(1e-6))
    moved = F.transform(joints, lambda p: F.struct(((p["x"] - at(root)["x"]) / size).alias("x"), ((p["y"] - at(root)["y"]) / size).alias("y")))
    return F.struct(moved.alias("joints"), at(root)["x"].alias("root_x"), at(root)["y"].alias("root_y"), size.alias("scale"))


def denormalised(n: Column) -> Column:
    return F.transform(n["joints"], lambda p: F.struct((p["x"] * n["scale"] + n["root_x"]).alias("x"), (p["y"] * n["scale"] + n["root_y"]).alias("y")))


def visible_edges(joints: Column, edges: list[tuple[int, int]], least: float) -> Column:
    """Pairs of joints whose confidences both reach ``least``."""
    ok = lambda i: F.element_at(joints, i + 1)["conf"] >= least
    return F.filter(F.array(*(F.when(ok(a) & ok(b), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))) for a, b in edges)), lambda e: e.isNotNull())


# Long form


def to_long(frames: DataFrame, joints: str = "joints") -> DataFrame:
    return frames.select("clip_id", "frame", F.posexplode(joints).alias("joint", "p")).select("clip_id", "frame", "joint", "p.x", "p.y", "p.z")


def to_frames(long: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("joint", F.struct("x", "y", "z").alias("p"))))
    return long.groupBy("clip_id", "frame").agg(F.transform(rows, lambda r: r["p"]).alias("joints"))


def smoothed(long: DataFrame, window: int = 11) -> DataFrame:
    keys = ["clip_id", "joint"]
    return long.select("clip_id", "frame", "joint", *(series.smoothed(a, keys, window, idx="frame").alias(a) for a in "xyz"))


def velocities(long: DataFrame, dt: float) -> DataFrame:
    keys = ["clip_id", "joint"]
    return long.select("clip_id", "frame", "joint", *(series.gradient(a, keys, dt, "frame").alias(f"v{a}") for a in "xyz"))


def ancestors(parents: tuple[int, ...]) -> list[tuple[int, int]]:
    """(joint, ancestor) for each joint and all joints on its way to the root, itself included, the root left out."""
    out = []
    for j in range(len(parents)):
        k = j
        while k >= 0 and parents[k] >= 0:
            out.append((j, k))
            k = parents[k]
    return out


def segments(long: DataFrame, parents: tuple[int, ...] = H36M_PARENTS) -> DataFrame:
    """dx, dy, dz and length of each joint's segment from its parent; the skeleton is a constant."""
    spark = long.sparkSession
    tree = spark.createDataFrame([(j, p) for j, p in enumerate(parents) if p >= 0], "joint int, parent int")
    parent = long.select("clip_id", "frame", F.col("joint").alias("parent"), *(F.col(a).alias(f"p{a}") for a in "xyz"))
    met = long.join(F.broadcast(tree), "joint").join(parent, ["clip_id", "frame", "parent"])
    d = [F.col(a) - F.col(f"p{a}") for a in "xyz"]
    return met.select("clip_id", "frame", "joint", "parent", *(c.alias(f"d{a}") for c, a in zip(d, "xyz")), F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("length"))


def skeletons(long: DataFrame, joints: int) -> DataFrame:
    """clip_id, frame, p: array of the joints' positions by number, null where one is missing.

    Rows are dealt out by clip, which serves all that follows: frames, medians and what is carried along the frames.
    """
    at = lambda j: F.max(F.when(F.col("joint") == j, v.vec(F.col("x"), F.col("y"), F.col("z"))))
    return long.repartition("clip_id").groupBy("clip_id", "frame").agg(F.array(*(at(j) for j in range(joints))).alias("p"))


def constant_lengths(long: DataFrame, parents: tuple[int, ...] = H36M_PARENTS) -> DataFrame:
    """Poses with every bone at its median length: directions stay; a segment without length takes the last
    direction before it, else straight up. Joints are the root plus the sum of bones on their way from it; a joint
    whose way lacks a bone is left out. One exchange; a frame's skeleton is folded in its own row.
    """
    bones = [j for j, p in enumerate(parents) if p >= 0]
    at = lambda c, j: F.element_at(c, j + 1)
    f = skeletons(long, len(parents))
    f = f.withColumn("d", F.array(*(v.sub(at("p", j), at("p", parents[j])) for j in bones))).withColumn("n", F.transform("d", v.norm))
    lengths = f.groupBy("clip_id").agg(F.array(*(F.median(F.get("n", F.lit(i))) for i in range(len(bones)))).alias("bone"))
    there = lambda i: F.get("n", F.lit(i))
    ways = [F.when(there(i) >= 1e-8, v.scale(F.get("d", F.lit(i)), 1 / there(i))) for i in range(len(bones))]
    kept = F.array(*(F.coalesce(series.carried_forward(w, ["clip_id"], "frame"), v.vec(0, 1, 0)) for w in ways))
    met = f.select("clip_id", "frame", "p", "n", kept.alias("way")).join(lengths, "clip_id")
    # a bone that the frame lacks stays null, and so does what hangs on it
    met = met.withColumn("b", F.array(*(F.when(there(i).isNotNull(), v.scale(F.get("way", F.lit(i)), F.get("bone", F.lit(i)))) for i in range(len(bones)))))
    place = {j: i for i, j in enumerate(bones)}
    chains = {j: [k for a, k in ancestors(parents) if a == j] for j in range(len(parents))}
    whole = [F.struct(F.lit(j).alias("joint"), reduce(v.add, (F.get("b", F.lit(place[k])) for k in chains[j]), at("p", 0)).alias("p")) for j in range(len(parents))]
    return met.select("clip_id", "frame", F.explode(F.array(*whole)).alias("j")).select("clip_id", "frame", "j.joint", "j.p.x", "j.p.y", "j.p.z").dropna(subset=["x", "y", "z"])


def scaled(long: DataFrame, height: float = 1.75) -> DataFrame:
    """Scaled so that the median of the frames' heights is ``height``."""
    per_frame = long.groupBy("clip_id", "frame").agg((F.max("y") - F.min("y")).alias("h"))
    factor = per_frame.groupBy("clip_id").agg((F.lit(height) / F.greatest(F.median("h"), F.lit(1e-6))).alias("f"))
    return long.join(factor, "clip_id").select("clip_id", "frame", "joint", *((F.col(a) * F.col("f")).alias(a) for a in "xyz"))


def grounded(long: DataFrame, feet: tuple[int, ...] = FEET) -> DataFrame:
    """Moved so that the lowest foot of the clip is at height 0."""
    low = F.min(F.when(F.col("joint").isin(*feet), F.col("y"))).over(Window.partitionBy("clip_id"))
    return long.select("clip_id", "frame", "joint", "x", (F.col("y") - low).alias("y"), "z")


# Retargeting


def with_hands(joints: Column) -> Column:
    """17 joints to the 19 of the skeleton: hands beyond the wrists, neck between thorax and head."""
    c = [F.element_at(joints, i + 1) for i in range(17)]
    p = [v.vec(*(x[k] for k in "xyz")) for x in c]

    def hand(elbow: Column, wrist: Column) -> Column:
        arm = v.sub(wrist, elbow)
        n = v.norm(arm)
        return v.add(wrist, v.scale(arm, F.greatest(n * 0.4, F.lit(1e-4)) / (n + v.EPS)))

    neck = v.scale(v.add(p[8], p[10]), 0.5)
    return F.array(*p[0:9], neck, p[10], *p[11:14], hand(p[12], p[13]), *p[14:17], hand(p[15], p[16]))


def facing_forward(frames: DataFrame) -> DataFrame:
    """Clips turned about the vertical through each clip's first hips so that frame 0 faces +Z."""
    first = frames.where("frame = 0").select("clip_id", "joints")
    j = lambda i: F.element_at("joints", i + 1)
    lateral = v.sub(v.scale(v.add(j(11), j(4)), 0.5), v.scale(v.add(j(15), j(1)), 0.5))
    ahead = v.cross(lateral, v.sub(j(8), j(0)))
    flat = F.hypot(ahead["x"], ahead["z"])
    turn = F.when(flat >= 1e-6, -F.atan2(ahead["x"], ahead["z"])).otherwise(0.0)
    turned = first.select("clip_id", turn.alias("_yaw"), j(0).alias("_hips"))
    met = frames.join(turned, "clip_id")

    def move(p: Column) -> Column:
        x, z, h = p["x"] - F.col("_hips")["x"], p["z"] - F.col("_hips")["z"], F.col("_hips")
        c, s = F.cos("_yaw"), F.sin("_yaw")
        return v.vec(c * x + s * z + h["x"], p["y"], -s * x + c * z + h["z"])

    return met.withColumn("joints", F.transform("joints", move)).drop("_yaw", "_hips")


def rest_offsets(frames: DataFrame, parents: tuple[int, ...] = PARENTS, first: int = 10) -> DataFrame:
    """clip_id, offsets: mean of the first frames, each joint from its parent."""
    long = frames.where(F.col("frame") < first).select("clip_id", F.posexplode("joints").alias("joint", "p"))
    rest = long.groupBy("clip_id", "joint").agg(F.struct(*(F.avg(F.col("p")[k]).alias(k) for k in "xyz")).alias("r"))
    rest = rest.groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("joint", "r"))), lambda x: x["r"]).alias("rs"))
    at = lambda i: F.element_at("rs", i + 1)
    return rest.select("clip_id", F.array(*(v.sub(at(i), at(p)) if p >= 0 else v.vec(0, 0, 0) for i, p in enumerate(parents))).alias("offsets"))


def retargeted(frames: DataFrame, parents: tuple[int, ...] = PARENTS) -> DataFrame:
    """clip_id, frame, root, quats (local, xyzw structs), offsets of frames in the skeleton's joints.

    A joint with one child turns as that bone does, with several by best fit, without bones not at all.
    """
    offsets = rest_offsets(frames, parents)
    met = frames.join(offsets, "clip_id")
    kids = {i: [j for j, p in enumerate(parents) if p == i] for i in range(len(parents))}
    j = lambda i: F.element_at("joints", i + 1)
    rest = lambda i: F.element_at("offsets", i + 1)
    world = {}
    for i, own in kids.items():
        if not own:
            world[i] = v.quat(*v.IDENTITY)
        elif len(own) == 1:
            bone, pose = rest(own[0]), v.sub(j(own[0]), j(i))
            there = (v.norm(bone) >= v.EPS) & (v.norm(pose) >= v.EPS)
            world[i] = F.when(there, v.between(bone, pose)).otherwise(v.quat(*v.IDENTITY))
        else:
            usable = [(v.norm(rest(k)) >= v.EPS) & (v.norm(v.sub(j(k), j(i))) >= v.EPS) for k in own]
            listed = lambda f: F.filter(F.array(*(F.when(u, v.normalised(f(k))) for u, k in zip(usable, own))), lambda x: x.isNotNull())  # noqa: E731, B023
            world[i] = v.best_rotation(listed(rest), listed(lambda k, i=i: v.sub(j(k), j(i))))
    # bound once: every joint's turn stands in its own and its children's local turns
    at = lambda w, i: F.element_at(w, i + 1)
    local = v.let(F.array(*(world[i] for i in range(len(parents)))))(lambda w: F.array(*(v.q_local(at(w, p), at(w, i)) if p >= 0 else at(w, i) for i, p in enumerate(parents))))
    return met.select("clip_id", "frame", j(0).alias("root"), local.alias("quats"), "offsets")


def rest_world(offsets: Column, parents: tuple[int, ...] = PARENTS) -> Column:
    """Rest positions: sums of offsets on the way from the root (the tree is a constant)."""
    chains = {i: [k for j, k in ancestors(parents) if j == i] for i in range(len(parents))}
    at = lambda i: F.element_at(offsets, i + 1)
    return F.array(*(reduce(v.add, (at(k) for k in chains[i])) if chains[i] else v.vec(0, 0, 0) for i in range(len(parents))))


def exported(animation: DataFrame, parents: tuple[int, ...] = PARENTS, centre: bool = True) -> DataFrame:
    """Y-up frames for the document sinks: roots start at the origin, stand on the ground and are lifted by the rest pose."""
    up = animation.select("clip_id", "frame", v.flip_y(F.col("root")).alias("root"), F.transform("quats", v.q_flip_y).alias("quats"), F.transform("offsets", v.flip_y).alias("offsets"))
    w = Window.partitionBy("clip_id")
    start = F.first("root").over(w.orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    low = F.min(F.col("root")["y"]).over(w)
    lift = F.greatest(F.lit(0.0), -F.array_min(F.transform(rest_world(F.col("offsets"), parents), lambda p: p["y"])))
    shift = lambda k: F.col("root")[k] - (F.col("_start")[k] if centre else F.lit(0.0))
    placed = up.withColumn("_start", start).withColumn("_low", low)
    return placed.select("clip_id", "frame", v.vec(shift("x"), F.col("root")["y"] - F.col("_low") + lift, shift("z")).alias("root"), "quats", "offsets")
