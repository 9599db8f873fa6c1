"""Sinks (SNK01-SNK07, SNK10): result and issue tables, numbered runs, JSON and BVH documents.

A document is written as lines: rows go to their clip's task, are sorted there and streamed to the file, so a clip of any
length needs no memory. Files appear when Spark commits the job; a task that is killed leaves nothing.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import run_number
from ..functions.vector import euler_zxy
from ..operators.aggregates import next_run
from ..plans.shots import with_first_event
from ..schemas import ISSUE_COLUMNS, RESULT_COLUMNS
from ..session import materialised


def write_table(df: DataFrame, path: str, columns: tuple[str, ...] | None = None, files: int | None = None, order: tuple[str, ...] = ()) -> None:
    """';'-separated text with header. files: number of files, dealt out after the work
    is done, so that the stages before keep their tasks; None leaves the partitioning, which scales.
    order: columns that rows are sorted by in each file, or over all files where their number is left open.
    """
    out = df.repartition(files) if files else df
    out = (out.sortWithinPartitions(*order) if files else out.orderBy(*order)) if order else out
    (out.select(*columns) if columns else out).write.mode("errorifexists").csv(path, sep=";", header=True, escape='"', emptyValue="")


def write_results(df: DataFrame, path: str, files: int | None = None) -> None:
    """Results by recording, the one of the earliest event first, where they still have ``event_no``."""
    if "event_no" in df.columns:
        write_table(with_first_event(materialised(df)), path, RESULT_COLUMNS, files, ("first_event", "fixture_file", "event_no"))
    else:
        write_table(df, path, RESULT_COLUMNS, files)


def write_issues(df: DataFrame, path: str, files: int | None = None) -> None:
    write_table(df, path, ISSUE_COLUMNS, files)


def _reserved(spark: SparkSession, store, path) -> bool:
    """Creates the empty file ``path`` unless there is one, atomically; whether it did."""
    if store.getUri().getScheme() == "file":  # the local store's own create isn't atomic
        return spark._jvm.java.io.File(path.toUri().getPath()).createNewFile()
    try:
        store.create(path, False).close()
        return True
    except Py4JJavaError as e:
        if store.exists(path):
            return False
        raise e


def run_folder(spark: SparkSession, base: str) -> str:
    """Path of the next run below ``base``; its number is taken, so that two runs at once get two numbers.

    The number follows the largest of the folders' names and of the empty files in ``_numbers`` that stand for numbers taken.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path
    root, taken = place(base), place(base, "_numbers")
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(taken)
    names = [s.getPath().getName() for p in (root, taken) for s in store.listStatus(p)]
    number = next_run(spark.createDataFrame([(n,) for n in names], "name string"), run_number("name")).first()[0]
    while not _reserved(spark, store, place(taken, f"run_{number}__")):
        number += 1
    stamp = spark.sql("select date_format(current_timestamp(), 'dd_MM_yyyy_HH_mm')").first()[0]
    return f"{base.rstrip('/')}/run_{number}__{stamp}"


FIRST, LAST = -(1 << 62), 1 << 62


def animation_lines(frames: DataFrame, joint_names: list[str], frame_rate: float = 30.0) -> DataFrame:
    """clip_id, at, line: a JSON document for each clip of frames (clip_id, frame, root, quats: arrays of structs), a line a frame."""
    number = lambda q: F.array(*(q[k] for k in "xyzw"))
    one = F.struct(
        F.array(*(F.col("root")[k] for k in "xyz")).alias("root_position"),
        F.flatten(F.transform("quats", number)).alias("rotations_flat"),
        F.transform("quats", number).alias("rotations"),
    )
    head = {"frame_rate": float(frame_rate), "coordinate_system": "unity_y_up_left_handed", "quaternion_format": "xyzw", "root_joint": joint_names[0], "joint_names": joint_names}
    starts = frames.groupBy("clip_id").agg(F.min("frame").alias("_start"))
    body = frames.join(starts, "clip_id").select("clip_id", F.col("frame").cast("long").alias("at"), F.concat(F.when(F.col("frame") > F.col("_start"), ",").otherwise(""), F.to_json(one)).alias("line"))
    ends = starts.select("clip_id", F.explode(F.array(F.struct(F.lit(FIRST).alias("at"), F.lit(json.dumps(head)[:-1] + ', "frames": [').alias("line")), F.struct(F.lit(LAST).alias("at"), F.lit("]}").alias("line")))).alias("e"))
    return body.union(ends.select("clip_id", "e.at", "e.line"))


def depth_first(parents: list[int]) -> list[int]:
    """Joints from the root, each before its children, children in order."""
    kids: dict[int, list[int]] = {}
    for i, p in enumerate(parents):
        kids.setdefault(p, []).append(i)
    out, stack = [], list(reversed(kids.get(-1, [])))
    while stack:
        out.append(stack.pop())
        stack += reversed(kids.get(out[-1], []))
    return out


def bvh_hierarchy(names: list[str], parents: list[int], offsets: list[tuple[float, float, float]]) -> list[str]:
    """The skeleton's lines; offsets are a constant of the clip."""
    kids = {i: [j for j, p in enumerate(parents) if p == i] for i in range(len(names))}
    out = ["HIERARCHY"]

    def joint(i: int, depth: int) -> None:
        pad = "  " * depth
        out.extend([f"{pad}{'ROOT' if parents[i] < 0 else 'JOINT'} {names[i]}", f"{pad}{{", f"{pad}  OFFSET " + " ".join(f"{v:.6f}" for v in offsets[i])])
        out.append(f"{pad}  CHANNELS " + ("6 Xposition Yposition Zposition " if parents[i] < 0 else "3 ") + "Zrotation Xrotation Yrotation")
        for j in kids[i]:
            joint(j, depth + 1)
        if not kids[i]:
            out.extend([f"{pad}  End Site", f"{pad}  {{", f"{pad}    OFFSET 0.000000 0.050000 0.000000", f"{pad}  }}"])
        out.append(f"{pad}}}")

    joint(parents.index(-1), 0)
    return out


def bvh_frames(frames: DataFrame, parents: list[int]) -> DataFrame:
    """clip_id, frame, line: the motion lines, channels in depth-first order with six decimals."""
    parts = [F.col("root")[k] for k in "xyz"]
    for j in depth_first(parents):
        angles = euler_zxy(F.get("quats", F.lit(j)))
        parts += [angles[k] for k in "zxy"]
    return frames.select("clip_id", "frame", F.array_join(F.array(*(F.format_string("%.6f", p) for p in parts)), " ").alias("line"))


def bvh_lines(frames: DataFrame, hierarchy: list[str], parents: list[int], frame_time: float = 1 / 30) -> DataFrame:
    """clip_id, at, line: a BVH text for each clip."""
    body = bvh_frames(frames, parents)
    sizes = body.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"))
    head = F.concat(F.lit("\n".join(hierarchy) + "\nMOTION\nFrames: "), F.col("n").cast("string"), F.lit(f"\nFrame Time: {frame_time:.8f}"))
    return body.select("clip_id", F.col("frame").cast("long").alias("at"), "line").union(sizes.select("clip_id", F.lit(FIRST).alias("at"), head.alias("line")))


def write_documents(lines: DataFrame, path: str) -> None:
    """One text file for each clip, in a folder clip_id=..., of its lines (clip_id, at, line) in order of ``at``."""
    lines.select("clip_id", "at", "line").repartition("clip_id").sortWithinPartitions("clip_id", "at").select("clip_id", "line").write.partitionBy("clip_id").text(path)


def run_summary(spark: SparkSession, artifacts: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(artifacts.items()), "artifact string, path string")
