"""Animation documents: scan with checks, and array tables (SRC11, SRC13).

A document whose frames stand on lines of their own, as ``sinks.animation_lines`` writes it, is read in blocks of lines by many
tasks (``clips``); any other one is parsed as a whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.points import frame_rotation, parse_animation
from ..functions.vector import let
from ..schemas import ANIMATION, FRAME
from ..session import materialised
from .text_files import Blocks, document, text_lines

#: Heads of documents that go to all workers, names of joints included; more are joined by an exchange.
HEADS = 20_000


def _rate(rate: Column, default_rate: float) -> Column:
    return F.when(rate > 0, rate).otherwise(default_rate)


def _rotated(f: Column) -> Column:
    """Number of joints that a frame has rotations of, flat or nested."""
    n = lambda c: F.coalesce(F.size(c), F.lit(-1))
    return F.greatest(F.floor(n(f["rotations_flat"]) / 4), n(f["rotations"]).cast("long"))


def _issue(frames: Column, joints: Column, rotated: Column) -> Column:
    return F.when(F.coalesce(frames < 1, F.lit(True)), "no_frames").when(F.coalesce(joints < 1, F.lit(True)), "no_joints").when(F.coalesce(rotated < joints, F.lit(True)), "bad_frame")


def animations(spark: SparkSession, path: str | list[str], default_rate: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects): one row a file; every frame needs rotations of all joints, flat or nested.

    The document is bound by ``let``: written out in the check of a frame, it would be parsed anew for each of them.
    """
    issue = let(parse_animation("value"))(lambda d: _issue(F.size(d["frames"]), F.size(d["joint_names"]), F.array_min(F.transform(d["frames"], _rotated))))
    checked = spark.read.text(path, wholetext=True).select(document().alias("clip_id"), parse_animation("value").alias("d"), issue.alias("issue"))
    good = checked.where("issue is null").select("clip_id", _rate(F.col("d.frame_rate"), default_rate).alias("frame_rate"), F.col("d.joint_names").alias("joint_names"), F.col("d.frames").alias("frames"))
    return good, checked.where("issue is not null").select("clip_id", "issue")


@dataclass(frozen=True)
class Clips:
    """documents: clip_id, frame_rate, joint_names; frames: clip_id, joint_names, frame, f; rejects: clip_id, issue."""

    documents: DataFrame
    frames: DataFrame
    rejects: DataFrame


def _lined(lines: DataFrame, default_rate: float) -> DataFrame:
    """Of each file whose frames stand on lines of their own one row: _file, clip_id, frame_rate, joint_names, issue.

    The first line is the document up to the opened list of frames, the last one closes it. Each line between is one object without
    another inside, behind a comma but for the first. All must parse by themselves; a file with any other line isn't among the rows.
    """
    at, value = F.col("line_no"), F.col("value")
    broken = {"columnNameOfCorruptRecord": "broken"}
    parsed = lambda text, kind: F.from_json(text, f"{kind[:-1]},broken:string>", broken)
    body = F.regexp_extract(value, r"^,?(\{[^{}]*\})$", 1)
    head = F.when((at == 0) & value.rlike(r'^\{[^{}]*"frames" ?: ?\[$'), parsed(F.concat(value, F.lit("]}")), ANIMATION))
    f = F.when((at > 0) & (body != "") & (F.startswith(value, F.lit(",")) == (at > 1)), parsed(body, FRAME))
    read = lines.select("_file", "file_name", "line_no", (value == "]}").alias("end"), head.alias("head"), let(f)(lambda f: F.when(f.isNotNull() & f["broken"].isNull(), _rotated(f))).alias("rotated"))
    sound = F.col("end") | (F.col("head").isNotNull() & F.col("head.broken").isNull()) | F.col("rotated").isNotNull()
    files = read.groupBy("_file", F.col("file_name").alias("clip_id")).agg(
        F.min(F.coalesce(sound, F.lit(False))).alias("_sound"), F.max("line_no").alias("_last"), F.count(F.when(F.col("end"), 1)).alias("_ends"), F.max(F.when(F.col("end"), F.col("line_no"))).alias("_end"),
        F.first("head", ignorenulls=True).alias("head"), F.min("rotated").alias("rotated"),
    )
    whole = files.where("_sound and _ends = 1 and _end = _last and _last > 1 and head is not null")
    issue = _issue(F.col("_last") - 1, F.size("head.joint_names"), F.col("rotated"))
    return whole.select("_file", "clip_id", _rate(F.col("head.frame_rate"), default_rate).alias("frame_rate"), F.col("head.joint_names").alias("joint_names"), F.col("_last").alias("_last"), issue.alias("issue"))


def clips(spark: SparkSession, path: str, default_rate: float = 30.0) -> Clips:
    """Documents below ``path``, a row for each frame; checks and issues are those of ``animations``."""
    scan = text_lines(spark, path)
    lines = Blocks.of(scan).numbered(scan)
    lined = materialised(_lined(lines, default_rate))  # one row a file
    known = {r[0] for r in lined.select("_file").collect()}
    good, bad = lined.where("issue is null"), lined.where("issue is not null").select("clip_id", "issue")
    heads = good.select(F.col("_file").alias("_f"), "clip_id", "joint_names", "_last")
    heads = F.broadcast(heads) if len(known) <= HEADS else heads
    met = lines.join(heads, F.col("_file") == F.col("_f")).where("line_no > 0 and line_no < _last")
    found = Clips(
        good.select("clip_id", "frame_rate", "joint_names"),
        met.select("clip_id", "joint_names", (F.col("line_no") - 1).cast("int").alias("frame"), F.from_json(F.regexp_replace("value", "^,", ""), FRAME).alias("f")),
        bad,
    )
    files = [re.sub("^file:/+", "file:/", f) for f in spark.read.text(path).inputFiles()]  # as ``_metadata.file_path`` writes it
    others = [re.sub(r"([*?\[\]{}\\])", r"\\\1", unquote(f)) for f in files if f not in known]
    if not others:
        return found
    documents, rejects = animations(spark, others, default_rate)
    own = Clips(documents.drop("frames"), exploded(documents), rejects)
    return own if not known else Clips(found.documents.union(own.documents), found.frames.union(own.frames), found.rejects.union(own.rejects))


def exploded(documents: DataFrame) -> DataFrame:
    """clip_id, joint_names, frame, f of documents that are rows."""
    return documents.select("clip_id", "joint_names", F.posexplode("frames").alias("frame", "f"))


def frame_rotations(frames: DataFrame) -> DataFrame:
    """clip_id, frame, joint, name, q (xyzw array) of every joint in every frame."""
    joints = frames.select("clip_id", "frame", "f", F.posexplode("joint_names").alias("joint", "name"))
    return joints.select("clip_id", "frame", "joint", "name", frame_rotation(F.col("f"), F.col("joint")).alias("q"))


def rotations(documents: DataFrame) -> DataFrame:
    """``frame_rotations`` of documents that are rows."""
    return frame_rotations(exploded(documents))


def roots(documents: DataFrame) -> DataFrame:
    return exploded(documents).select("clip_id", "frame", F.col("f.root_position").alias("root"))
