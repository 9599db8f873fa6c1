"""Points and series as JSON, and back (JSN01-JSN05)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ANIMATION, POINT
from .text import _c
from .times import iso_millis

BALL_KEYS = ("t_local", "ts_ms", "x", "y", "z", "v", "a", "dir")


def ball_point(p: Column, t_local: Column | None = None) -> Column:
    """The JSON object of a point struct (local_dt, ts_ms, x, y, z, speed, accel, direction); t_local: its time as text, if at hand."""
    return F.struct((iso_millis(p["local_dt"]) if t_local is None else t_local).alias("t_local"), p["ts_ms"].alias("ts_ms"), p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"), p["speed"].alias("v"), p["accel"].alias("a"), p["direction"].alias("dir"))


def keeper_point(p: Column, t_local: Column | None = None) -> Column:
    return F.struct((iso_millis(p["local_dt"]) if t_local is None else t_local).alias("t_local"), p["ts_ms"].alias("ts_ms"), p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"))


def json_text(x: Column) -> Column:
    """JSON with nulls written out."""
    return F.to_json(x, {"ignoreNullFields": "false"})


def parse_series(x: Column | str) -> Column:
    """array of points; what can't be parsed, even without outer quotes, gives an empty array."""
    s, kind = _c(x), f"array<{POINT}>"
    ready = lambda t: F.when(F.startswith(F.ltrim(t), F.lit("[")), F.from_json(t, kind))
    inner = F.replace(F.btrim(s, F.lit('"')), F.lit('""'), F.lit('"'))
    return F.coalesce(ready(s), ready(inner), F.expr(f"cast(array() as {kind})"))


def parse_point(x: Column | str) -> Column:
    """A point; null for anything but an object."""
    s = _c(x)
    return F.when(F.startswith(F.ltrim(s), F.lit("{")), F.from_json(s, POINT))


def parse_animation(x: Column | str) -> Column:
    return F.from_json(_c(x), ANIMATION)


def frame_rotation(frame: Column, joint: Column) -> Column:
    """Quaternion of a joint in an animation frame: from the flat list, else from the nested one."""
    flat, nested = frame["rotations_flat"], frame["rotations"]
    return F.when(F.size(flat) >= 4 * (joint + 1), F.slice(flat, 4 * joint + 1, 4)).when(F.size(nested) > joint, F.get(nested, joint))
