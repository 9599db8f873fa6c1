"""Explicit schemas; nothing is ever inferred."""

from __future__ import annotations

# Names and order of columns in files, names of fields in documents.
EVENT_COLUMNS = ("id", "home_team", "away_team", "timestamp_local_timezone", "distance", "success", "game_clock", "player_id", "player_name", "name")

BALL_REQUIRED = ("formatted local time", "group name", "x in m", "y in m", "z in m", "speed in m/s", "acceleration in m/s2", "direction of movement in deg", "ts in ms")
KEEPER_REQUIRED = ("formatted local time", "group name", "x in m", "y in m", "z in m", "ts in ms")
KEEPER_NAMES = ("sensor id", "mapped id", "full name")

SHOTS = "id string, player_id string, shot_type string, shot_category string, timestamp_ms string, success string, distance string, speed_ball string, shot_position_x string, shot_position_y string"

POINT = "struct<t_local:string,ts_ms:bigint,x:double,y:double,z:double,v:double,a:double,dir:double>"
FRAME = "struct<root_position:array<double>,rotations:array<array<double>>,rotations_flat:array<double>>"
ANIMATION = f"struct<frame_rate:double,coordinate_system:string,quaternion_format:string,root_joint:string,joint_names:array<string>,frames:array<{FRAME}>>"

RESULT_COLUMNS = (
    "id", "home_team", "away_team", "fixture_file", "player_id", "player_name", "success", "distance", "timestamp_local_timezone", "start_time_local", "end_time_local",
    "release_point_json", "release_time_local", "max_v", "max_a", "release_angle", "trajectory_point_count", "trajectory_json", "goalkeeper_sensor_id", "goalkeeper_trajectory_json", "flags",
)
ISSUE_COLUMNS = ("row_idx", "penalty_id", "home_team", "away_team", "issue")
