"""Events to recordings: name index, unique match, edge cases and issues (JOIN01-JOIN03, JOIN06, SET01-SET04)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_name, fixture_sides
from .contained import containing

#: Pairs of team keys, and the part of the file name to look for.
EDGE_CASES = (
    ("hbw_balingen_weilstetten", "thsv_eisenach", "HBW_Balingen-Weilstetten_vs_T"),
    ("hbw_balingen_weilstetten", "frisch_auf_goeppingen", "HBW_Balingen-Weilstetten_vs_F"),
    ("hbw_balingen_weilstetten", "hsv_hamburg", "HBW_Balingen-Weilstetten_vs_H"),
    ("hbw_balingen_weilstetten", "sg_flensburg_handewitt", "HBW_Balingen-Weilstetten_vs_S"),
    ("sg_flensburg_handewitt", "sc_dhfk_leipzig", "SG_Flensburg-Handewitt_vs_SC_"),
    ("frisch_auf_goeppingen", "sc_dhfk_leipzig", "Frisch_Auf!_Goeppingen_vs_SC_"),
)


def fixture_index(files: DataFrame, name: str = "file_name") -> tuple[DataFrame, DataFrame]:
    """home_key, away_key, files (sorted names) of readable names; and the issues of the others."""
    home, away, issue = fixture_sides(name)
    parsed = files.select(F.col(name).alias("file_name"), home.alias("home_key"), away.alias("away_key"), issue.alias("issue"))
    index = parsed.where("issue is null").groupBy("home_key", "away_key").agg(F.array_sort(F.collect_list("file_name")).alias("files"))
    return index, parsed.where("issue is not null").select("issue")


def resolve(events: DataFrame, index: DataFrame, edge_cases=EDGE_CASES) -> DataFrame:
    """``events`` with ``fixture_file`` or ``issue``: the one file of both teams; an edge case where there is
    none; several files or none at all are issues. The index has a row for each pair of teams.
    """
    keyed = events.withColumn("home_key", canonical_name("home_team")).withColumn("away_key", canonical_name("away_team"))
    spark = events.sparkSession
    edges = spark.createDataFrame(list(edge_cases), "home_key string, away_key string, fragment string")
    # the few edge cases look their file up once; names come in order of the index
    listed = index.select(F.explode("files").alias("file"))
    named = containing(listed, "file", edges, "fragment").groupBy("home_key", "away_key").agg(F.min("file").alias("edge_file"))
    out = keyed.join(index, ["home_key", "away_key"], "left").join(F.broadcast(named), ["home_key", "away_key"], "left")
    n = F.coalesce(F.size("files"), F.lit(0))
    issue = F.when(n > 1, F.concat(F.lit("fixture_not_unique:"), F.array_join("files", "|"))).when((n < 1) & F.col("edge_file").isNull(), F.lit("no_fixture_match"))
    file = F.when(n == 1, F.element_at("files", 1)).when(n < 1, F.col("edge_file"))
    return out.withColumn("fixture_file", file).withColumn("issue", issue).drop("files", "edge_file", "home_key", "away_key")


def split_issues(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    return resolved.where("issue is null").drop("issue"), resolved.where("issue is not null")


def not_yet_there(remote: DataFrame, local: DataFrame, name: str) -> DataFrame:
    """Names that one listing has and the other hasn't."""
    return remote.join(local.select(name), name, "left_anti")


def missing(required: list[str], present: list[str]) -> list[str]:
    return [c for c in required if c not in set(present)]
