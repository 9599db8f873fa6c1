"""Session defaults and table loading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", partitions: int = 8, **more: str) -> SparkSession:
    """A session with the settings that the operators are meant for; nulls for bad casts come from ``try_*``."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in more.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialised(df: DataFrame) -> DataFrame:
    """``df`` computed once for what branches off: a checkpoint in the shared folder of ``spark.checkpoint.dir``;
    where that is unset, a cached table, which is computed again where an executor is lost.
    """
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.cache()


_own: list[str] = []


def new_folder(spark: SparkSession, what: str) -> str:
    """A path for a table or files that doesn't exist yet, in the shared folder of ``spark.checkpoint.dir``; where that is
    unset, in a temporary one, on a single machine only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="strideframe-"))
        base = _own[0]
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
