"""Array files (SRC13, SNK05): plain numeric .npy arrays of rank 3 as long tables, and back; objects are never unpickled.

The writer streams a clip's frames to a file of its own and fills the header in at the end, so that a clip of any length needs
no memory. Files get their names when all tasks are done; a run that fails removes what it wrote. It writes by
the file system of the workers: the path must be a folder that they and the driver share.
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import quote, unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

LONG = "clip_id string, frame long, joint int, axis int, value double"


def array_points(spark: SparkSession, path: str) -> DataFrame:
    """clip_id, frame, joint, axis, value of every (frames, joints, axes) array; other files give no rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    a = np.load(io.BytesIO(raw), allow_pickle=False)
                except ValueError:
                    continue
                if a.ndim == 3 and np.issubdtype(a.dtype, np.number):
                    t, j, c = (x.ravel() for x in np.indices(a.shape))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * a.size), pa.array(t.astype(np.int64)), pa.array(j.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(a.astype(np.float64).ravel())], names=["clip_id", "frame", "joint", "axis", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    return files.select(F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B"))).alias("name"), "content").mapInArrow(read, LONG)


HEADER = 128


def header(frames: int, joints: int, axes: int) -> bytes:
    """Head of a version 1.0 file of doubles, always ``HEADER`` bytes long."""
    text = f"{{'descr': '<f8', 'fortran_order': False, 'shape': ({frames}, {joints}, {axes}), }}"
    return b"\x93NUMPY\x01\x00" + (HEADER - 10).to_bytes(2, "little") + text.encode().ljust(HEADER - 11) + b"\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, joints: int, axes: int):
        self.folder, self.joints, self.axes = folder, joints, axes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        files: list[tuple[str, str]] = []
        out, clip, frames = None, None, 0

        def close() -> None:
            out.seek(0)
            out.write(header(frames, self.joints, self.axes))
            out.close()

        try:
            for batch in iterator:
                for name, values in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("clip_id", "points"))):
                    if out is None or name != clip:
                        if out is not None:
                            close()
                        files.append((f"{self.folder}/.{uuid.uuid4().hex}", f"{self.folder}/{quote(name, safe=' ')}.npy"))
                        out, clip, frames = open(files[-1][0], "wb"), name, 0
                        out.write(bytes(HEADER))
                    out.write(np.array([np.nan if v is None else v for v in values], "<f8").tobytes())
                    frames += 1
            if out is not None:
                close()
        except BaseException:
            for temporary, _ in files:
                Path(temporary).unlink(missing_ok=True)
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            for temporary, name in m.files if m else []:
                os.replace(temporary, name)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for temporary, _ in m.files if m else []:
                Path(temporary).unlink(missing_ok=True)


class ArrayFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_files"

    def schema(self) -> str:
        return "clip_id string, points array<double>"

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options["folder"], int(self.options["joints"]), int(self.options["axes"]))


def write_arrays(long: DataFrame, path: str, joints: int, axes: int = 3) -> None:
    """One .npy file for each clip of ``long`` (clip_id, frame, joint, axis, value) with an array (frames, joints, axes); what is
    missing is NaN. Frames stand in order; gaps between them close.
    """
    place = urlparse(path)
    if place.scheme not in ("", "file"):
        raise ValueError("array files are written to folders of the machines' own file system")
    long.sparkSession.dataSource.register(ArrayFiles)
    at = F.map_from_entries(F.collect_list(F.struct((F.col("joint") * axes + F.col("axis")).cast("int").alias("k"), F.col("value").alias("v"))))
    frames = long.groupBy("clip_id", "frame").agg(at.alias("m"))
    rows = frames.select("clip_id", "frame", F.transform(F.sequence(F.lit(0), F.lit(joints * axes - 1)), lambda k: F.try_element_at("m", k)).alias("points"))
    rows = rows.repartition("clip_id").sortWithinPartitions("clip_id", "frame").select("clip_id", "points")
    rows.write.format("npy_files").mode("append").options(folder=unquote(place.path), joints=joints, axes=axes).save()
