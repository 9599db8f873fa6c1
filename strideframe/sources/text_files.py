"""Lines of text files, cut into blocks that many tasks read, and still numbered as they stand (SRC01-SRC10, SRT04).

Spark reads a text file in blocks of ``spark.sql.files.maxPartitionBytes``. A row's place is its block and its position in
it; how many rows the blocks before hold is known from one row a block (``Blocks``), so numbers are
gapless and in the order of files, blocks and lines without any sort of the rows.

A delimited file can be cut at its line ends unless a quoted field holds one. The pass that counts rows
also looks for lines with an odd number of quotes; files that have one are read whole by the multi-line reader, all
others in blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialised

#: Blocks whose counts may go to all workers, about 100 bytes each; more are joined by an exchange.
BLOCKS = 200_000
FIRST_LINES_AT_ONCE = 16


def first_lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> dict[str, str]:
    """The first line of each file, in the order of their names: some kilobytes of each, whatever its length.

    Read through the file system of the path on the driver, which lists the files for every scan anyway; an empty file has
    an empty line.
    """
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def first(file: str) -> str:
        place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        text = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(place.getFileSystem(conf).open(place), "UTF-8"))
        try:
            return (text.readLine() or "").removeprefix("﻿")
        finally:
            text.close()

    files = sorted(re.sub("^file:/+", "file:/", f) for f in reader.text(path).inputFiles())  # as ``_metadata.file_path`` writes it
    with ThreadPoolExecutor(FIRST_LINES_AT_ONCE) as pool:
        return dict(zip(files, pool.map(first, files)))


def by_header(spark: SparkSession, path: str | list[str], sep: str = ";", glob: str | None = None) -> dict[tuple[str, ...], list[str]]:
    """Files by the columns of their header."""
    found: dict[tuple[str, ...], list[str]] = {}
    for file, line in first_lines(spark, path, glob).items():
        found.setdefault(tuple(c.strip('"') for c in line.split(sep)), []).append(file)
    return found


def document() -> Column:
    """Name of a row's document: its folder's where that is ``clip_id=...`` as the sinks write it, else its file's."""
    folder = F.url_decode(F.regexp_extract("_metadata.file_path", "/clip_id=([^/]*)/[^/]*$", 1))
    return F.coalesce(F.nullif(folder, F.lit("")), "_metadata.file_name")


def _place() -> list:
    return [F.col("_metadata.file_path").alias("_file"), document().alias("file_name"), F.col("_metadata.file_block_start").alias("_block")]


def text_lines(spark: SparkSession, path: str | list[str], glob: str | None = None, blanks: bool = True) -> DataFrame:
    """_file, file_name, _block, _n (grows by one from row to row of a block), value without its line end."""
    reader = spark.read.option("lineSep", "\n")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).text(path).select(*_place(), F.regexp_replace("value", "\r$", "").alias("value"))
    return (rows if blanks else rows.where("trim(value) <> ''")).withColumn("_n", F.monotonically_increasing_id())


@dataclass(frozen=True)
class Blocks:
    """Rows of each block: one row a block, computed once."""

    table: DataFrame

    @classmethod
    def of(cls, *scans: DataFrame, odd: bool = False, headers: bool = False) -> Blocks:
        """Counts of scans of different files. headers: the first row of a file isn't counted. odd: whether a line of the block
        has an odd number of quotes.
        """
        quotes = (lambda: F.max((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2)) if odd else (lambda: F.lit(0))
        counted = reduce(DataFrame.union, [s.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_rows"), F.min("_n").alias("_first"), quotes().alias("_odd")) for s in scans])
        return cls(materialised(counted.withColumn("_head", F.when(F.col("_block") == 0, int(headers)).otherwise(0))))

    def odd_files(self) -> list[str]:
        return [r[0] for r in self.table.where("_odd = 1").select("_file").distinct().collect()]

    def numbered(self, scan: DataFrame) -> DataFrame:
        """``scan`` with ``line_no`` (from 0 in its file, headers included) and ``ordinal`` (from 0 over all files in the order
        of their names, headers left out).

        Fails where Spark has cut the files otherwise than when they were counted (another number of cores may do that, if
        ``spark.sql.files.minPartitionNum`` isn't set): some row's place would lie outside its block.
        """
        before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        order = Window.orderBy("_file", "_block")  # one row a block
        starts = self.table.select(F.col("_file").alias("_f"), F.col("_block").alias("_b"), "_rows", "_first", "_head", before(F.col("_rows"), Window.partitionBy("_file").orderBy("_block")).alias("_line"), (before(F.col("_rows"), order) - before(F.col("_head"), order)).alias("_ord"))
        starts = F.broadcast(starts) if self.table.count() <= BLOCKS else starts
        met = scan.join(starts, (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b")), "left")
        at = F.col("_n") - F.col("_first")
        sound = F.coalesce((at >= 0) & (at < F.col("_rows")), F.lit(False))
        at = F.when(sound, at).otherwise(F.raise_error(F.lit("the files were cut otherwise than when they were counted; set spark.sql.files.minPartitionNum")).cast("long"))
        return met.withColumn("_at", at).withColumn("line_no", F.col("_line") + F.col("_at")).withColumn("ordinal", F.col("_ord") + F.col("_at") - F.col("_head")).drop("_f", "_b", "_rows", "_first", "_head", "_line", "_ord", "_at", "_n", "_block")


def lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """file_name, line_no (from 0 in each file), value; a long file is read by many tasks."""
    scan = text_lines(spark, path, glob)
    return Blocks.of(scan).numbered(scan).select("file_name", "line_no", "value")


def _whole(spark: SparkSession, files: list[str], columns: tuple[str, ...], sep: str) -> DataFrame:
    """Rows of files with line ends in quotes: a file is one block."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.csv(files, schema=schema, sep=sep, header=True, quote='"', escape='"', multiLine=True, enforceSchema=True)
    return rows.select(*_place()[:2], F.lit(0).cast("long").alias("_block"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")).withColumn("_n", F.monotonically_increasing_id())


def delimited(spark: SparkSession, catalogue: dict[tuple[str, ...], Iterable[str]], sep: str = ";") -> list[tuple[tuple[str, ...], DataFrame]]:
    """For each header of ``catalogue`` its columns and the rows of its files: file_name, ordinal, row (a struct of text columns).

    ``ordinal`` numbers the rows of all files of the catalogue, in the order of file names, without gaps.
    """
    scans = {columns: text_lines(spark, list(files), blanks=False) for columns, files in catalogue.items()}
    if not scans:
        return []
    counted = Blocks.of(*scans.values(), odd=True, headers=True)
    broken = set(counted.odd_files())
    parts: list[tuple[tuple[str, ...], DataFrame, bool]] = []
    for columns, files in catalogue.items():
        cut, whole = [f for f in files if f not in broken], [f for f in files if f in broken]
        if cut:
            parts.append((columns, scans[columns] if not whole else text_lines(spark, cut, blanks=False), True))
        if whole:
            parts.append((columns, _whole(spark, whole, columns, sep), False))
    if broken:  # other scans, other blocks
        in_blocks = [p for _, p, cut in parts if cut]
        tables = ([Blocks.of(*in_blocks, headers=True).table] if in_blocks else []) + [Blocks.of(*[p for _, p, cut in parts if not cut]).table]
        counted = Blocks(reduce(DataFrame.union, tables))
    out = []
    for columns, scan, cut in parts:
        rows = counted.numbered(scan)
        if cut:
            schema = ", ".join(f"`{c}` string" for c in columns)
            rows = rows.where("line_no > 0").withColumn("row", F.from_csv("value", schema, {"sep": sep, "quote": '"', "escape": '"'}))
        out.append((columns, rows.select("file_name", "ordinal", "row")))
    return out
