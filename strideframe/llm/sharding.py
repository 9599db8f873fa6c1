"""Sharding by vector bin packing: bytes, tokens and rows of the shards are balanced together.

Documents of equal text form a group and share a shard. A group that is more than a fixed part of a
shard's share in any of the three measures is split by row, because one group may hold a third of
all rows. What the driver packs has a proven bound: groups and parts above ``1/64`` of a shard's share
(at most ``3 * 64 * shards``, parts included) stand alone, all others are gathered by hash in
``1024 * shards`` cells. Items go largest first to the shard where the dot product of the item with the
residual capacity is highest among those with room.

Edge cases: null text has no bytes beyond the fixed 8 and forms one group; an empty table gives no rows;
repeated rows get slots of their own; other columns are ignored. Ties go to the smaller shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MEASURES = ("bytes", "tokens", "rows")


def place(items: list[tuple], shards: int) -> list[int]:
    """The shard of each item (bytes, tokens, rows), by dot product with residual capacity."""
    if not items:
        return []
    sizes = np.array(items, float)
    share = np.maximum(sizes.sum(axis=0) / shards, 1e-9)
    wanted = sizes / share
    residual, out = np.ones((shards, wanted.shape[1])), [0] * len(items)
    for i in np.lexsort((np.arange(len(items)), -wanted.max(axis=1))).tolist():
        score = residual @ wanted[i]
        room = (residual >= wanted[i] - 1e-12).all(axis=1)
        if room.any():
            score = np.where(room, score, -np.inf)
        at = int(np.argmax(score))
        residual[at] -= wanted[i]
        out[i] = at
    return out


def slotted(df: DataFrame, shard: str, *order: str) -> DataFrame:
    """``slot``: gapless from 0 in each shard; ranked in hash buckets whose counts are summed."""
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(common.width(df.sparkSession))))
    counts = dealt.groupBy(shard, "_bucket").count()
    before = counts.select(shard, "_bucket", (F.sum("count").over(Window.partitionBy(shard).orderBy("_bucket")) - F.col("count")).alias("_before"))
    row = F.row_number().over(Window.partitionBy(shard, "_bucket").orderBy(*order))
    return dealt.withColumn("_row", row).join(before, [shard, "_bucket"]).withColumn("slot", F.col("_before") + F.col("_row") - 1).drop("_bucket", "_row", "_before")


def shard(docs: DataFrame, shards: int = 24, alone: int = 64, cells: int = 1024, split: int = 16) -> DataFrame:
    """doc_id, size, tokens, text_crc32, law, shard, slot and grown_shard of each document.

    alone: groups above 1/alone of a shard's share are packed singly. cells: hash cells a shard for the
    rest. split: groups above 1/split of a shard's share are dealt out in parts of about that size.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    narrow = common.written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.regexp_count(text, F.lit(common.WORD)).cast("long").alias("tokens"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text, F.col("text").isNull()).alias("_group"),
            F.monotonically_increasing_id().alias("_n"),  # written, so it stays; tells equal rows apart
        ),
        "sharding",
    )
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    groups = common.written(narrow.groupBy("_group").agg(*sums), "sharding-groups")
    total = groups.agg(*(F.sum(m).alias(m) for m in MEASURES)).first()
    share = {m: common.scalar(total[m]) / shards for m in MEASURES}
    weight = F.greatest(*(F.col(m) / F.lit(max(share[m], 1e-9)) for m in MEASURES))
    large = groups.withColumn("_weight", weight).where(F.col("_weight") > 1 / alone)
    parts = large.select("_group", F.greatest(F.lit(1), F.ceil(F.col("_weight") * split)).cast("int").alias("_parts"))
    parts = spark.createDataFrame(parts.collect() or [], "_group long, _parts int")  # at most 3 * alone * shards rows
    with_part = narrow.join(F.broadcast(parts), "_group", "left").withColumn("_part", F.expr("pmod(xxhash64(doc_id, _n), _parts)"))
    cell = F.pmod(F.xxhash64(F.col("_group"), F.lit(1)), F.lit(shards * cells))
    # both have a bounded number of rows; their order makes runs agree
    single = with_part.where("_parts is not null").groupBy("_group", "_part").agg(*sums).orderBy("_group", "_part").collect()
    gathered = groups.join(F.broadcast(parts), "_group", "left_anti").groupBy(cell.alias("_cell")).agg(*(F.sum(m).alias(m) for m in MEASURES)).orderBy("_cell").collect()
    homes = place([tuple(r[m] for m in MEASURES) for r in [*single, *gathered]], shards)
    of_part = spark.createDataFrame([(r["_group"], r["_part"], h) for r, h in zip(single, homes)], "_group long, _part long, _home_part int")
    of_cell = spark.createDataFrame([(r["_cell"], h) for r, h in zip(gathered, homes[len(single) :])], "_cell long, _home_cell int")
    placed = with_part.withColumn("_cell", cell).join(F.broadcast(of_part), ["_group", "_part"], "left").join(F.broadcast(of_cell), "_cell", "left")
    placed = placed.withColumn("shard", F.when(F.col("_parts").isNotNull(), F.col("_home_part")).otherwise(F.col("_home_cell")))
    out = slotted(placed.select("doc_id", "size", "tokens", "text_crc32", "shard", "_n"), "shard", "doc_id", "text_crc32", "_n")
    return out.select("doc_id", "size", "tokens", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
