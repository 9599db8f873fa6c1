"""Packing documents into fixed-length sequences: shortest-pack-first over the length histogram.

A document's ids (end id included) are cut at multiples of the capacity; each cut piece has a length of
1 to ``capacity``. The histogram of lengths (at most ``capacity`` rows, so its size is proven) goes to
the driver. Lengths are placed longest first, each into the open packs that are filled least; equal
packs are one pattern with a count, so the work follows the histogram and not the number of documents.
Pieces of equal length are ranked without gaps and each takes the place that its rank has in the patterns.

Edge cases: null text is empty and has only the end id; repeated rows are packed each; an empty table
gives no rows; other columns are ignored. Ties within a length go by (doc_id, start, crc).
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .encoding import encoder, with_end

CAPACITY = 4096


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of each piece."""
    path = tokenizer or common.tokenizer_path()
    common.bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            doc_ids, texts = common.columns_of(batch, "doc_id", "text")
            for a, z in common.slices(texts, 1 << 20):
                ids, edges = with_end(*code.encode(texts[a:z]), end_id)
                raw = memoryview(ids.astype("<u4").tobytes())
                out: list[tuple] = []
                for d, lo, hi in zip(doc_ids[a:z], edges[:-1].tolist(), edges[1:].tolist()):
                    for s in range(lo, hi, capacity):
                        e = min(s + capacity, hi)
                        out.append((d, s - lo, e - s, zlib.crc32(raw[4 * s : 4 * e]), hi - lo))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int]], int]:
    """Places for all lengths, and the number of sequences.

    A place (length, first_rank, first_sequence, offset) says where the pieces of a length go from that
    rank on, one to a sequence, until the next place of the same length.
    """
    room: list[tuple[int, int, int]] = []  # (-free, first sequence, count): equal packs side by side
    places, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if room and -room[0][0] >= length:
                free, first, count = heapq.heappop(room)
                free = -free
                if count > left:
                    heapq.heappush(room, (-free, first + left, count - left))
                    count = left
            else:
                # no more new packs than all that is left of the length needs
                free, first, count = capacity, sequences, -(-left // (capacity // length))
                sequences += count
            places.append((length, rank, first, capacity - free))
            if free > length:
                heapq.heappush(room, (length - free, first, count))
            rank, left = rank + count, left - count
    return places, sequences


def ranked(found: DataFrame) -> DataFrame:
    """``rank`` of each piece among those of its length, gapless from 0.

    A length may hold a third of all pieces, and so may copies of one document: pieces are ranked in hash buckets,
    parted by the number ``_n`` that each piece was written with, and the buckets' counts are summed.
    """
    spark = found.sparkSession
    dealt = found.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "_n"), F.lit(common.width(spark))))
    counts = dealt.groupBy("length", "_bucket").count()
    # one row for each length and bucket, whatever the number of pieces
    before = counts.select("length", "_bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("count")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32", "_n"))
    return dealt.withColumn("_row", within).join(before, ["length", "_bucket"]).withColumn("rank", F.col("_before") + F.col("_row") - 1).drop("_bucket", "_row", "_before", "_n")


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with sequence_id and offset."""
    found = common.written(pieces(docs, tokenizer, end_id, capacity).withColumn("_n", F.monotonically_increasing_id()), "pieces")  # encoded once, used for histogram and places
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    places, _ = shortest_pack_first(histogram, capacity)
    places.sort()
    shift = 44
    keys = np.array([(p[0] << shift) + p[1] for p in places], np.int64)
    rank0, first, offset = (np.array([p[i] for p in places], np.int64) for i in (1, 2, 3))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = {n: batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            length, rank = table["length"].to_numpy(), batch.column(batch.schema.get_field_index("rank")).to_numpy()
            at = np.searchsorted(keys, (length.astype(np.int64) << shift) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*table.values(), pa.array(first[at] + rank - rank0[at]), pa.array(offset[at])], names=[*table, "sequence_id", "offset"])

    return ranked(found).mapInArrow(placed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def padding(fill: int, capacity: int = CAPACITY) -> int:
    """Ids of padding of a sequence: to the capacity, none where it ends at a power of two."""
    return 0 if fill & (fill - 1) == 0 else capacity - fill
