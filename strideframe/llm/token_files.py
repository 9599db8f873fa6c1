"""Token-id output: shard files of raw ids with a minimal perfect hash index for keyed access.

File format (one Parquet row is one shard; Parquet because every store that Spark writes to takes it
and its commit protocol survives lost executors). ``payload``: ids end to end, little-endian unsigned,
``id_bytes`` wide (2 where the vocabulary allows, else 4). ``bits``/``level_bits``: the index, a cascade
of bit arrays; a key's slot is the rank of its bit in the first level where it is set. ``fingerprints``
(u32), ``starts`` (u32) and ``lengths`` (u32) are arrays by slot: one probe gives the place of a
document's ids and tells foreign keys apart (chance 2^-32). ``keys``: doc_ids in order, for listing.
``first_id`` and ``last_id`` bound a shard's ids: Parquet's statistics of these two columns lead from a key
to its shard, so that ``lookup`` reads the shards that may hold it and no other.
Shards hold at most ``SHARD_IDS`` ids or one longer document, so memory doesn't grow with the input.

Edge cases: null text is an empty text (only the end id); null doc_id sorts first; equal doc_ids stay
separate documents (the index key is doc_id and its ordinal in the shard), ordered by the text's hash; an empty table writes no
shard and reads back as no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .encoding import encoder, with_end

SHARD_IDS = 1 << 18
GAMMA = 2.0
SHARD_SCHEMA = "part int, shard int, ids_before long, n_ids long, id_bytes int, payload binary, bits binary, level_bits array<int>, fingerprints binary, starts binary, lengths binary, keys binary, n_null int, first_id long, last_id long"


def index_keys(doc_ids: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
    """Distinct 64-bit keys: a bijection of the id, and again for repeated ids by ordinal."""
    base = common.mix64(doc_ids.astype(np.int64).view(np.uint64))
    return np.where(ordinals == 0, base, common.mix64(base ^ ordinals.astype(np.uint64)))


def _level_hash(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (common.mix64(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: about 3.7 bits a key plus ranks made on loading."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.bases = np.concatenate([[0], np.cumsum([int(x.sum()) for x in levels])]).astype(np.int64)
        self.ranks = [np.cumsum(x, dtype=np.int64) - 1 for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left, level = [], np.unique(keys), 0
        while len(left):
            size = max(8, int(GAMMA * len(left)))
            at = _level_hash(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
            level += 1
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot below the number of keys; -1 where no level answers (surely a foreign key)."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = _level_hash(keys[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.bases[level] + self.ranks[level][at[hit]]
            open_ = open_[~hit]
        return out

    def packed(self) -> tuple[bytes, list[int]]:
        return b"".join(np.packbits(x).tobytes() for x in self.levels), [len(x) for x in self.levels]

    @classmethod
    def unpacked(cls, raw: bytes, level_bits: list[int]) -> PerfectHash:
        levels, at = [], 0
        for n in level_bits:
            size = (n + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=n).astype(bool))
            at += size
        return cls(levels)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (common.mix64(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def shard_row(doc_ids: list, ordinals: list[int], ids: np.ndarray, edges: np.ndarray, id_bytes: int) -> dict:
    """One shard of documents in order; ``edges`` are where each document's ids start, and their end."""
    known = [d for d in doc_ids if d is not None]
    nulls = len(doc_ids) - len(known)
    plain = np.array([0 if d is None else d for d in doc_ids], np.int64)
    keys = index_keys(plain, np.array([o + (1 << 40 if d is None else 0) for d, o in zip(doc_ids, ordinals)], np.int64))
    function = PerfectHash.build(keys)
    slot = function.slots(keys)
    by_slot = {}
    for name, values in (("fingerprints", fingerprint(keys)), ("starts", edges[:-1].astype(np.uint32)), ("lengths", np.diff(edges).astype(np.uint32))):
        table = np.zeros(len(keys), np.uint32)
        table[slot] = values
        by_slot[name] = table.tobytes()
    bits, level_bits = function.packed()
    return {"n_ids": int(edges[-1]), "id_bytes": id_bytes, "payload": ids.astype(f"<u{id_bytes}").tobytes(), "bits": bits, "level_bits": level_bits, "keys": plain.tobytes(), "n_null": nulls, "first_id": min(known, default=None), "last_id": max(known, default=None)} | by_slot


class Shard:
    """Keyed access to one shard row."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["payload"], f"<u{row['id_bytes']}")
        self.function = PerfectHash.unpacked(row["bits"], row["level_bits"])
        self.fingerprints, self.starts, self.lengths = (np.frombuffer(row[k], np.uint32) for k in ("fingerprints", "starts", "lengths"))
        self.keys, self.n_null = np.frombuffer(row["keys"], np.int64), row["n_null"]

    def places(self, doc_ids: np.ndarray, ordinals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """found, start and length for each key; constant work a key."""
        keys = index_keys(doc_ids, ordinals)
        slot = self.function.slots(keys)
        safe = np.maximum(slot, 0)
        found = (slot >= 0) & (self.fingerprints[safe] == fingerprint(keys)) if len(self.fingerprints) else np.zeros(len(keys), bool)
        return found, self.starts[safe].astype(np.int64), self.lengths[safe].astype(np.int64)

    def ids_of(self, doc_id: int, ordinal: int = 0) -> np.ndarray | None:
        found, start, length = self.places(np.array([doc_id]), np.array([ordinal]))
        return self.ids[start[0] : start[0] + length[0]] if found[0] else None


def _ordinals(doc_ids: list) -> list[int]:
    """Ordinal of each row among the rows of equal id in its shard, where they lie side by side."""
    out: list[int] = []
    for i, d in enumerate(doc_ids):
        out.append(out[-1] + 1 if i and doc_ids[i - 1] == d else 0)
    return out


def write_shards(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the shard files of ``docs`` (doc_id, text) to the shared folder; the table of shards read back."""
    spark, path = docs.sparkSession, tokenizer or common.tokenizer_path()
    common.bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    # one id may stand on a third of all rows: the text's hash parts them
    rows = rows.repartitionByRange(common.width(spark), F.col("doc_id").asc(), F.xxhash64("text").asc()).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, part = encoder(path), TaskContext.get().partitionId()
        id_bytes = 2 if code.library.get_vocab_size() <= 1 << 16 else 4
        before, number = 0, 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("id_bytes", pa.int32()), ("payload", pa.binary()), ("bits", pa.binary()), ("level_bits", pa.list_(pa.int32())), ("fingerprints", pa.binary()), ("starts", pa.binary()), ("lengths", pa.binary()), ("keys", pa.binary()), ("n_null", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64())])

        def closed() -> pa.RecordBatch:
            nonlocal before, number
            doc_ids = [d for x in held for d in x[0]]
            edges = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[2]) for x in held]))])
            row = shard_row(doc_ids, _ordinals(doc_ids), np.concatenate([x[1] for x in held]), edges, id_bytes)
            row |= {"part": part, "shard": number, "ids_before": before}
            before, number = before + row["n_ids"], number + 1
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=schema)

        size = 0
        for batch in batches:
            doc_ids, texts = common.columns_of(batch, "doc_id", "text")
            for a, z in common.slices(texts, 1 << 20):
                ids, edges = with_end(*code.encode(texts[a:z]), end_id)
                if held and size + len(ids) > shard_ids:
                    yield closed()
                    size = 0
                held.append((doc_ids[a:z], ids, edges))
                size += len(ids)
        if held:
            yield closed()

    return common.written(rows.mapInArrow(shards, SHARD_SCHEMA), "token-shards")


def lookup(shards: DataFrame, doc_ids: list[int]) -> DataFrame:
    """doc_id, part, shard, ordinal and ids of the documents of ``doc_ids`` (a request's few keys), by index.

    Only shards whose range holds a key are read; the perfect hash and the fingerprint give the place.
    Equal ids are listed by shard and ordinal; an id that isn't there gives no row.
    """
    wanted = sorted(set(doc_ids))
    if not wanted:
        return shards.sparkSession.createDataFrame([], "doc_id long, part int, shard int, ordinal int, ids array<long>")
    inside = F.lit(False)
    for d in wanted:
        inside = inside | (F.col("first_id") <= d) & (F.col("last_id") >= d)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard, out = Shard(row), []
                for d in wanted:
                    ordinal = 0
                    while (ids := shard.ids_of(d, ordinal)) is not None:
                        out.append((d, row["part"], row["shard"], ordinal, ids.tolist()))
                        ordinal += 1
                cols = zip(*out) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())))], names=["doc_id", "part", "shard", "ordinal", "ids"])

    return shards.where(inside).mapInArrow(found, "doc_id long, part int, shard int, ordinal int, ids array<long>")


def read_documents(shards: DataFrame) -> DataFrame:
    """Every document from the files, by its key: doc_id, start over all shards, n_tokens, ids_crc32."""
    # one row for each partition written; their number is the session's shuffle partitions
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    begins, at = {}, 0
    for r in totals:
        begins[r["part"]], at = at, at + r["n"]

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                shard = Shard(row)
                doc_ids = [None] * shard.n_null + shard.keys[shard.n_null :].tolist()
                ordinals = _ordinals(doc_ids)
                found, start, length = shard.places(shard.keys, np.array([o + (1 << 40 if d is None else 0) for d, o in zip(doc_ids, ordinals)], np.int64))
                if not found.all():
                    raise ValueError("a shard file doesn't hold a key that it lists")
                raw = memoryview(shard.ids.astype("<u4").tobytes())
                begin = begins[row["part"]] + row["ids_before"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(start + begin, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(start.tolist(), length.tolist())], pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.drop("shard", "n_ids", "first_id", "last_id").mapInArrow(looked_up, "doc_id long, start long, n_tokens long, ids_crc32 long")
