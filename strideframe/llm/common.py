"""What the corpus operators share: the shared folder, reading, slicing and word splitting.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one numpy step of an operator works on; batches are cut to it, texts never are.
SLICE_BYTES = 2 << 20
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows and megabytes: documents can be long, so the row count alone must not decide memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: Where tests and single machines keep tables if spark.checkpoint.dir is unset.
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a temporary one does, but on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="strideframe-"))
        found = _own[0]
    return found.rstrip("/")


def free(columns: list[str], *names: str) -> list[str]:
    """Names that no column has, whatever its case: each with as many underscores before it as needed."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        n = f"_{n}"
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
        taken.add(n.lower())
    return out


def written(df: DataFrame, what: str, rows_a_file: int = 0) -> DataFrame:
    """``df`` as a table in the shared folder, read again: cuts lineage, survives lost executors. 0: no limit of rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    """Partitions that a keyed exchange deals out; follows the session, which follows the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with about ``most`` bytes each; a longer text stands alone."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if i > at and held + len(t) > most:
            yield at, i
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield at, len(texts)


def columns_of(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finalizer on unsigned 64-bit integers (xor-shift and multiply)."""
    x = np.asarray(x, np.uint64).copy()
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash; forgets all when it is full, so its memory is bounded."""

    def __init__(self, most: int = 200_000):
        import xxhash

        super().__init__()
        self.most, self.digest = most, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        got = self[word] = self.digest(word)
        return got


#: What a worker process keeps from task to task, by operator; a worker that changes to another one forgets the first's.
_kept: dict[str, object] = {}


def kept(name: str, make):
    """``make()`` once in this process, as long as no other name is asked for."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def word_hashes(texts: Iterable[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of lower-cased (A-Z) texts, end to end, and the words of each text.

    ``bytes.split`` splits at exactly the bytes 20 and 09-0D, ``bytes.lower`` maps exactly A-Z.
    """
    hashes = kept("words", WordHashes)
    parts = [(t or b"").lower().split() for t in texts]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    get = hashes.__getitem__
    flat = np.fromiter(map(get, chain.from_iterable(parts)), np.uint64, int(counts.sum()))
    return flat, counts


def scalar(x) -> int:
    """An aggregate's value, null as 0."""
    return 0 if x is None else int(x)


def crc_bucket(column: str, modulus: int):
    """crc32 of the decimal text of an id, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def tokenizer_path() -> str:
    """Where the public vocabulary lies; STRIDEFRAME_TOKENIZER may name another file."""
    own = os.environ.get("STRIDEFRAME_TOKENIZER")
    if own:
        return own
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
