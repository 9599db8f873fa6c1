"""Language identification by compression with per-language dictionaries.

For each language a raw-content zstandard dictionary is made of passages from a bounded sample of labelled
documents (``SAMPLE_DOCS`` documents a language, ``PASSAGE`` characters each at a place that the hash
decides, ``DICTIONARY_BYTES`` bytes in all). A text's letters (lower case; case, digits and punctuation are
layout, not language) are cut into blocks, whole text, and each block is compressed with every dictionary: the language with the smallest sum is the answer. The relative margin
to the next language is the confidence; a prediction is rejected where it is below ``MARGIN``.

Prediction sees nothing but the text. Edge cases: null texts and texts without a letter are ``und`` with
score 0 and rejected; ties go to the first language in alphabetical order; with one learnt language its
score is 1; with none every text is ``und``; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SAMPLE_DOCS, PASSAGE, DICTIONARY_BYTES = 192, 2048, 64 << 10
BLOCK, LEVEL = 1024, 12
MARGIN = 0.003
OTHER = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


def letters(text: str) -> str:
    """The words of a text as language shows in them: lower case, runs of marks and digits as one space; empty if there is no letter."""
    plain = OTHER.sub(" ", text.lower()).strip()
    return plain if any(map(str.isalpha, plain)) else ""


def dictionaries(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """Raw dictionary content of each language in ``labelled`` (doc_id, text, lang); languages are few."""
    known = labelled.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("_lang"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("_key"))
    # copies count once, so that a text that stands on many rows is sampled once and comes to the driver once
    distinct = known.select("_lang", "_key").distinct().withColumn("_h", F.xxhash64("_key", F.lit(7)))
    top = distinct.withColumn("_r", F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "_key"))).where(F.col("_r") <= sample_docs)
    chosen = F.broadcast(top)  # at most sample_docs rows a language
    start = F.pmod(F.col("_h"), F.greatest(F.length("text") - PASSAGE, F.lit(1))).cast("int")
    passages = known.join(chosen, ["_lang", "_key"]).groupBy("_lang", "_r").agg(F.min(F.substring("text", start + 1, F.lit(PASSAGE))).alias("passage")).orderBy("_lang", "_r").collect()
    out: dict[str, bytes] = {}
    for r in passages:
        held = out.get(r["_lang"], b"")
        if len(held) < DICTIONARY_BYTES:
            out[r["_lang"]] = held + letters(r["passage"]).encode() + b"\n"
    return {k: x[:DICTIONARY_BYTES] for k, x in sorted(out.items())}


class Compressors:
    def __init__(self, contents: dict[str, bytes]):
        import zstandard

        self.languages = sorted(contents)
        self.all = []
        for k in self.languages:
            own = zstandard.ZstdCompressionDict(contents[k] or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=LEVEL)
            self.all.append(zstandard.ZstdCompressor(dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def sizes(self, text: bytes) -> list[int]:
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        return [sum(len(f(b)) for b in blocks) for f in self.all]


def decide(languages: list[str], sizes: list[int]) -> tuple[str, float]:
    """The language of the smallest size, and the margin to the next as a share of the next."""
    if not languages:
        return UNKNOWN, 0.0
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], languages[i]))
    if len(order) == 1:
        return languages[order[0]], 1.0
    best, second = sizes[order[0]], sizes[order[1]]
    return languages[order[0]], (second - best) / max(second, 1)


def predictor(contents: dict[str, bytes], names: tuple[str, str, str]):
    """A function of Arrow text batches for ``predicted``; it holds the dictionaries only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = common.kept(f"languages {hash(tuple(contents.items()))}", lambda: Compressors(contents))
        for batch in batches:
            (texts,) = common.columns_of(batch, "text")
            found = []
            for t in texts:
                plain = letters(t or "")
                found.append(decide(compressors.languages, compressors.sizes(plain.encode())) if plain else (UNKNOWN, 0.0))
            kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n not in names]
            new = [(names[0], pa.array([x for x, _ in found], pa.string())), (names[1], pa.array([y for _, y in found], pa.float64())), (names[2], pa.array([x == UNKNOWN or y < MARGIN for x, y in found], pa.bool_()))]
            yield pa.RecordBatch.from_arrays([x for _, x in kept + new], names=[n for n, _ in kept + new])

    return run


def predicted(docs: DataFrame, contents: dict[str, bytes], *keep: str, names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the language, its margin and whether it is rejected, under ``names`` (which replace columns named so)."""
    common.bounded_batches(docs.sparkSession, 128)
    # names may hold dots, which the exchange with Python doesn't take: plain ones stand for them
    plain = {c: "text" if c == "text" else f"c{i}" for i, c in enumerate(keep)} | ({} if "text" in keep else {"text": "text"})
    rows = docs.select(*(F.col(f"`{c}`").alias(p) for c, p in plain.items()))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    found = rows.mapInArrow(predictor(contents, ("found_lang", "found_score", "found_rejected")), schema + ", found_lang string, found_score double, found_rejected boolean")
    return found.select(*(F.col(p).alias(c) for c, p in plain.items() if c not in names), *(F.col(f"found_{k}").alias(n) for k, n in zip(("lang", "score", "rejected"), names)))
