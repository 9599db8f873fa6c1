"""Periodic run detection: stretches of words that repeat with a period, four times or more.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of at least
``max(6, 4 * q)`` words, that no neighbouring word extends with that period. A stretch of period p has at
least 3 * p places i with word i equal to word i + p, so every run holds a block of p words that starts
at a multiple of 2 * p and equals the block behind it. Those (period, grid point) pairs form a harmonic grid,
n/2 * ln(n/4) of them for n words; numpy tests all pairs of a slice of texts at once by prefix hashes, and
for what passes finds both ends by binary search on the common extension, again all at once. Words carry
exact numbers, so the runs found are then verified word for word; a text with a run that fails (two
blocks of unequal words with one hash) is searched again by comparing words. Runs found from several grid
points, or with a multiple of their period, have equal ends and are kept once, with the smallest period.

Each text is searched by itself, so nothing is shuffled; a slice holds whole texts of about
``common.SLICE_BYTES``, or one longer text, and the arrays of a slice grow with its words alone.

Edge cases: a null text has no words, as an empty one; other columns, whatever their names, aren't looked
at; equal rows give equal results; an empty table gives an empty one; null ids stay null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

U = np.uint64
#: Odd multiplier of the prefix hashes; hashes are taken modulo 2**64.
BASE = U(0x9FB21C651E98DF25)
TIMES, LEAST = 4, 6
#: (period, grid point) pairs that are tested at once.
PAIRS = 1 << 20

RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def numbered(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, an exact number for every word (equal words, equal numbers), where the texts' words end."""
    words = [t.split() for t in texts]
    known: dict[bytes, int] = {}
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    total = int(ends[-1]) if len(ends) else 0
    return words, np.fromiter((known.setdefault(w, len(known)) for w in chain.from_iterable(words)), np.int64, total), ends


class Hashes:
    """Hashes of any stretch of ``numbers`` from prefix sums of ``x[t] * BASE**t``."""

    def __init__(self, numbers: np.ndarray):
        self.power = np.full(len(numbers) + 1, BASE, U)
        self.power[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        self.sums = np.zeros(len(numbers) + 1, U)
        np.cumsum(common.mix64(numbers.astype(U) + U(1)) * self.power[:-1], out=self.sums[1:])

    def equal(self, at: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Whether the stretch of ``length`` at ``at`` equals, by hash, the one ``period`` further on."""
        c, there = self.sums, at + period
        return (c[at + length] - c[at]) * self.power[period] == c[there + length] - c[there]


def _furthest(most: np.ndarray, holds) -> np.ndarray:
    """For each item the greatest length up to ``most`` that ``holds``; lengths below it hold as well."""
    low, high = np.zeros(len(most), np.int64), most.copy()
    while (open_ := low < high).any():
        middle = (low + high + 1) // 2
        good = holds(middle)
        low, high = np.where(good & open_, middle, low), np.where(good | ~open_, high, middle - 1)
    return low


def _grid(n: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Periods up to a quarter of the longest text and the multiples of twice the period, ``PAIRS`` or one period at a time."""
    first = 1
    while first <= longest // TIMES:
        last, size = first, (n - 1) // (2 * first) + 1
        while last < longest // TIMES and size + (n - 1) // (2 * last + 2) + 1 <= PAIRS:
            last += 1
            size += (n - 1) // (2 * last) + 1
        periods = np.arange(first, last + 1)
        counts = (n - 1) // (2 * periods) + 1
        p = np.repeat(periods, counts)
        yield p, (np.arange(size) - np.repeat(np.cumsum(counts) - counts, counts)) * 2 * p
        first = last + 1


def _plain_runs(numbers: np.ndarray) -> list[tuple[int, int, int]]:
    """start, end, period of the candidates of one text, by comparing words alone."""
    out = []
    for p in range(1, len(numbers) // TIMES + 1):
        same = np.concatenate([[False], numbers[:-p] == numbers[p:], [False]])
        edges = np.flatnonzero(np.diff(same.astype(np.int8)))
        out += [(s, e + p, p) for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()) if e + p - s >= max(LEAST, TIMES * p)]
    return out


def _verified(numbers: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which of the rows (start, end, period) of ``found`` have words a period apart identical throughout."""
    counts = found[:, 1] - found[:, 0] - found[:, 2]
    row = np.repeat(np.arange(len(found)), counts)
    at = found[row, 0] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.bincount(row, numbers[at] != numbers[at + found[row, 2]], len(found)) == 0


def _smallest(found: np.ndarray) -> np.ndarray:
    """One row for each (start, end), that of the smallest period, by start and period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs(numbers: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows start, end, period of all runs of texts whose words lie end to end; by start, then period."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    sizes = ends - starts
    n = len(numbers)
    if not n:
        return np.zeros((0, 3), np.int64)
    start_of, end_of = np.repeat(starts, sizes), np.repeat(ends, sizes)
    found = [np.zeros((0, 3), np.int64)]
    with np.errstate(over="ignore"):
        hashes = Hashes(numbers)
        for p, at in _grid(n, int(sizes.max())):
            keep = end_of[at] - at >= 2 * p
            p, at = p[keep], at[keep]
            keep = (numbers[at] == numbers[at + p]) & (end_of[at] - start_of[at] >= TIMES * p)
            p, at = p[keep], at[keep]
            keep = hashes.equal(at, p, p)
            p, at = p[keep], at[keep]
            if not len(p):
                continue
            ahead = _furthest(end_of[at] - at - p, lambda k: hashes.equal(at, k, p))
            behind = _furthest(at - start_of[at], lambda k: hashes.equal(at - k, k, p))
            stretch = np.column_stack([at - behind, at + p + ahead, p])
            found.append(stretch[stretch[:, 1] - stretch[:, 0] >= np.maximum(LEAST, TIMES * p)])
    every = np.unique(np.concatenate(found), axis=0)
    wrong = every[~_verified(numbers, every)]
    if len(wrong):
        texts = np.unique(np.searchsorted(ends, wrong[:, 0], "right"))
        every = every[~np.isin(np.searchsorted(ends, every[:, 0], "right"), texts)]
        again = [(starts[t] + s, starts[t] + e, p) for t in texts for s, e, p in _plain_runs(numbers[starts[t] : ends[t]])]
        every = np.concatenate([every, np.array(again, np.int64).reshape(-1, 3)])
    return _smallest(every)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed: the words that no run holds behind its first
    period, joined by one space, as UTF-8.
    """
    common.bounded_batches(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = common.columns_of(batch, "doc_id", "text")
            texts = [t or b"" for t in texts]
            for low, high in common.slices(texts):
                words, numbers, ends = numbered(texts[low:high])
                found = runs(numbers, ends)
                within = np.searchsorted(found[:, 0], ends)
                change = np.zeros(len(numbers) + 1, np.int64)
                np.add.at(change, found[:, 0] + found[:, 2], 1)
                np.add.at(change, found[:, 1], -1)
                kept = np.cumsum(change[:-1]) == 0
                listed, joined, at, row = [], [], 0, 0
                for own, end, last in zip(words, ends.tolist(), within.tolist()):
                    listed.append([{"start": s - at, "length": e - s, "period": p} for s, e, p in found[row:last].tolist()])
                    joined.append(b" ".join(own if last == row else [w for w, k in zip(own, kept[at:end]) if k]))
                    at, row = end, last
                fields = (pa.array(ids[low:high], pa.int64()), pa.array(map(len, words), pa.int64()), pa.array(listed, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), pa.array(joined, pa.binary()))
                yield pa.RecordBatch.from_arrays(list(fields), names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(made, RUNS)


def digest(found: DataFrame) -> DataFrame:
    """The longest run (ties: smallest start, then period) and hashes of all runs and of the kept words."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_best"), F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("_lines"), "collapsed")
    length, period = F.col("_best.length"), -F.col("_best.period")
    return rows.select(
        "doc_id", "n_runs", (-F.col("_best.start")).alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"),
        F.sha2("_lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: in one text of ten, as the id's crc32 says, all words from one on repeat the first of them."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h.alias("h"))
    rows = rows.select("doc_id", "text", "h", F.expr("h div 10").alias("g"), F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({common.WORD})"), F.lit(1))).alias("w"))
    n = F.size("w")
    rows = rows.select("doc_id", "text", "g", "w", F.when(n > 0, F.col("g") % n).cast("int").alias("a"))
    rows = rows.select("doc_id", "text", "w", "a", F.expr("cast(1 + (size(w) - a) div (3 + g % 8) as int)").alias("p"))
    repeated = F.array_join(F.transform(F.expr("sequence(0, size(w) - 1)"), lambda i: F.when(i < F.col("a"), F.get("w", i)).otherwise(F.get("w", F.col("a") + (i - F.col("a")) % F.col("p")))), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))
