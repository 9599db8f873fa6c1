"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

Training documents' tokens (words and one end each) are counted as hashed unigrams and bigrams, merged by
key in hash partitions. A count is stored as its level, the number of ``STEPS`` (1, 2, 3, 4, 6, 8, 12, ...)
that it reaches: the items (n-gram, 1) to (n-gram, level) go into the filter segment of the key's
partition and range. A reader probes level after level until one is missing and takes the level's least count; a
false answer is as unlikely for each further level as the filter's error rate. All levels of all unigrams
and bigrams are held, however many there are.

Where the texts' bytes prove that the filter can't exceed ``FILTER_BYTES`` (a token needs two bytes and
adds two items at most) and there are at most ``TABLE_WORDS`` words, filter and exact word counts are
broadcast and texts are scored where they are. A larger filter isn't: texts are written in slices, each
sends its distinct n-grams to the partitions of their keys, once; there they are counted, the segment is
built and probed for them, and levels and word counts come back to the slice. Both ways give the same
results (the tests hold them against each other and against exact counts).

Memory of a task doesn't depend on the corpus or on the session's partitions: a slice has ``SLICE_BYTES`` of
texts, a partition of keys what ``PART_BYTES`` of texts send, and that is merged range by range of keys
(``RANGE_BYTES`` each). Only a single text that is longer than a slice takes more.

Probabilities: P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), P(w | v) = (c(v, w) + M P(w)) / (C(v) + M) where
C(v) is the most that v's level allows, so the masses never add up to more than 1 (false answers aside).
The base score takes the exact word counts.

Edge cases: null text is empty and has only the end; no training documents give N = V = 0; a null
``held_out`` counts as held out; repeated rows are separate documents; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

U = np.uint64
BITS_PER_ITEM, PROBES = 10, 3
FILTER_BYTES = 128 << 20
TABLE_WORDS = 8_000_000
PRIOR = 16.0
ADD = 0.1
END, BEGIN = U(0x6C7967D3A5F10E47), U(0xB1A0C93E5D27F681)
SLICE_BYTES = 4 << 20  # of texts that send their n-grams together
FILE_SLICES = 16  # in a file, as Spark's reader decodes up to 4096 rows of a file at once
PART_BYTES = 16 << 20  # of texts for each partition of keys, if the session has fewer partitions
RANGE_BYTES = 2 << 20  # of texts for each range of a partition's keys; a range is merged at a time
DOC_BYTES = 32  # that a document counts besides its text, so that empty ones are bounded too
HASH_BYTES = 1 << 20  # of texts whose words are Python objects at a time
DROPPED = U(24)  # bits of a key that a partition's number stands for
STEPS = np.array(sorted({1, *(1 << k for k in range(1, 62)), *(3 << k for k in range(61))}), np.int64)


def bigram_keys(tokens: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Keys of (previous, token); ``firsts``: places where a text begins."""
    with np.errstate(over="ignore"):
        before = np.concatenate([[BEGIN], tokens[:-1]])
        before[firsts] = BEGIN
        return common.mix64(before * U(0x9E3779B97F4A7C15) + tokens)


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts end to end, the end token behind each; where each text begins, and the end of all."""
    hashed = [common.word_hashes(texts[a:z]) for a, z in common.slices(texts, HASH_BYTES)]
    words, counts = (np.concatenate(x) for x in zip((np.zeros(0, U), np.zeros(0, np.int64)), *hashed))
    edges = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(int(edges[-1]), END, U)
    keep = np.ones(len(out), bool)
    keep[edges[1:] - 1] = False
    out[keep] = words
    return out, edges


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(STEPS, counts, "right")


def least_count(levels: np.ndarray) -> np.ndarray:
    return np.where(levels > 0, STEPS[np.maximum(levels, 1) - 1], 0).astype(np.float64)


def most_count(levels: np.ndarray) -> np.ndarray:
    return np.where(levels > 0, STEPS[levels] - 1, 0).astype(np.float64)


def item_hash(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and step (32 bits each) of the probes for the items (key, level)."""
    with np.errstate(over="ignore"):
        h = common.mix64(keys + U(level * 0xA24BAED4963EE407 & (1 << 64) - 1))
    return h & U(0xFFFFFFFF), h >> U(32) | U(1)


def probe(begin: np.ndarray, step: np.ndarray, i: int, bits: np.ndarray | np.uint64) -> np.ndarray:
    """Places of probe ``i`` in segments of so many bits (below 2^32)."""
    return (begin + U(i) * step & U(0xFFFFFFFF)) * bits >> U(32)


def range_of(keys: np.ndarray, ranges: int, dropped: np.uint64 = U(0)) -> np.ndarray:
    """Which of so many equal ranges each key is in; ``dropped`` bits of the keys are gone (32 at most)."""
    return ((keys >> U(32) - dropped) * U(ranges) >> U(32)).astype(np.int64)


def segment(keys: np.ndarray, levels: np.ndarray, per_item: int = BITS_PER_ITEM) -> tuple[int, np.ndarray]:
    """Number of bits, and the packed bits of a filter segment that holds the items of ``keys``."""
    size = max(64, per_item * int(levels.sum()))
    bits = np.zeros(size, bool)
    for j in range(1, int(levels.max(initial=0)) + 1):
        begin, step = item_hash(keys[levels >= j] >> DROPPED, j)
        for i in range(PROBES):
            bits[probe(begin, step, i, U(size)).astype(np.int64)] = True
    return size, np.packbits(bits)


class Filter:
    """A filter in memory: a segment for each partition (key modulo their number) and range; ``sizes`` in bits."""

    def __init__(self, sizes: np.ndarray, raw: bytes, ranges: int = 1):
        self.sizes, self.ranges = np.asarray(sizes, np.int64), ranges
        self.offsets = np.concatenate([[0], np.cumsum((self.sizes + 7) // 8 * 8)])[:-1]
        self.bits = np.frombuffer(raw, np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key by repeated probes, 0 where there is none."""
        out, open_ = np.zeros(len(keys), np.int64), np.arange(len(keys))
        if not len(self.sizes):
            return out
        part = (keys % U(len(self.sizes) // self.ranges)).astype(np.int64) * self.ranges + range_of(keys, self.ranges)
        keys, sizes, offsets = keys >> DROPPED, self.sizes.astype(U)[part], self.offsets[part]
        j = 1
        while len(open_):
            begin, step = item_hash(keys[open_] if j > 1 else keys, j)
            for i in range(PROBES):  # what one probe misses isn't probed again
                at = probe(begin, step, i, sizes).astype(np.int64) + offsets
                hit = np.flatnonzero(self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
                if len(hit) < len(open_):
                    open_, begin, step, sizes, offsets = (x[hit] for x in (open_, begin, step, sizes, offsets))
            out[open_] = j
            j += 1
        return out


def _rows(docs: DataFrame, held_out: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.coalesce(F.col(held_out).cast("boolean"), F.lit(True)).alias("held_out"))


class Grams:
    """Distinct n-grams of some texts: unigrams (0) and bigrams (1), sorted by partition, then key."""

    def __init__(self, texts: list[bytes], parts: int):
        self.tokens, self.edges = tokens_of(texts)
        self.keys, self.place, self.bounds = [], [], []
        for found in (self.tokens, bigram_keys(self.tokens, self.edges[:-1])):
            keys, place = np.unique(found, return_inverse=True)
            pid = (keys % U(parts)).astype(np.int64)
            order = np.argsort(pid, kind="stable")
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            self.keys.append(keys[order])
            self.place.append(back[place])
            self.bounds.append(np.searchsorted(pid[order], np.arange(parts + 1)))

    def counts(self, kind: int, learnt: np.ndarray) -> np.ndarray:
        """Occurrences of each n-gram in the texts that are ``learnt``."""
        mine = np.repeat(learnt, np.diff(self.edges))
        return np.bincount(self.place[kind][mine], minlength=len(self.keys[kind]))


def small(counts: np.ndarray) -> bytes:
    """Counts as one byte each; those that don't fit follow with their places."""
    wide = np.flatnonzero(counts > 254)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + wide.astype(np.int64).tobytes() + counts[wide].astype(np.int64).tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    wide = np.frombuffer(raw[n:], np.int64)
    out[wide[: len(wide) // 2]] = wide[len(wide) // 2 :]
    return out


class Smalls:
    """Many ``small`` counts end to end, kept as one byte each and the few that don't fit apart."""

    def __init__(self, raws: list[bytes], lengths: list[int]):
        self.bytes = np.frombuffer(b"".join(memoryview(x)[:n] for x, n in zip(raws, lengths)), np.uint8)
        self.at, self.wide, first = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for x, n in zip(raws, lengths):
            if len(x) > n:
                at, wide = np.frombuffer(x[n:], np.int64).reshape(2, -1)
                self.at.append(first + at)
                self.wide.append(wide)
            first += n
        self.at, self.wide = np.concatenate(self.at), np.concatenate(self.wide)

    def __getitem__(self, places: np.ndarray) -> np.ndarray:
        out = self.bytes[places].astype(np.int64)
        wide = np.flatnonzero(out == 255)
        out[wide] = self.wide[np.searchsorted(self.at, places[wide])]
        return out


def sliced(rows: DataFrame, most: int = SLICE_BYTES) -> DataFrame:
    """slice, arrays doc_id and held_out, and lengths and texts (end to end, zstd): about ``most`` bytes of whole texts in a row."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        at, held, size, pack = TaskContext.get().partitionId() << 32, [], 0, zstandard.ZstdCompressor(level=3)

        def closed() -> pa.RecordBatch:
            doc_ids, texts, flags = zip(*held)
            lengths = np.fromiter(map(len, texts), np.int64, len(texts)).tobytes()
            columns = ((at, pa.int64()), (list(doc_ids), pa.list_(pa.int64())), (list(flags), pa.list_(pa.bool_())), (lengths, pa.binary()), (pack.compress(b"".join(texts)), pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in columns], names=["slice", "doc_id", "held_out", "lengths", "texts"])

        for batch in batches:
            for row in zip(*common.columns_of(batch, "doc_id", "text", "held_out")):
                own = len(row[1]) + DOC_BYTES
                if held and size + own > most:
                    yield closed()
                    at, held, size = at + 1, [], 0
                held.append(row)
                size += own
        if held:
            yield closed()

    return rows.mapInArrow(made, "slice long, doc_id array<long>, held_out array<boolean>, lengths binary, texts binary")


def texts_of(lengths: bytes, packed: bytes) -> list[bytes]:
    import zstandard

    raw, edges = zstandard.ZstdDecompressor().decompress(packed), np.cumsum(np.frombuffer(lengths, np.int64)).tolist()
    return [raw[a:z] for a, z in zip([0, *edges], edges)]


KEYED = "pid int, slice long, n_words int, n_pairs int, words binary, pairs binary, word_counts binary, pair_counts binary"


def keyed(slices: DataFrame, parts: int) -> DataFrame:
    """Distinct n-grams of each slice and their counts in what is learnt, by partition of their keys: words 8 bytes, pairs 5."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, flags, *texts in zip(*common.columns_of(batch, "slice", "held_out", "lengths", "texts")):
                grams = Grams(texts_of(*texts), parts)
                counts = [grams.counts(k, ~np.array(flags, bool)) for k in (0, 1)]
                short = np.ascontiguousarray((grams.keys[1] >> DROPPED).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
                rows = []
                for p in range(parts):
                    (a, b), (c, d) = (x[p : p + 2].tolist() for x in grams.bounds)
                    if a < b or c < d:
                        rows.append((p, number, b - a, d - c, grams.keys[0][a:b].tobytes(), short[c:d].tobytes(), small(counts[0][a:b]), small(counts[1][c:d])))
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["pid", "slice", "n_words", "n_pairs", "words", "pairs", "word_counts", "pair_counts"])

    return slices.select("slice", "held_out", "lengths", "texts").mapInArrow(made, KEYED).repartition(parts, "pid")


COUNTED = "kind int, pid int, slice long, n long, total long, a binary, b binary"


def counted(blobs: DataFrame, answers: bool, per_item: int = BITS_PER_ITEM, ranges: int = 1) -> DataFrame:
    """kind, pid, slice, n, total, a, b: of each partition of keys

    kind 0: n distinct words, total tokens; a keys, b counts (unless ``answers``), a row for each range. kind 1:
    the filter segment of n bits, a (unless ``answers``), a row for each range, whose number is in ``slice``.
    kind 2, with ``answers``: what one slice asked for: a levels of its words and pairs, one byte each, by
    probes of the segments; b counts of its words.
    """

    def merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        common.kept("merging", dict)  # a worker that has split words before forgets them
        pid = key[0].as_py()
        n_words, n_pairs, slices = (table.column(c).to_pylist() for c in ("n_words", "n_pairs", "slice"))
        uni_counts, bi_counts = (Smalls(table.column(c).to_pylist(), n) for c, n in (("word_counts", n_words), ("pair_counts", n_pairs)))
        words, pairs = (b"".join(x.as_buffer() for x in table.column(c)) for c in ("words", "pairs"))
        words, pairs = np.frombuffer(words, U), np.frombuffer(pairs, np.uint8).reshape(-1, 5)

        def wide(places: np.ndarray) -> np.ndarray:
            out = np.zeros((len(places), 8), np.uint8)
            out[:, :5] = pairs[places]
            return out.view("<u8").ravel()

        in_words = range_of(words, ranges).astype(np.uint16)
        in_pairs = np.concatenate([np.zeros(0, np.uint16), *(range_of(wide(np.arange(i, min(i + 65536, len(pairs)))), ranges, DROPPED).astype(np.uint16) for i in range(0, len(pairs), 65536))])
        of_words, of_pairs, asked = np.zeros(len(words), np.uint8), np.zeros(len(pairs), np.uint8), np.zeros(len(words) if answers else 0, np.int64)
        rows = []
        for r in range(ranges):
            at_words, at_pairs = np.flatnonzero(in_words == r), np.flatnonzero(in_pairs == r)
            (uni, uni_at, uni_c), (bi, bi_at, bi_c) = (summed(*x) for x in ((words[at_words], uni_counts[at_words]), (wide(at_pairs), bi_counts[at_pairs])))
            every = np.concatenate([uni, bi << DROPPED])
            size, bits = segment(every, np.concatenate([level(uni_c), level(bi_c)]), per_item)
            known = uni_c > 0
            rows.append((0, pid, -1, int(known.sum()), int(uni_c.sum()), b"" if answers else uni[known].tobytes(), b"" if answers else uni_c[known].tobytes()))
            if not answers:
                rows.append((1, pid, r, size, 0, bits.tobytes(), b""))
            else:
                levels = Filter(np.array([size]), bits.tobytes()).levels(every).astype(np.uint8)
                of_words[at_words], of_pairs[at_pairs] = levels[: len(uni)][uni_at], levels[len(uni) :][bi_at]
                asked[at_words] = uni_c[uni_at]
        i = j = 0
        for number, m, n in zip(slices, n_words, n_pairs) if answers else ():
            rows.append((2, pid, number, m, n, of_words[i : i + m].tobytes() + of_pairs[j : j + n].tobytes(), small(asked[i : i + m])))
            i, j = i + m, j + n
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("kind", "pid", "slice", "n", "total", "a", "b"), zip(*rows), kinds)})

    return blobs.groupBy("pid").applyInArrow(merged, COUNTED)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, which of them each key is, and the sum of each one's counts."""
    found, place = np.unique(keys, return_inverse=True)
    return found, place, np.bincount(place, weights=counts, minlength=len(found)).astype(np.int64)


class WordTable:
    """Exact counts by word hash: sorted keys, 2 bytes a count and the few larger ones apart."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, counts = keys[order], counts[order]
        self.small = np.minimum(counts, 65535).astype(np.uint16)
        self.large_at = np.flatnonzero(counts >= 65535)
        self.large = counts[self.large_at]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        out = self.small[at].astype(np.int64)
        wide = np.flatnonzero(out == 65535)
        out[wide] = self.large[np.searchsorted(self.large_at, at[wide])]
        return np.where(self.keys[at] == keys, out, 0)


def log10s(grams: Grams, words: np.ndarray, pairs: np.ndarray, n: int, v: int, texts: int) -> np.ndarray:
    """log10 of each token's probability after the one before it; ``words`` and ``pairs`` are the levels of distinct n-grams."""
    single = (least_count(words) + ADD) / (n + ADD * (v + 1))
    now = grams.place[0]
    before = np.empty(len(now))
    before[1:] = most_count(words)[now[:-1]]
    before[grams.edges[:-1]] = texts
    pair = np.minimum(least_count(pairs)[grams.place[1]], before)
    return np.log10((pair + PRIOR * single[now]) / (before + PRIOR))


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(doc_ids: list, flags: list, grams: Grams, counts: np.ndarray, words: np.ndarray, pairs: np.ndarray, n: int, v: int, texts: int) -> pa.RecordBatch:
    first = grams.edges[:-1]
    each = np.add.reduceat(log10s(grams, words, pairs, n, v, texts), first)
    base = np.add.reduceat(np.log10((counts + ADD) / (n + ADD * (v + 1)))[grams.place[0]], first)
    known = np.add.reduceat((counts > 0).astype(np.int64)[grams.place[0]], first)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64()), pa.array(flags, pa.bool_()), pa.array(np.diff(grams.edges)), pa.array(known), pa.array(np.full(len(first), n, np.int64)), pa.array(base), pa.array(each)],
        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def score(docs: DataFrame, held_out: str = "held_out", filter_bytes: int = FILTER_BYTES, table_words: int = TABLE_WORDS, per_item: int = BITS_PER_ITEM, part_bytes: int = PART_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Scores of ``docs`` (doc_id, text and the boolean column ``held_out``), learnt from the rows where that is false."""
    spark = docs.sparkSession
    common.bounded_batches(spark, 128)
    rows = _rows(docs, held_out)
    size = F.octet_length("text").cast("long")
    sums = rows.agg(F.sum(size + DOC_BYTES).alias("bytes"), F.sum(F.when(~F.col("held_out"), (size + 1) / 2 + 1)).alias("tokens"), F.count(F.when(~F.col("held_out"), 1)).alias("texts")).first()
    parts = max(common.width(spark), common.scalar(sums["bytes"]) // part_bytes)
    ranges = min(1 + common.scalar(sums["bytes"]) // (parts * range_bytes), 1 << 16)
    texts = common.scalar(sums["texts"])
    if 2 * per_item * common.scalar(sums["tokens"]) <= 8 * filter_bytes:
        counts = common.written(counted(keyed(sliced(rows.where("not held_out")), parts), False, per_item, ranges), "lm-counts")
        n, v = _totals(counts)
        if v <= table_words:
            return _scored_by_broadcast(rows, counts, parts, ranges, n, v, texts)
    slices = common.written(sliced(rows), "lm-slices", FILE_SLICES)
    answers = common.written(counted(keyed(slices, parts), True, per_item, ranges), "lm-answers")
    return _scored_by_segments(slices, answers, parts, *_totals(answers), texts)


def _totals(counts: DataFrame) -> tuple[int, int]:
    """Tokens and distinct words that were learnt from."""
    sums = counts.where("kind = 0").agg(F.sum("total").alias("n"), F.sum("n").alias("v")).first()
    return common.scalar(sums["n"]), common.scalar(sums["v"])


def _scored_by_broadcast(rows: DataFrame, counts: DataFrame, parts: int, ranges: int, n: int, v: int, texts: int) -> DataFrame:
    """Filter (its size is proven by the caller) and word counts go to all workers."""
    spark = rows.sparkSession
    found = counts.where("kind = 1").select("pid", "slice", "n", "a").toArrow()
    raw = {p * ranges + r: (bits, a) for p, r, bits, a in zip(*(found.column(c).to_pylist() for c in ("pid", "slice", "n", "a")))}
    segments = [raw.get(p, (64, bytes(8))) for p in range(parts * ranges)]
    whole = Filter(np.array([bits for bits, _ in segments]), b"".join(a for _, a in segments), ranges)
    exact = counts.where("kind = 0").select("a", "b").toArrow()  # at most 16 * table_words bytes
    join = lambda c, kind: np.frombuffer(b"".join(exact.column(c).to_pylist()), kind)
    shared = spark.sparkContext.broadcast((whole, WordTable(join("a", U), join("b", np.int64))))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = shared.value
        for batch in batches:
            doc_ids, all_texts, flags = common.columns_of(batch, "doc_id", "text", "held_out")
            for a, z in common.slices(all_texts):
                grams = Grams(all_texts[a:z], parts)
                words, pairs = grams.keys
                yield _scored(doc_ids[a:z], flags[a:z], grams, table.counts(words), model.levels(words), model.levels(pairs), n, v, texts)

    return rows.mapInArrow(scored, SCORED)


def _scored_by_segments(slices: DataFrame, answers: DataFrame, parts: int, n: int, v: int, texts: int) -> DataFrame:
    """Each slice meets the answers to its n-grams; sorted, so that a task holds one slice at a time."""

    def finished(own: tuple, found: list[tuple]) -> pa.RecordBatch:
        doc_ids, flags, *texts_packed = own
        grams = Grams(texts_of(*texts_packed), parts)
        levels = [np.zeros(len(k), np.int64) for k in grams.keys]
        counts = np.zeros(len(grams.keys[0]), np.int64)
        for p, a, b in found:
            raw, start = np.frombuffer(a, np.uint8), [x[p] for x in grams.bounds]
            m = grams.bounds[0][p + 1] - start[0]
            levels[0][start[0] : start[0] + m] = raw[:m]
            levels[1][start[1] : start[1] + len(raw) - m] = raw[m:]
            counts[start[0] : start[0] + m] = unpacked(b, m)
        return _scored(doc_ids, flags, grams, counts, *levels, n, v, texts)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found = None, []
        for batch in batches:
            for pid, a, b, *mine in zip(*common.columns_of(batch, "pid", "a", "b", "doc_id", "held_out", "lengths", "texts")):
                if pid < 0:
                    if own is not None:
                        yield finished(own, found)
                    own, found = tuple(mine), []
                else:
                    found.append((pid, a, b))
        if own is not None:
            yield finished(own, found)

    both = slices.withColumn("pid", F.lit(-1)).unionByName(answers.where("kind = 2").select("slice", "pid", "a", "b"), allowMissingColumns=True)
    return both.repartition(parts, "slice").sortWithinPartitions("slice", "pid").mapInArrow(gathered, SCORED)
