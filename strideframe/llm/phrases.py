"""Phrase collocation mining: phrases whose words stand together more often than their parts explain, per language.

Four passes over the texts, none of which moves them:

1. Words are counted by 64-bit keys, in the partitions of the keys. What is frequent leaves a bit in a map of
   ``MAP_BITS`` bits, whatever the corpus' size.
2. Pairs whose two words may be frequent are counted likewise and leave a second map.
3. The candidates: words and pairs that the maps let pass and longer phrases whose two halves (all but the last, all
   but the first word) pass. No phrase that is frequent itself can fail (Apriori: its parts are at
   least as frequent; a map errs only towards more). They go, as text with their counts, to
   the partition of their key. There a minimal perfect hash over the candidates gives each a slot;
   the phrase stored in the slot is compared, so that counts are exact whatever the keys; numpy sums the
   counts by slot, a bounded block of mappers' rows at a time, and the block's arrays add up.
4. The frequent ones stand in index rows (hash, phrases and counts by slot). Each row asks the rows
   of its phrases' parts, every part once whatever the number of phrases that hold it, and reads the counts by slot.

Mappers gather about ``common.BATCH_BYTES`` of one language's texts before they count, so a row that is sent is a
sum already; a word of a third of all places is one number in each. Scores are whole numbers of any size.

Edge cases: a null text is empty; a null language is ``und``, together with documents labelled so; an empty
table gives no rows; ids and other columns aren't looked at; repeated rows count as often as they stand there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .token_files import PerfectHash

U = np.uint64
#: Bits of a map: 16 MB each on every worker. A full map lets more candidates pass, never fewer.
MAP_BITS = 1 << 27
#: Text bytes for which one partition of keys stands; partitions follow the session where that gives more.
PART_BYTES = 32 << 20
#: Phrases summed at once.
BLOCK = 1 << 18
#: Text bytes that a mapper holds over all languages before it counts the largest.
HELD_BYTES = 4 * common.BATCH_BYTES
LONGEST, LEAST, WITHIN, TOP = 3, 10, 50, 2000

#: Lower case for A-Z; what ends a piece becomes a line feed, a tab a space.
_FORM = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0b\x0c\x0d\x09", bytes(range(97, 123)) + b"\n" * 9 + b" ")


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Words:
    """Numbers of the words of some texts of one language, pieces apart by 1, and a key for each word."""

    def __init__(self, lang: str, texts: list[bytes]):
        import xxhash

        known = _Numbers({b"": 0, b"\n": 1})
        tokens = b"\n".join(texts).translate(_FORM).replace(b"\n", b" \n ").split(b" ")
        at = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        self.at = at[at > 0]
        self.list = list(known)
        own = U(xxhash.xxh3_64_intdigest(lang.encode()))
        self.keys = common.mix64(np.fromiter(map(xxhash.xxh3_64_intdigest, self.list), U, len(self.list)) ^ own)

    def phrases(self, maps: list[Map]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For one word, two and so on: keys and counts of the distinct phrases, and a place where each starts.

        With the maps of the shorter phrases given; phrases of more than two words are
        those both of whose halves passed as well. Ends after one level beyond the maps, and at ``LONGEST``.
        """
        code, good, keys = self.at, self.at > 1, self.keys
        for k in range(1, LONGEST + 1):
            place = np.flatnonzero(good)
            distinct, first, which, counts = np.unique(code[place], return_index=True, return_inverse=True, return_counts=True)
            if k == 1:
                keys = self.keys[distinct]
            else:
                with np.errstate(over="ignore"):
                    keys = common.mix64(keys[distinct >> 32] * U(0x9E3779B97F4A7C15) + self.keys[distinct & 0xFFFFFFFF] + U(k))
            passing = maps[k - 1].holds(keys) if k <= len(maps) else np.ones(len(keys), bool)
            yield keys[passing], counts[passing], place[first[passing]]
            if k > len(maps):
                return
            go, number = np.zeros(len(self.at), bool), np.zeros(len(self.at), np.int64)
            go[place], number[place] = passing[which], which
            good, code = np.zeros(len(self.at), bool), np.zeros(len(self.at), np.int64)
            good[:-1] = go[:-1] & go[1:]
            code[:-k] = number[:-k] << 32 | self.at[k:]

    def text(self, start: int, k: int) -> bytes:
        return b" ".join([self.list[w] for w in self.at[start : start + k].tolist()])


class Map:
    """A bit map of keys, one segment of equal size for each partition of keys."""

    def __init__(self, parts: int, bits: np.ndarray):
        self.parts, self.bits, self.segment = parts, bits, len(bits) // parts

    @staticmethod
    def places(keys: np.ndarray, parts: int, segment: int) -> np.ndarray:
        """Bit of each key in a segment of so many bytes."""
        return (keys // U(parts) % U(8 * segment)).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        bit = Map.places(keys, self.parts, self.segment)
        return self.bits[part_of(keys, self.parts) * self.segment + (bit >> 3)] >> (bit & 7).astype(np.uint8) & 1 == 1


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys % U(parts)).astype(np.int64)


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, some megabytes at a time."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    total = 0
    for batch in batches:
        for lang, text in zip(*common.columns_of(batch, "lang", "text")):
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
            total += len(text)
            if size[lang] >= common.BATCH_BYTES or total > HELD_BYTES:
                most = max(size, key=size.get)
                total -= size.pop(most)
                yield most, held.pop(most)
    yield from held.items()


def dealt(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Partitions that get keys, and which."""
    part = part_of(keys, parts)
    order = np.argsort(part, kind="stable")
    edges = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])
    for p in range(parts):
        if edges[p] < edges[p + 1]:
            yield p, order[edges[p] : edges[p + 1]]


def _packed(counts: np.ndarray) -> bytes:
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32).tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if len(raw) == n else np.uint32).astype(np.int64)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def frequent(texts: DataFrame, maps: list, parts: int, least: int, map_bits: int = MAP_BITS) -> Map:
    """The map of the phrases, one word longer than those of ``maps``, that stand in the texts ``least`` times or more."""
    out = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
    segment = max(1, map_bits // 8 // parts)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Map(parts, np.frombuffer(m.value, np.uint8)) for m in maps]
        for lang, own in by_language(batches):
            *_, (keys, counts, _) = Words(lang, own).phrases(known)
            rows = [(p, keys[i].tobytes(), _packed(counts[i])) for p, i in dealt(keys, parts)]
            if rows:
                yield _rows(rows, out)

    def bits(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = [np.frombuffer(x.as_py(), U) for x in table.column("keys")]
        counts = [_unpacked(x.as_py(), len(k)) for x, k in zip(table.column("counts"), found)]
        keys, which = np.unique(np.concatenate(found), return_inverse=True)
        total = np.bincount(which, np.concatenate(counts))
        bit = Map.places(keys[total >= least], parts, segment)
        own = np.zeros(segment, np.uint8)
        np.bitwise_or.at(own, bit >> 3, np.left_shift(1, bit & 7).astype(np.uint8))
        return pa.table({"part": [key[0].as_py()], "bits": pa.array([own.tobytes()], pa.binary())}, schema=pa.schema([("part", pa.int32()), ("bits", pa.binary())]))

    counted = texts.mapInArrow(sent, "part int, keys binary, counts binary").groupBy("part").applyInArrow(bits, "part int, bits binary")
    whole = np.zeros((parts, segment), np.uint8)
    for row in counted.collect():  # map_bits in all; rows taken one by one would run the partitions one after the other
        whole[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return Map(parts, whole.ravel())


class Slots:
    """A slot for each of some distinct phrases, by a minimal perfect hash of their keys; the phrase is stored there.

    Phrases with one key (chance 2**-64 a pair) get slots of their own behind the others.
    """

    def __init__(self, phrases: list[bytes]):
        keys, first = np.unique(self.keys(phrases), return_index=True)
        self.function = PerfectHash.build(keys)
        self.stored: list[bytes] = [b""] * len(keys)
        for slot, i in zip(self.function.slots(keys).tolist(), first.tolist()):
            self.stored[slot] = phrases[i]
        self.more: dict[bytes, int] = {}
        if len(keys) < len(phrases):
            rest = sorted(set(phrases) - set(self.stored))
            self.more = {p: len(keys) + i for i, p in enumerate(rest)}
            self.stored += rest

    @staticmethod
    def keys(phrases: list[bytes]) -> np.ndarray:
        import xxhash

        return np.fromiter(map(xxhash.xxh3_64_intdigest, phrases), U, len(phrases))

    def of(self, phrases: list[bytes]) -> np.ndarray:
        """Slots; -1 for a phrase that isn't stored."""
        slots = self.function.slots(self.keys(phrases))
        stored = self.stored
        return np.fromiter((s if s >= 0 and stored[s] == p else self.more.get(p, -1) for s, p in zip(slots.tolist(), phrases)), np.int64, len(phrases))


INDEX = "lang string, part int, phrases binary, counts binary"


def index(texts: DataFrame, maps: list, parts: int, least: int) -> DataFrame:
    """Exact counts of all phrases that stand in the texts ``least`` times or more: rows of phrases (by slot) and counts."""
    out = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("phrases", pa.binary()), ("counts", pa.binary())])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Map(parts, np.frombuffer(m.value, np.uint8)) for m in maps]
        for lang, own in by_language(batches):
            words = Words(lang, own)
            for k, (keys, counts, starts) in enumerate(words.phrases(known), 1):
                rows = [(lang, p, b"\n".join([words.text(s, k) for s in starts[i].tolist()]), _packed(counts[i])) for p, i in dealt(keys, parts)]
                if rows:
                    yield _rows(rows, out)

    def summed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lists = [x.as_py().split(b"\n") for x in table.column("phrases")]
        counts = [_unpacked(x.as_py(), len(p)) for x, p in zip(table.column("counts"), lists)]
        slots = Slots(list({p: None for phrases in lists for p in phrases}))
        total = np.zeros(len(slots.stored), np.int64)
        block: list[bytes] = []
        weights: list[np.ndarray] = []
        for phrases, own in zip([*lists, None], [*counts, None]):
            if phrases is None or len(block) + len(phrases) > BLOCK and block:
                total += np.bincount(slots.of(block), np.concatenate(weights), len(total)).astype(np.int64)
                block, weights = [], []
            if phrases is not None:
                block += phrases
                weights.append(own)
        kept = np.flatnonzero(total >= least)
        rows = [(key[0].as_py(), key[1].as_py(), b"\n".join([slots.stored[i] for i in kept.tolist()]), total[kept].tobytes())] if len(kept) else []
        return pa.Table.from_batches([_rows(rows, out)])

    return texts.mapInArrow(sent, INDEX).groupBy("lang", "part").applyInArrow(summed, INDEX)


def _held(row: dict) -> tuple[list[bytes], np.ndarray]:
    return row["phrases"].split(b"\n"), np.frombuffer(row["counts"], np.int64)


def _asked(phrases: list[bytes], lang: str, parts: int) -> list[list[bytes]]:
    """What the phrases of an index row ask of each partition: the parts of their cuts, each once."""
    seen: dict[bytes, None] = {}
    for p in phrases:
        words = p.split(b" ")
        for k in range(1, len(words)):
            seen[b" ".join(words[:k])] = seen[b" ".join(words[k:])] = None
    wanted = list(seen)
    lists: list[list[bytes]] = [[] for _ in range(parts)]
    for w, p in zip(wanted, part_of(phrase_keys(lang, wanted), parts).tolist()):
        lists[p].append(w)
    return lists


def phrase_keys(lang: str, phrases: list[bytes]) -> np.ndarray:
    """The keys that ``Words.phrases`` gives to phrases of up to ``LONGEST`` words."""
    import xxhash

    own = U(xxhash.xxh3_64_intdigest(lang.encode()))
    words = [p.split(b" ") for p in phrases]
    out = np.zeros(len(phrases), U)
    with np.errstate(over="ignore"):
        for k in range(1, LONGEST + 1):
            at = np.flatnonzero(np.fromiter((len(w) >= k for w in words), bool, len(words)))
            key = common.mix64(np.fromiter((xxhash.xxh3_64_intdigest(words[i][k - 1]) for i in at.tolist()), U, len(at)) ^ own)
            out[at] = key if k == 1 else common.mix64(out[at] * U(0x9E3779B97F4A7C15) + key + U(k))
    return out


ASKED = "lang string, part int, source int, phrases binary"
ANSWERS = "lang string, part int, target int, counts binary"
SCORED = "lang string, phrase string, words int, a long, l long, r long, score long, cut int"


def scored(rows: DataFrame, parts: int) -> DataFrame:
    """Every phrase of two words or more in the index with the cut of lowest score (ties: the earliest cut)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("source", pa.int32()), ("phrases", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                lists = _asked(_held(row)[0], row["lang"], parts)
                asked = [(row["lang"], p, row["part"], b"\n".join(x)) for p, x in enumerate(lists) if x]
                if asked:
                    yield _rows(asked, out)

    def answer(key: tuple[pa.Scalar, ...], own: pa.Table, asked: pa.Table) -> pa.Table:
        out = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("target", pa.int32()), ("counts", pa.binary())])
        answers = []
        if asked.num_rows:
            phrases, counts = _held(own.to_pylist()[0])
            slots = Slots(phrases)
            by_slot = np.zeros(len(counts), np.int64)
            by_slot[slots.of(phrases)] = counts
            for source, raw in zip(asked.column("source").to_pylist(), asked.column("phrases")):
                at = slots.of(raw.as_py().split(b"\n"))
                if (at < 0).any():
                    raise AssertionError("a part of a frequent phrase isn't frequent")
                answers.append((key[0].as_py(), source, key[1].as_py(), by_slot[at].tobytes()))
        return pa.Table.from_batches([_rows(answers, out)])

    def score(key: tuple[pa.Scalar, ...], own: pa.Table, answers: pa.Table) -> pa.Table:
        lang, out = key[0].as_py(), pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64()), ("score", pa.int64()), ("cut", pa.int32())])
        phrases, counts = _held(own.to_pylist()[0])
        lists, count = _asked(phrases, lang, parts), {}
        for target, raw in zip(answers.column("target").to_pylist(), answers.column("counts")):
            count.update(zip(lists[target], np.frombuffer(raw.as_py(), np.int64).tolist()))
        made = []
        for p, a in zip(phrases, counts.tolist()):
            words = p.split(b" ")
            cuts = []
            for k in range(1, len(words)):
                left, right = count[b" ".join(words[:k])], count[b" ".join(words[k:])]
                cuts.append((1_000_000 * a * a // (left * right), k, left, right))
            if cuts:
                least, k, left, right = min(cuts)
                made.append((lang, p.decode(), len(words), a, left, right, least, k))
        return pa.Table.from_batches([_rows(made, out)])

    def meet(other: DataFrame, f, schema: str) -> DataFrame:
        return rows.groupBy("lang", "part").cogroup(other.groupBy("lang", "part")).applyInArrow(f, schema)

    return meet(meet(rows.mapInArrow(ask, ASKED), answer, ANSWERS), score, SCORED)


def mine(docs: DataFrame, least: int = LEAST, within: int = WITHIN, map_bits: int = MAP_BITS) -> DataFrame:
    """All phrases of two to three words that stand ``least`` times or more, with score and cut, but for those inside a
    longer one that has ``within`` hundredths of their occurrences or more; and ``n``, the words of the language.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    size = common.scalar(texts.agg(F.sum(F.length("text"))).first()[0])
    parts = max(common.width(spark), size // PART_BYTES)
    maps = []
    for _ in range(2):
        maps.append(spark.sparkContext.broadcast(frequent(texts, maps, parts, least, map_bits).bits.tobytes()))
    held = common.written(index(texts, maps, parts, least), "phrases")
    every = common.written(scored(held, parts), "phrases-scored")
    return without_parts(every, within).join(sizes(texts), "lang")


def sizes(texts: DataFrame) -> DataFrame:
    """lang, n: all words."""
    word = r"([^\x20\x09-\x0D.,;:!?]+)"
    return texts.select("lang", F.regexp_count(F.col("text").cast("string"), F.lit(word)).alias("n")).groupBy("lang").agg(F.sum("n").cast("long").alias("n"))


def without_parts(every: DataFrame, within: int) -> DataFrame:
    """Phrases that no longer phrase of enough occurrences holds; each longer one names its parts, summed before they meet."""
    inner = F.expr("flatten(transform(sequence(2, words - 1), k -> transform(sequence(1, words - k + 1), i -> array_join(slice(split(phrase, ' '), i, k), ' '))))")
    longer = every.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    return every.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("_longer") < within * F.col("a"), F.lit(True))).drop("_longer")


def ranked(phrases: DataFrame, top: int = TOP, buckets: int = 64) -> DataFrame:
    """The first of each language by score, then occurrences, then phrase.

    A language may hold most phrases: the first of each bucket of them are found before the buckets meet.
    """
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    dealt = phrases.withColumn("_bucket", F.pmod(F.xxhash64("phrase"), F.lit(buckets)))
    first = dealt.withColumn("_first", F.row_number().over(Window.partitionBy("lang", "_bucket").orderBy(*order))).where(F.col("_first") <= top)
    whole = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return whole.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
