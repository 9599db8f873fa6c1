"""Suffix-array dedup: bytes that a string of 50 bytes covers which also starts in a document of smaller id are removed.

Documents lie in slices of some megabytes, written once. Sorting the suffixes of all of them would give most of
the work to strings that stand in one document only, so first

1. every window of 50 bytes names its anchor: of the 16-byte strings in it the one whose hash is
   smallest (leftmost on ties). Equal windows have equal anchors, and neighbouring windows mostly the same one.
   The anchors' hashes of each slice, each once, are counted by documents in the partitions of the hashes;
   windows whose anchor stands in one document only are done. Two bits an anchor go back to each slice.
   A text that equals one of smaller id as a whole (told by 128-bit digests) goes altogether and sends no more.
2. Each other anchor with the bytes of all windows that name it (at most 84) is a context. Each slice sends
   every distinct context once, with its smallest id, to the partition of the anchor. There contexts equal
   as a whole become one. Where an anchor has several contexts, these make up shards of bounded size: a suffix array by
   Larsson-Sadakane refinement (prefix doubling that sorts only what isn't told apart yet) and Kasai's common prefixes
   give the classes of equal windows with the smallest id of each; the classes of shards that share an anchor are
   merged by binary search of one's windows among the others'. An anchor of more than ``HOT`` documents would
   be one task's work, so its windows go out singly, to the partitions of their own 50 bytes.
3. Each slice gets the windows that stand in a document of smaller id, and removes what they cover.

Exact: but for the digests of whole texts, hashes choose anchors and partitions only (two anchors with one hash only mean more work); windows are
compared by their bytes. What returns to slices are bits and places, so texts move twice, compressed.

Edge cases: a null text is empty; a null id counts as larger than all others, and rows of equal
ids (or without) aren't smaller than each other, so equal rows keep their text unless a smaller id has it; texts
may hold any bytes and any length (a text is searched in steps of ``STEP`` bytes); an empty table gives an empty
one; other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

U = np.uint64
WINDOW, GRAM, DIGEST = 50, 16, 16
REACH = WINDOW - GRAM + 1
SLICE_BYTES = 2 << 20
STEP = 1 << 16
#: Anchors of more documents send their windows singly.
HOT = 4096
#: Bytes of contexts of one suffix array, and bytes for which one partition of keys stands.
SHARD_BYTES = 1 << 19
PART_BYTES = 16 << 20
LAST = np.iinfo(np.int64).max


def _words(data: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The eight bytes from each place on, as a number; zeros follow the end."""
    raw = data.tobytes() + bytes(16)
    out = np.empty((len(data) + 7) // 8 * 8, kind)
    for j in range(8):
        out[j::8] = np.frombuffer(raw, kind, len(out) // 8, j)
    return out[: len(data)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place on where so many are left."""
    w = _words(data).astype(U)
    n = len(data) - GRAM + 1
    with np.errstate(over="ignore"):
        x = w[:n] * U(0x9E3779B97F4A7C15)
        x ^= x >> U(29)
        x += w[8 : 8 + n] * U(0xC2B2AE3D27D4EB4F)
    return common.mix64(x)


def anchors(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of windows of one anchor in texts that lie end to end: first window, windows, hash of the anchor, text."""
    found: list[tuple[np.ndarray, ...]] = []
    ends = np.cumsum(lengths)
    starts = ends - lengths
    for base in range(0, len(data) - WINDOW + 1, STEP):
        part = data[base : base + STEP + WINDOW - 1]
        n = len(part) - WINDOW + 1
        g = gram_hashes(part)
        low = g >> U(32) << U(32) | np.arange(len(g), dtype=U)
        k = 1
        while 2 * k <= REACH:
            low = np.minimum(low[:-k], low[k:])
            k *= 2
        at = (np.minimum(low[:n], low[REACH - k : REACH - k + n]) & U(0xFFFFFFFF)).astype(np.int64)
        whole = np.ones(n, bool)
        for t in range(np.searchsorted(ends, base, "right"), np.searchsorted(starts, base + n)):
            whole[max(starts[t], ends[t] - WINDOW + 1, base) - base : max(0, ends[t] - base)] = False
        place = np.flatnonzero(whole)
        at = at[place]
        first = np.ones(len(place), bool)
        first[1:] = (at[1:] != at[:-1]) | (place[1:] != place[:-1] + 1)
        begin = np.flatnonzero(first)
        # anchors have small hashes; mixed again they deal out evenly
        found.append((place[begin] + base, np.diff(np.append(begin, len(place))), common.mix64(~g[at[begin]])))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    start, windows, key = map(np.concatenate, zip(*found))
    return start, windows, key, np.searchsorted(ends, start, "right")


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Partition by the upper bits, so that keys in order lie in order of partitions."""
    return ((keys >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """Partitions and ranges of sorted keys."""
    edges = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)).tolist():
        yield p, int(edges[p]), int(edges[p + 1])


# suffix arrays


def suffix_array(data: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Places of ``data`` in order of at least their first ``depth`` bytes, by Larsson-Sadakane refinement.

    A place's rank is where its group starts; a round sorts the places of groups that hold more than one by the
    rank of what follows, and doubles how much is compared. Suffixes that end before ``depth`` may stand anywhere
    among those that they begin.
    """
    n = len(data)
    words = _words(data, ">u8").astype(U)
    order = np.argsort(words)
    ranks = np.zeros(n, np.int64)
    first = np.ones(n, bool)
    first[1:] = words[order[1:]] != words[order[:-1]]
    done = 8
    slots = np.arange(n)
    while True:
        begin = np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))
        ranks[order[slots]] = slots[begin]
        alone = first & np.append(first[1:], True)
        slots = slots[~alone]
        if done >= depth or not len(slots):
            return order
        places = order[slots]
        own, follow = ranks[places], places + done
        behind = np.where(follow < n, ranks[np.minimum(follow, n - 1)] + 1, 0)
        both = own.astype(U) << U(32) | behind.astype(U)
        by = np.argsort(both)
        order[slots], both = places[by], both[by]
        first = np.ones(len(slots), bool)
        first[1:] = both[1:] != both[:-1]
        done *= 2


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int = 64) -> np.ndarray:
    """Kasai: bytes, up to ``most``, that each suffix in order shares with the one before it.

    Where a byte within the sorted depth (``most``) tells two suffixes apart, the next place's suffix shares at least
    one byte less with its own neighbour. Many stretches of places are walked at once.
    """
    n = len(order)
    words = np.append(_words(data).astype(U), np.zeros(most + 8, U))
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    lanes = max(1, min(4096, n // 64))
    steps = -(-n // lanes)
    here, length = np.arange(lanes) * steps, np.zeros(lanes, np.int64)
    for t in range(steps):
        i = here + t
        inside = i < n
        i, length = i[inside], length[inside]
        here = here[inside]
        j = before[i]
        length = np.where(j < 0, 0, np.maximum(length - 1, 0))
        go = np.flatnonzero(j >= 0)
        while len(go):
            differ = words[i[go] + length[go]] ^ words[j[go] + length[go]]
            length[go] += np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + U(1))) - U(1)) >> 3)
            go = go[(differ == 0) & (length[go] < most)]
        bound = np.minimum(most, n - np.maximum(i, j))
        shared[i] = np.minimum(length, bound)
        # where no differing byte decided the order the next suffixes may stand the other way round
        length = np.where(length < bound, length, 0)
    return shared[order]


def window_classes(data: np.ndarray, starts: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of equal windows of ``data`` in order: one place each, the smallest of their ids, and the class of each window."""
    order = suffix_array(data)
    edge = common_prefixes(data, order) < WINDOW
    edge[0] = True
    ids = np.full(len(data), LAST, np.int64)
    ids[starts] = least
    number = np.empty(len(data), np.int64)
    number[order] = np.cumsum(edge) - 1
    smallest = np.minimum.reduceat(ids[order], np.flatnonzero(edge))
    used, which = np.unique(number[starts], return_inverse=True)
    place = np.zeros(len(used), np.int64)
    place[which] = starts
    return place, smallest[used], which


def merged(shards: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Smallest ids of the windows of each shard (sorted windows, ids) over all shards, by binary search among what is merged."""
    every, ids = shards[0]
    for windows, own in shards[1:]:
        at = np.searchsorted(every, windows)
        hit = every[np.minimum(at, len(every) - 1)] == windows
        ids[at[hit]] = np.minimum(ids[at[hit]], own[hit])
        every, ids = np.insert(every, at[~hit], windows[~hit]), np.insert(ids, at[~hit], own[~hit])
    return [ids[np.searchsorted(every, windows)] for windows, _ in shards]


def smallest_ids(contexts: list[bytes], keys: np.ndarray, ids: np.ndarray, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each distinct context the smallest id that has it; and where each context's windows begin."""
    counts = np.fromiter(map(len, contexts), np.int64, len(contexts)) - (WINDOW - 1)
    begin = np.concatenate([[0], np.cumsum(counts)])
    out = np.repeat(ids, counts)
    _, group, size = np.unique(keys, return_inverse=True, return_counts=True)
    open_ = np.flatnonzero(size[group] > 1)
    open_ = open_[np.argsort(group[open_], kind="stable")]
    shards, at = [], 0
    spent = np.cumsum(counts[open_] + WINDOW - 1)
    while at < len(open_):
        until = max(at + 1, int(np.searchsorted(spent, (spent[at - 1] if at else 0) + shard_bytes, "right")))
        shards.append(open_[at:until])
        at = until
    split = {group[a[-1]] for a, b in zip(shards, shards[1:]) if group[a[-1]] == group[b[0]]}
    shared = []
    for own in shards:
        data = np.frombuffer(b"".join([contexts[i] for i in own.tolist()]), np.uint8)
        lengths = counts[own] + WINDOW - 1
        context = np.repeat(np.arange(len(own)), counts[own])
        inner = np.arange(len(context)) - np.repeat(np.cumsum(counts[own]) - counts[own], counts[own])
        starts = (np.cumsum(lengths) - lengths)[context] + inner
        place, smallest, which = window_classes(data, starts, ids[own][context])
        into = begin[own][context] + inner
        out[into] = smallest[which]
        meets = np.isin(group[own][context], list(split))
        if meets.any():
            crossing = np.zeros(len(place), bool)
            crossing[which[meets]] = True
            rows = np.concatenate([data[place[crossing, None] + np.arange(WINDOW)], np.ones((int(crossing.sum()), 1), np.uint8)], axis=1)
            shared.append((rows.view(f"S{WINDOW + 1}").ravel(), smallest[crossing], crossing, which, into))
    if shared:
        for (_, _, crossing, which, into), over_all in zip(shared, merged([x[:2] for x in shared])):
            value = np.zeros(len(crossing), np.int64)
            value[crossing] = over_all
            changed = crossing[which]
            out[into[changed]] = value[which[changed]]
    return out, begin


# slices


SLICES = "slice long, ids binary, known binary, lengths binary, digests binary, text binary"


def slices(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Documents in slices: ids (null: the largest number, and not ``known``), byte lengths, digests of the texts, the texts end to end, zstd."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        import zstandard
        from pyspark import TaskContext

        number, pack = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=3)
        ids, texts, size = [], [], 0

        def closed() -> pa.RecordBatch:
            own = np.array([LAST if i is None else i for i in ids], np.int64)
            columns = [[number], [own.tobytes()], [bytes(i is not None for i in ids)], [np.fromiter(map(len, texts), np.int64, len(texts)).tobytes()], [b"".join([blake2b(t, digest_size=DIGEST).digest() for t in texts])], [pack.compress(b"".join(texts))]]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["slice", "ids", "known", "lengths", "digests", "text"])

        for batch in batches:
            for i, text in zip(*common.columns_of(batch, "doc_id", "text")):
                if ids and size + len(text) > slice_bytes:
                    yield closed()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(i)
                texts.append(text)
                size += len(text)
        if ids:
            yield closed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(made, SLICES)


class Slice:
    def __init__(self, row: dict):
        import zstandard

        self.number, self.ids = row["slice"], np.frombuffer(row["ids"], np.int64)
        self.known = np.frombuffer(row["known"], np.uint8)
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.text = zstandard.ZstdDecompressor().decompress(row["text"])
        self.data = np.frombuffer(self.text, np.uint8)

    def copies(self, found: list[dict] | None) -> np.ndarray:
        """Which texts equal one of smaller id, from the bits of ``copies``."""
        raw = next((x["copies"] for x in found or [] if x["copies"] is not None), b"").ljust((len(self.ids) + 7) // 8, b"\0")
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=len(self.ids)).astype(bool)

    def grams(self) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray, np.ndarray]:
        """Stretches of windows; the distinct hashes of anchors in order, the documents that each stands in, which each stretch has."""
        found = anchors(self.data, self.lengths)
        order = np.argsort(found[2], kind="stable")
        key, text = found[2][order], found[3][order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        other = new.copy()
        other[1:] |= text[1:] != text[:-1]
        number = np.cumsum(new) - 1
        which = np.empty(len(key), np.int64)
        which[order] = number
        return found, key[new], np.bincount(number, other, int(new.sum())).astype(np.int64), which


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def copies(held: DataFrame) -> DataFrame:
    """slice, bits: a bit for each text of a slice, of the slices where one equals a text of smaller id."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, digests in zip(*common.columns_of(batch, "slice", "ids", "digests")):
                n = len(ids) // 8
                columns = [pa.array([number] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(np.frombuffer(ids, np.int64)), pa.array([digests[i : i + DIGEST] for i in range(0, len(digests), DIGEST)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["slice", "at", "id", "digest"])

    def bits(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        flags = np.zeros(int(max(table.column("at").to_pylist())) + 1, bool)
        flags[table.column("at").to_numpy()] = True
        raw = np.packbits(flags).tobytes()
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([raw], pa.binary())})

    names = held.select("slice", "ids", "digests").mapInArrow(listed, "slice long, at int, id long, digest binary")
    first = names.groupBy("digest").agg(F.min("id").alias("first"))
    return names.join(first, "digest").where("id > first").select("slice", "at").groupBy("slice").applyInArrow(bits, "slice long, bits binary")


COUNTED = pa.schema([("part", pa.int32()), ("slice", pa.int64()), ("keys", pa.binary()), ("many", pa.binary()), ("docs", pa.binary())])
#: ``shared``, ``hot``: a bit for each anchor sent; n: contexts to come of the shared ones at most.
BITS = pa.schema([("slice", pa.int64()), ("part", pa.int32()), ("shared", pa.binary()), ("hot", pa.binary()), ("n", pa.int64())])


def shared_anchors(held: DataFrame, parts: int, hot: int) -> DataFrame:
    """For each slice and partition of hashes: which of the slice's anchors stand in several documents, and in very many."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, keys, docs, _ = Slice(row).grams()
                short = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
                rows = [(p, row["slice"], short[a:b].tobytes(), np.packbits(docs[a:b] > 1).tobytes(), docs[a:b][docs[a:b] > 1].astype(np.uint32).tobytes()) for p, a, b in by_part(keys, parts)]
                if rows:
                    yield _table(rows, COUNTED)

    def judged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found, docs = [], []
        for short, many, more in zip(table.column("keys"), table.column("many"), table.column("docs")):
            raw = np.frombuffer(short.as_py(), np.uint8).reshape(-1, 6)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :6] = raw
            found.append(wide.view("<u8").ravel())
            own = np.ones(len(raw), np.int64)
            own[np.unpackbits(np.frombuffer(many.as_py(), np.uint8), count=len(raw)).astype(bool)] = np.frombuffer(more.as_py(), np.uint32)
            docs.append(own)
        distinct, which = np.unique(np.concatenate(found), return_inverse=True)
        total = np.bincount(which, np.concatenate(docs), len(distinct))
        shared, often, rows, at = total > 1, total > hot, [], 0
        for number, keys, own in zip(table.column("slice").to_pylist(), found, docs):
            w = which[at : at + len(keys)]
            at += len(keys)
            if shared[w].any():
                rows.append((number, key[0].as_py(), np.packbits(shared[w]).tobytes(), np.packbits(often[w]).tobytes(), int(own[shared[w]].sum() + own[often[w]].sum() * REACH)))
        return pa.Table.from_batches([_table(rows, BITS)])

    schema = "slice long, part int, shared binary, hot binary, n long"
    return held.mapInArrow(sent, "part int, slice long, keys binary, many binary, docs binary").groupBy("part").applyInArrow(judged, schema)


#: n contexts of a slice in the order of their first places, and ``packed``, zstd of: smallest ids, 32 bits of the anchors, how
#: many places each, the places (each less the one before; the highest bit says that another document of the slice
#: with a smaller id has the context), lengths, and the contexts' bytes end to end.
CONTEXTS = pa.schema([("part", pa.int32()), ("slice", pa.int64()), ("n", pa.int32()), ("packed", pa.binary())])
AGAIN = np.uint32(1 << 31)


def _contexts(own: Slice, bits: list[dict], anchor_parts: int, parts: int) -> Iterator[tuple]:
    """Rows of ``CONTEXTS`` of one slice."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3)
    (start, windows, key, text), keys, _, which = own.grams()
    shared, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    ranges = {p: (a, b) for p, a, b in by_part(keys, anchor_parts)}
    copy = own.copies(bits)[text]
    for row in bits:
        if row["shared"] is None:
            continue
        a, b = ranges[row["part"]]
        for flags, name in ((shared, "shared"), (hot, "hot")):
            flags[a:b] = np.unpackbits(np.frombuffer(row[name], np.uint8), count=b - a).astype(bool)
    cold, single = np.flatnonzero(shared[which] & ~hot[which] & ~copy), np.flatnonzero(hot[which] & ~copy)
    each = np.repeat(single, windows[single])
    begin = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(windows[single]) - windows[single], windows[single])
    begin = np.concatenate([start[cold], begin])
    size = np.concatenate([windows[cold], np.ones(len(each), np.int64)]) + WINDOW - 1
    anchor = np.concatenate([key[cold], np.zeros(len(each), U)])
    ids = own.ids[np.concatenate([text[cold], text[each]])]
    order: dict[bytes, int] = {}
    number = np.fromiter((order.setdefault(own.text[b : b + s], len(order)) for b, s in zip(begin.tolist(), size.tolist())), np.int64, len(begin))
    distinct = list(order)
    if not distinct:
        return
    place = np.zeros(len(distinct), np.int64)
    place[number] = np.arange(len(number))
    anchor = common.mix64(anchor[place] ^ U(0xA0761D6478BD642F))
    alone = np.flatnonzero(place >= len(cold))
    if len(alone):  # a window of its own: keyed by its bytes
        import xxhash

        anchor[alone] = np.fromiter((xxhash.xxh3_64_intdigest(distinct[i]) for i in alone.tolist()), U, len(alone))
    least = np.full(len(distinct), LAST, np.int64)
    np.minimum.at(least, number, ids)
    marked = begin.astype(np.uint32) | np.where(ids > least[number], AGAIN, np.uint32(0))
    by_context = np.argsort(number, kind="stable")
    edges = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(distinct)))])
    to = np.argsort(anchor, kind="stable")
    for p, a, b in by_part(anchor[to], parts):
        mine = np.sort(to[a:b])
        texts = [distinct[i] for i in mine.tolist()]
        places = marked[np.concatenate([by_context[edges[i] : edges[i + 1]] for i in mine.tolist()])]
        numbers = (least[mine], anchor[mine].astype(np.uint32), np.diff(edges)[mine].astype(np.uint32), np.diff(places, prepend=np.uint32(0)), np.fromiter(map(len, texts), np.uint8, len(texts)))
        yield p, own.number, len(mine), pack.compress(b"".join([*(x.tobytes() for x in numbers), *texts]))


def _unpacked(n: int, packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Smallest ids, anchors, numbers of places, places and bytes of the contexts of a row."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(packed)
    ids, keys, counts = np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.uint32, n, 8 * n), np.frombuffer(raw, np.uint32, n, 12 * n)
    m, at = int(counts.sum()), 16 * n
    places = np.cumsum(np.frombuffer(raw, np.uint32, m, at), dtype=np.uint32)
    ends = np.cumsum(np.frombuffer(raw, np.uint8, n, at + 4 * m), dtype=np.int64) + at + 4 * m + n
    return ids, keys, counts, places, [raw[a:b] for a, b in zip([at + 4 * m + n, *ends.tolist()], ends.tolist())]


FOUND = pa.schema([("slice", pa.int64()), ("places", pa.binary()), ("masks", pa.binary())])


def repeated_windows(held: DataFrame, bits: DataFrame, equal: DataFrame, anchor_parts: int, parts: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """For each slice the places of contexts and, a bit a window, which of its windows a document of smaller id has."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = list(_contexts(Slice(row), row["bits"], anchor_parts, parts))
                if rows:
                    yield _table(rows, CONTEXTS)

    def judged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order: dict[bytes, int] = {}
        numbers, keys, ids, times, places = [], [], [], [], []
        for n, packed in zip(table.column("n").to_pylist(), table.column("packed")):
            least_here, key_here, counts, at, contexts = _unpacked(n, packed.as_py())
            numbers.append(np.fromiter((order.setdefault(c, len(order)) for c in contexts), np.int64, n))
            for held_back, x in ((keys, key_here), (ids, least_here), (times, counts), (places, at)):
                held_back.append(x.copy())
        number = np.concatenate(numbers)
        least, anchor = np.full(len(order), LAST, np.int64), np.zeros(len(order), np.uint32)
        np.minimum.at(least, number, np.concatenate(ids))
        anchor[number] = np.concatenate(keys)
        smallest, begin = smallest_ids(list(order), anchor, least, shard_bytes)
        rows = []
        for slice_, own, least_here, often, at in zip(table.column("slice").to_pylist(), numbers, ids, times, places):
            counts = begin[own + 1] - begin[own]
            context = np.repeat(np.arange(len(own)), counts)
            inner = np.arange(len(context)) - np.repeat(np.cumsum(counts) - counts, counts)
            earlier = smallest[begin[own][context] + inner] < least_here[context]
            mask = np.bitwise_or.reduceat(earlier.astype(U) << inner.astype(U), np.cumsum(counts) - counts)
            whole = (U(1) << counts.astype(U)) - U(1)
            masks = np.where(at >= AGAIN, np.repeat(whole, often), np.repeat(mask, often))
            kept = masks > 0
            if kept.any():
                rows.append((slice_, (at[kept] & ~AGAIN).tobytes(), np.ascontiguousarray(masks[kept].view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()))
        return pa.Table.from_batches([_table(rows, FOUND)])

    none = F.lit(None).cast("binary")
    both = bits.select("slice", F.struct("part", "shared", "hot", none.alias("copies")).alias("x")).union(equal.select("slice", F.struct(F.lit(-1).alias("part"), none.alias("shared"), none.alias("hot"), F.col("bits").alias("copies")).alias("x")))
    wanted = both.groupBy("slice").agg(F.collect_list("x").alias("bits"))
    contexts = held.join(wanted.hint("shuffle_hash"), "slice").mapInArrow(sent, "part int, slice long, n int, packed binary")
    return contexts.groupBy("part").applyInArrow(judged, "slice long, places binary, masks binary")


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def without_repeats(held: DataFrame, found: DataFrame, equal: DataFrame) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Slice(row)
                change = np.zeros(len(own.data) + WINDOW + 1, np.int64)
                ends = np.cumsum(own.lengths)
                starts = ends - own.lengths
                whole = own.copies(row["found"]) & (own.lengths >= WINDOW)
                np.add.at(change, starts[whole], 1)
                np.add.at(change, ends[whole], -1)
                for x in row["found"] or []:
                    if x["places"] is None:
                        continue
                    places, raw = np.frombuffer(x["places"], np.uint32).astype(np.int64), np.frombuffer(x["masks"], np.uint8).reshape(-1, 5)
                    at, window = np.nonzero(np.unpackbits(raw, axis=1, bitorder="little"))
                    np.add.at(change, places[at] + window, 1)
                    np.add.at(change, places[at] + window + WINDOW, -1)
                gone = np.cumsum(change)[: len(own.data)] > 0
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                filled = own.lengths > 0
                opens[starts[filled]] = gone[starts[filled]]
                count = lambda flags: (c := np.concatenate([[0], np.cumsum(flags)]))[ends] - c[starts]
                removed, spans = count(gone), count(opens)
                for low, high in common.slices([own.text[a:b] for a, b in zip(starts.tolist(), ends.tolist())], common.BATCH_BYTES):
                    kept = [own.text[a:b] if not r else own.data[a:b][~gone[a:b]].tobytes() for a, b, r in zip(starts[low:high].tolist(), ends[low:high].tolist(), removed[low:high].tolist())]
                    numbers = [pa.array(own.ids[low:high], mask=own.known[low:high] == 0), *(pa.array(x[low:high], pa.int64()) for x in (own.lengths, removed, spans))]
                    yield pa.RecordBatch.from_arrays([*numbers, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    none = F.lit(None).cast("binary")
    both = found.select("slice", F.struct("places", "masks", none.alias("copies")).alias("x")).union(equal.select("slice", F.struct(none.alias("places"), none.alias("masks"), F.col("bits").alias("copies")).alias("x")))
    lists = both.groupBy("slice").agg(F.collect_list("x").alias("found"))
    return held.join(lists.hint("shuffle_hash"), "slice", "left").mapInArrow(made, KEPT)


def dedup(docs: DataFrame, hot: int = HOT, slice_bytes: int = SLICE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (stretches removed) and kept (the bytes left) for each row of ``docs``."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    held = common.written(slices(docs, slice_bytes), "slices")
    size = common.scalar(held.agg(F.sum(F.length("text"))).first()[0])
    anchor_parts = max(common.width(spark), size // PART_BYTES)
    bits = common.written(shared_anchors(held, anchor_parts, hot), "anchors")
    contexts = common.scalar(bits.agg(F.sum("n")).first()[0])
    parts = max(common.width(spark), contexts * (WINDOW + REACH // 2) // PART_BYTES)
    equal = common.written(copies(held), "copies")
    return without_repeats(held, repeated_windows(held, bits, equal, anchor_parts, parts, shard_bytes), equal)


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
