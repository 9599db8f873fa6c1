"""N-gram Jaccard join by universe partition: which documents share at least 75 % of their 5-word shingles.

A document is the set of its distinct shingles (64-bit hashes). Sizes fall in bands such that two linked
documents lie in one band or in neighbours. A band's family splits the universe of hashes into ``m``
segments; every document is indexed in the family of its own band and of the next one, under the content
of each segment and, for segments of six or more, of each subset that lacks one element (one-deletion
neighbourhoods). If two sets differ in at most H elements and the probing side allots units to its
segments (1: equal content, 2: also one element of difference) that add up to more than H, some segment
agrees within its units. The larger set of a pair probes; H <= 2/7 of its size. Units are allotted where
candidate lists are expected to be short: by the number of elements that aren't frequent. Frequent
shingles come from a bounded sample of documents; they only steer costs. Segments are small, so that a
frequent passage spoils few others. All segments are indexed, for small sizes empty ones too, so there
are always enough units and no pair can be missed.

Candidates are joined by content key in hash partitions. A parity sketch, whose distance never exceeds the
true difference, discards most wrong candidates; the rest is verified on the texts' shingle sets. Each
set first meets the candidate with which it shares most keys, then lists of candidates that are still
apart are spanned by trees of small sketch distance. In the lists that remain, the members that some
partner in another component is left for by the sketches bring their shingle sets, and the links that join
components are found where the list is: no step gives more rows than the lists have members, and a list of more than ``LIST_BLOCK`` members is dealt out by pairs of
blocks. Links inside one component add nothing to the classes and aren't counted; each step's links join
the roots that the one before it left.

Edge cases: null, empty and wordless texts have no shingles and link with nothing; up to four words make
one shingle; equal sets are one class whatever their number; repeated rows keep a row each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components, extended

WORDS = 5
SEGMENT = 2.0  # elements in a segment, at the largest size of a band
EMPTY_BELOW = 128  # families of smaller sizes index empty segments too; in larger ones the others always suffice
INDEX_DELETIONS, PROBE_DELETIONS = 6, 5
LEVELS = 14  # frequencies are powers of two below the sample's size
SAMPLE_DOCS, HOT_SHINGLES, HOT_COUNT = 8192, 1 << 18, 2
FLUSH_DOCS, FLUSH_BYTES = 50_000, 12 << 20

FEW_IDS = 500_000  # documents named by 24 bytes each that all workers may be told of
LIST_BLOCK = 4096  # members of a list that one task compares with each other

RANGES = 4  # of keys (a power of two up to 4: the two top bits of an entry), unpacked one after the other

U = np.uint64


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = common.word_hashes(texts)
    ends = np.cumsum(counts)
    n = max(0, len(words) - WORDS + 1)
    with np.errstate(over="ignore"):
        acc = words[:n].copy()
        for k in range(1, WORDS):
            acc = acc * U(0x9E3779B97F4A7C15) + words[k : k + n]
        acc = common.mix64(acc)
        out = []
        for end, c in zip(ends.tolist(), counts.tolist()):
            if c >= WORDS:
                s = np.sort(acc[end - c : end - WORDS + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif c:
                short = U(c)
                for w in words[end - c : end]:
                    short = short * U(0xC2B2AE3D27D4EB4F) + w
                out.append(common.mix64(np.array([short], U)))
            else:
                out.append(np.zeros(0, U))
    return out


def set_fingerprint(s: np.ndarray) -> int:
    """Signed 64-bit fingerprint of a set."""
    with np.errstate(over="ignore"):
        total = common.mix64(s).sum(dtype=U) + U(len(s)) * U(0x9E3779B97F4A7C15)
    return int(common.mix64(np.array([total], U)).view(np.int64)[0])


def parity_sketch(s: np.ndarray) -> bytes:
    """Parity of the number of elements in each of B cells, B a power of two of about 2 to 4 times the size."""
    cells = max(64, 1 << int(2 * max(1, len(s)) - 1).bit_length())
    at = (s & U(cells - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=cells) & 1).astype(np.uint8)).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """At most the size of the symmetric difference of the two sets."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def bands(largest: int = 1 << 31) -> np.ndarray:
    """First sizes of the bands: 4/3 of a band's largest size still lies in the next band."""
    out = [1, 2]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, (out[-1] - 1) * 4 // 3 + 1))
    return np.array(out, np.int64)


BANDS = bands()


def segments_of(band: np.ndarray) -> np.ndarray:
    """Number of segments in a band's family."""
    high = BANDS[band + 1] - 1
    return np.maximum(np.ceil(high / SEGMENT).astype(np.int64), 2 * high // 7 + 1)


def _family(hashes: np.ndarray, g: np.ndarray, common_level: np.ndarray, doc: np.ndarray, sizes: np.ndarray, band: np.ndarray, probes: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content keys of all documents in one family each; their flags (1: probes, 2: whole content); their documents."""
    m = segments_of(band)
    base = np.cumsum(m) - m
    total = int(m.sum())
    number = ((hashes >> U(32)) * m[doc].astype(U) >> U(32)).astype(np.int64)
    at = base[doc] + number
    size = np.bincount(at, minlength=total)
    ends = np.cumsum(size)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, U), np.cumsum(g, dtype=U)])
        content = sums[ends] - sums[ends - size]
        owner = np.repeat(np.arange(len(m)), m)
        salt = common.mix64((band[owner].astype(U) << U(40)) + (np.arange(total) - base[owner]).astype(U))
        whole = common.mix64(content + salt)
        kept = size >= INDEX_DELETIONS
        chosen_w, chosen_d = np.zeros(total, bool), np.zeros(total, bool)
        if probes:
            # expected list lengths, shortest first: by the rarest element for equal content (even classes),
            # for one deletion (odd classes) short only if two elements are rare; empty segments last
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            rarest = np.full(total, LEVELS)
            rarest[at[first]] = np.minimum.reduceat(common_level, first)
            rare = np.bincount(at, weights=common_level == 0, minlength=total)
            class_w = 2 * rarest
            able = size >= PROBE_DELETIONS
            class_d = np.where(rare >= 2, 1, 2 * LEVELS - 1)
            class_w[(size == 0) & (sizes >= EMPTY_BELOW)[owner]] = 2 * LEVELS + 1
            usable = class_w <= 2 * LEVELS
            wide = 2 * LEVELS + 1
            units = np.bincount(owner[usable] * wide + class_w[usable], minlength=wide * len(m)).reshape(-1, wide)
            units = units + np.bincount(owner[able] * wide + class_d[able], minlength=wide * len(m)).reshape(-1, wide)
            need = 2 * sizes // 7 + 1
            upto = np.cumsum(units, axis=1)
            if (upto[:, -1] < need).any():
                raise RuntimeError("the universe partition left a set without enough units")
            limit = (upto < need[:, None]).sum(axis=1)
            # of the last class, if it is one of equal content, as many as are needed
            below = upto[np.arange(len(m)), limit] - units[np.arange(len(m)), limit]
            last = class_w == limit[owner]
            count = np.cumsum(last)
            order_in = count - np.concatenate([[0], count])[base[owner]]
            chosen_w = (class_w < limit[owner]) | last & (order_in <= (need - below)[owner])
            chosen_d = able & (class_d <= limit[owner])
            chosen_w |= chosen_d
            kept = kept | chosen_d
        lacking = np.flatnonzero(kept[at])
        seg = at[lacking]
        deletion = common.mix64(content[seg] - g[lacking] + salt[seg])
    listed = np.flatnonzero((size > 0) | (sizes < EMPTY_BELOW)[owner])
    keys = np.concatenate([whole[listed], deletion])
    flags = np.concatenate([2 + chosen_w[listed], chosen_d[seg]]).astype(np.uint8)
    return keys, flags, np.concatenate([owner[listed], owner[seg]]).astype(np.int32)


def signatures(sets: list[np.ndarray], hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, flags and document numbers of sets (none of them empty)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    hashes, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    g = common.mix64(hashes)
    known, levels = hot
    common_level = np.zeros(len(hashes), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        common_level = np.where(known[at] == hashes, levels[at], 0).astype(np.int64)
    band = np.searchsorted(BANDS, sizes, "right") - 1
    parts = [_family(hashes, g, common_level, doc, sizes, band, True), _family(hashes, g, common_level, doc, sizes, band + 1, False)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, fp and sketch of each document."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts, keys = common.columns_of(batch, "doc_id", "text", "text_key")
            for a, z in common.slices(texts_or_empty(texts)):
                sets = shingle_sets(texts[a:z])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids[a:z], pa.int64()), pa.array(keys[a:z], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_fingerprint(s) for s in sets], pa.int64()), pa.array([parity_sketch(s) for s in sets], pa.binary())],
                    names=["doc_id", "text_key", "n_shingles", "fp", "sketch"],
                )

    return _rows(docs).withColumn("text_key", F.xxhash64("text")).mapInArrow(made, "doc_id long, text_key long, n_shingles long, fp long, sketch binary")


def texts_or_empty(texts: list[bytes | None]) -> list[bytes]:
    return [t or b"" for t in texts]


def frequent_shingles(docs: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that several documents of a bounded sample hold, and the logarithms of their numbers; cost estimates only."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (texts,) = common.columns_of(batch, "text")
            for a, z in common.slices(texts_or_empty(texts)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, U), *shingle_sets(texts[a:z])]).view(np.int64))], names=["h"])

    sample = _rows(docs).sample(min(1.0, SAMPLE_DOCS / max(1, n_docs)), seed=1)
    counts = sample.mapInArrow(listed, "h long").groupBy("h").count().where(F.col("count") >= HOT_COUNT)
    top = counts.orderBy(F.desc("count"), "h").limit(HOT_SHINGLES).toArrow()  # bounded by HOT_SHINGLES
    known, count = top.column("h").to_numpy().view(U), top.column("count").to_numpy()
    order = np.argsort(known)
    return known[order], np.minimum(np.log2(count[order]), LEVELS - 1).astype(np.uint8)


def keyed_blobs(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], parts: int) -> DataFrame:
    """pid, blob: the index entries of all documents, dealt by key into ``parts`` and packed by task.

    A blob lists its sets (fp, size, number of entries) and then the entries, set by set, 5 bytes each:
    38 bits of the key and 2 flags; the partition number holds other bits of the key. Keys that agree by
    chance only cost a verification.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        fps: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        docs_held = bytes_held = 0
        listed: set[int] = set()  # equal sets are indexed once in a flush, however many copies there are

        def flushed() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            keys, flags, owner = (np.concatenate(x) for x in zip(*held))
            fp, size = np.concatenate(fps), np.concatenate(sizes)
            pid = (keys % U(parts)).astype(np.int64)
            order = np.lexsort((owner, pid))
            edges = np.searchsorted(pid[order], np.arange(parts + 1))
            entries = ((keys >> U(26) << U(2)) | flags.astype(U))[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            owner = owner[order]
            for p in range(parts):
                lo, hi = edges[p], edges[p + 1]
                if lo < hi:
                    present, number = np.unique(owner[lo:hi], return_counts=True)
                    raw = len(present).to_bytes(8, "little") + fp[present].tobytes() + size[present].tobytes() + number.astype(np.uint32).tobytes() + entries[lo:hi].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([raw], pa.binary())], names=["pid", "blob"])
            held.clear(), fps.clear(), sizes.clear(), listed.clear()

        for batch in batches:
            (texts,) = common.columns_of(batch, "text")
            for a, z in common.slices(texts_or_empty(texts)):
                fresh = {f: s for s in shingle_sets(texts[a:z]) if len(s) for f in [set_fingerprint(s)] if f not in listed}
                if not fresh:
                    continue
                listed.update(fresh)
                sets = list(fresh.values())
                keys, flags, owner = signatures(sets, hot)
                held.append((keys, flags, owner + np.int32(docs_held)))
                fps.append(np.array(list(fresh), np.int64))
                sizes.append(np.array([len(s) for s in sets], np.int32))
                docs_held, bytes_held = docs_held + len(sets), bytes_held + 8 * len(keys)
                if docs_held > FLUSH_DOCS or bytes_held > FLUSH_BYTES:
                    yield from flushed()
                    docs_held = bytes_held = 0
        yield from flushed()

    return _rows(docs).mapInArrow(made, "pid int, blob binary")


def _agreeing(table: pa.Table, part: int) -> pa.Table:
    """What agrees among the entries of one range of keys; see ``candidates``."""
    cols: list[list[np.ndarray]] = [[], [], [], []]
    for scalar in table.column("blob"):
        raw = scalar.as_py()
        n = int.from_bytes(raw[:8], "little")
        fp, size, number = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int32, n, 8 + 8 * n), np.frombuffer(raw, np.uint32, n, 8 + 12 * n)
        entry = np.zeros((int(number.sum()), 8), np.uint8)
        entry[:, :5] = np.frombuffer(raw, np.uint8, -1, 8 + 16 * n).reshape(-1, 5)
        entry = entry.view("<u8").ravel()
        mine = entry >> U(38) == U(part)
        number = np.bincount(np.repeat(np.arange(n), number)[mine], minlength=n)
        entry = entry[mine]
        for c, x in zip(cols, (entry >> U(2), (entry & U(3)).astype(np.int8), np.repeat(fp, number), np.repeat(size, number))):
            c.append(x)
    keys, flags, fp, size = (np.concatenate(c) for c in cols)
    cols.clear()
    if not len(keys):
        return pa.table({n: pa.array([], k) for n, k in (("kind", pa.int32()), ("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n_a", pa.int32()), ("flags", pa.int32()))})
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    flags, fp, size = flags[order], fp[order], size[order]
    low, high = np.minimum.reduceat(fp, first), np.maximum.reduceat(fp, first)
    probing = np.bitwise_or.reduceat(flags, first) & 1
    lengths = np.diff(np.append(first, len(keys)))
    live = np.repeat((low != high) & (probing > 0), lengths)
    group = np.repeat(np.arange(len(first)), lengths)[live]
    flags, fp, size = flags[live], fp[live], size[live]
    out: list[tuple] = []
    if len(group):
        order = np.lexsort((flags, fp, group))  # equal sets stay one member; its widest flags come last
        group, flags, fp, size = group[order], flags[order], fp[order], size[order]
        last = np.append((group[1:] != group[:-1]) | (fp[1:] != fp[:-1]), True)
        group, flags, fp, size = group[last], flags[last], fp[last], size[last]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        lengths = np.diff(np.append(first, len(group)))
        # the hub: a probing member, the one of smallest fp
        rank = np.where(flags & 1, 0, 1)
        pick = np.lexsort((fp, rank, group))[first]
        hub = np.repeat(pick, lengths)
        fits = (np.minimum(size, size[hub]) * 4 >= np.maximum(size, size[hub]) * 3) & ((flags | flags[hub]) & 2 > 0) & (fp != fp[hub])
        a, b = np.minimum(fp, fp[hub])[fits], np.maximum(fp, fp[hub])[fits]
        pairs, shared = np.unique(np.stack([a, b], axis=1), axis=0, return_counts=True) if len(a) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
        out.append((np.zeros(len(pairs), np.int32), np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int32), shared.astype(np.int32)))
        two = fits & (np.repeat(lengths, lengths) == 2)
        pairs = np.unique(np.stack([np.minimum(fp, fp[hub])[two], np.maximum(fp, fp[hub])[two]], axis=1), axis=0)
        out.append((np.full(len(pairs), 2, np.int32), np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int32), np.zeros(len(pairs), np.int32)))
        # lists of three or more members, each list of members once
        with np.errstate(over="ignore"):
            name = np.add.reduceat(common.mix64(fp.view(U) + flags.astype(U)), first)
        longer = np.flatnonzero(lengths >= 3)
        _, once = np.unique(name[longer], return_index=True)
        mine = np.zeros(len(first), bool)
        mine[longer[once]] = True
        rows = np.repeat(mine, lengths)
        out.append((np.ones(rows.sum(), np.int32), np.repeat(name.view(np.int64), lengths)[rows], fp[rows], fp[rows], size[rows].astype(np.int32), flags[rows].astype(np.int32)))
    cat = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, t) for t in (np.int32, np.int64, np.int64, np.int64, np.int32, np.int32)]
    return pa.table(dict(zip(("kind", "key", "a", "b", "n_a", "flags"), cat)))


EDGE = "kind int, key long, a long, b long, n_a int, flags int"


def candidates(blobs: DataFrame) -> DataFrame:
    """What agrees in a key. kind 0: a (hub), b, flags = keys shared here; kind 2: the same, seen in a list of two.
    kind 1: member a of the list ``key`` of three or more.
    """

    def met(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        # ranges of keys one after the other: a group's entries are never all unpacked at once
        found = [_agreeing(table, part) for part in range(RANGES)]
        return pa.concat_tables(found)

    return blobs.groupBy("pid").applyInArrow(met, EDGE)


def _close(sizes: np.ndarray, sketches: list[bytes], i: int, others: np.ndarray, folded: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Those of ``others`` that the sketches don't rule out as partners of member i."""
    lengths = np.array([len(x) for x in sketches])
    out = []
    for n in np.unique(np.minimum(lengths[others], lengths[i])).tolist():
        if n not in folded:
            at = np.flatnonzero(lengths >= n)
            rows = np.zeros((len(at), n), np.uint8)
            for r, j in enumerate(at):
                x = np.frombuffer(sketches[j], np.uint8)
                rows[r] = np.bitwise_xor.reduce(x.reshape(-1, n), axis=0)
            place = np.full(len(sketches), -1)
            place[at] = np.arange(len(at))
            folded[n] = rows.view(np.uint64), place
        rows, place = folded[n]
        here = others[np.minimum(lengths[others], lengths[i]) == n]
        far = np.bitwise_count(rows[place[here]] ^ rows[place[i]]).sum(axis=1, dtype=np.int64)
        out.append(here[far <= (sizes[here] + sizes[i]) // 7])
    return np.concatenate(out) if out else others[:0]


def _spanning(fp: np.ndarray, size: np.ndarray, root: np.ndarray, sketch: list[bytes]) -> np.ndarray:
    """Pairs that would join the roots of a list if they were links: trees along the smallest sketch distances.

    One member stands for each root; pairs that can't be links aren't used, so there may be several trees.
    """
    _, at = np.unique(root, return_index=True)
    fp, size = fp[at], size[at].astype(np.int64)
    n = min(len(sketch[i]) for i in at)
    rows = np.stack([np.bitwise_xor.reduce(np.frombuffer(sketch[i], np.uint8).reshape(-1, n), axis=0) for i in at]).view(np.uint64)
    free = np.ones(len(at), bool)
    best, parent = np.full(len(at), np.inf), np.full(len(at), -1)
    found = []
    for _ in range(len(at)):
        i = int(np.argmin(np.where(free, best, np.inf)))
        if not free[i] or best[i] == np.inf:
            i = int(np.argmax(free))  # a new tree
        elif parent[i] >= 0:
            found.append((min(fp[i], fp[parent[i]]), max(fp[i], fp[parent[i]])))
        free[i] = False
        far = np.bitwise_count(rows ^ rows[i]).sum(axis=1, dtype=np.int64)
        share = np.where((7 * far <= size + size[i]) & (np.minimum(size, size[i]) * 4 >= np.maximum(size, size[i]) * 3), far / (size + size[i]), np.inf)
        nearer = free & (share < best)
        best[nearer], parent[nearer] = share[nearer], i
    return np.array(found, np.int64).reshape(-1, 2)


def _tiled(lists: DataFrame, parts: int) -> DataFrame:
    """``lists`` (key, n, a, ...) with ``tile`` and ``_bucket``: a list of more than ``LIST_BLOCK`` members stands once for each pair of its blocks."""
    blocks = F.ceil(F.col("n") / LIST_BLOCK)
    block = F.pmod(F.xxhash64("a"), blocks)
    other = lists.withColumn("_block", block).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    tiled = other.withColumn("tile", F.xxhash64("key", F.least("_block", "_other"), F.greatest("_block", "_other"))).drop("_block", "_other")
    return tiled.withColumn("_bucket", F.pmod("tile", F.lit(4 * parts)))


def _members(table: pa.Table, *columns: str) -> Iterator[tuple]:
    """The columns of each tile, as arrays or lists."""
    table = table.sort_by("tile")
    tiles = table.column("tile").to_numpy()
    held = [table.column(c).to_numpy() if pa.types.is_integer(table.schema.field(c).type) else table.column(c).to_pylist() for c in columns]
    edges = np.flatnonzero(np.concatenate([[True], tiles[1:] != tiles[:-1], [True]]))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield tuple(x[lo:hi] for x in held)


def spanning_pairs(lists: DataFrame, parts: int) -> DataFrame:
    """Pairs (a, b) of different roots that span each list of (key, n, a, n_a, flags, root, sketch) by trees."""

    def paired(bucket: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = [np.zeros((0, 2), np.int64), *(_spanning(*x) for x in _members(table, "a", "n_a", "root", "sketch"))]
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return _tiled(lists, parts).groupBy("_bucket").applyInArrow(paired, "a long, b long")


def _possible(size: np.ndarray, flags: np.ndarray, root: np.ndarray, sketch: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Members that probe, each with the partners of other roots that flags, sizes and sketches leave possible."""
    folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i in np.flatnonzero(flags & 1).tolist():
        ok = (root != root[i]) & ((flags | flags[i]) & 2 > 0) & (np.minimum(size, size[i]) * 4 >= np.maximum(size, size[i]) * 3)
        others = np.flatnonzero(ok)
        if len(others):
            others = _close(size, sketch, i, others, folded)
        if len(others):
            yield i, others


def open_members(lists: DataFrame, parts: int) -> DataFrame:
    """key, n, a, n_a, flags and root of the members of (key, n, a, n_a, flags, root, sketch) that some partner of another root is possible for.

    Members that possible pairs connect are a list of their own, named by its n members: what several lists
    leave open alike is one list after ``distinct``.
    """

    def opened(bucket: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for fp, size, flags, root, sketch in _members(table, "a", "n_a", "flags", "root", "sketch"):
            above = np.arange(len(fp))
            for i, others in _possible(size, flags, root, sketch):
                met = np.unique(above[np.append(others, i)])
                if len(met) > 1:
                    above[np.isin(above, met)] = met[0]
            names, at, number = np.unique(above, return_inverse=True, return_counts=True)
            with np.errstate(over="ignore"):
                name = np.zeros(len(names), U)
                np.add.at(name, at, common.mix64(common.mix64(fp.view(U)) + flags.astype(U)))
            chosen = number[at] > 1
            out.append((name[at].view(np.int64)[chosen], number[at][chosen], fp[chosen], size[chosen], flags[chosen], root[chosen]))
        cols = [np.concatenate(x) for x in zip(*out)]
        return pa.table(dict(zip(("key", "n", "a", "n_a", "flags", "root"), cols)))

    return _tiled(lists, parts).groupBy("_bucket").applyInArrow(opened, "key long, n long, a long, n_a int, flags int, root long")


def joining_links(members: DataFrame, parts: int) -> DataFrame:
    """Links (a, b) between roots in lists (key, n, a, n_a, flags, root, elements), at most one less than a list has roots."""

    def joined(bucket: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        for fp, size, flags, root, raw in _members(table, "a", "n_a", "flags", "root", "elements"):
            sets = [np.frombuffer(x, U) for x in raw]
            above = {int(r): int(r) for r in root}

            def top(r: int, above: dict[int, int] = above) -> int:
                while above[r] != r:
                    above[r] = r = above[above[r]]
                return r

            for i, others in _possible(size, flags, root, [parity_sketch(x) for x in sets]):
                for j in others.tolist():
                    x, y = top(int(root[i])), top(int(root[j]))
                    if x == y:
                        continue
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                        above[max(x, y)] = min(x, y)
                        found.append((min(int(fp[i]), int(fp[j])), max(int(fp[i]), int(fp[j]))))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return _tiled(members, parts).groupBy("_bucket").applyInArrow(joined, "a long, b long").distinct()


def with_elements(members: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """``members`` with the shingle hashes of each, from its representative text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (texts,) = common.columns_of(batch, "text")
            for a, z in common.slices(texts_or_empty(texts)):
                found = shingle_sets(texts[a:z])
                yield pa.RecordBatch.from_arrays([pa.array([set_fingerprint(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["a", "elements"])

    wanted = members.select(F.col("a").alias("fp")).distinct().join(sets, "fp").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    elements = common.written(_texts_of(wanted, docs).select("text").mapInArrow(made, "a long, elements binary").dropDuplicates(["a"]), "join-elements")
    return members.join(elements, "a")


def plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose sketches leave a link possible, with their representative texts."""
    side = lambda x: sets.select(F.col("fp").alias(x), F.col("doc_id").alias(f"doc_{x}"), F.col("text_key").alias(f"key_{x}"), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b, s_a, s_b = common.columns_of(batch, "n_a", "n_b", "sketch_a", "sketch_b")
            keep = [sketch_distance(x, y) <= (m + n) // 7 and 4 * min(m, n) >= 3 * max(m, n) for m, n, x, y in zip(n_a, n_b, s_a, s_b)]
            yield batch.select(["a", "b", "doc_a", "doc_b", "key_a", "key_b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.mapInArrow(kept, "a long, b long, doc_a long, doc_b long, key_a long, key_b long")


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """text_key and text, once each, of the documents that ``ids`` (_id, _key) names.

    Up to ``FEW_IDS`` names go to all workers, so that no other text is shuffled; more meet the texts in a shuffle.
    """
    ids = common.written(ids, "join-ids")
    ids = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
    mine = _rows(docs).withColumn("text_key", F.xxhash64("text"))
    mine = mine.join(ids, mine["doc_id"].eqNullSafe(ids["_id"]) & (mine["text_key"] == ids["_key"]), "left_semi")
    return mine.select("text_key", "text").distinct()


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b, doc_a, doc_b, key_a, key_b) that are links, by their texts' sets.

    Ids may be null or stand on several texts, so texts are known by their keys; the ids only spread copies.
    """
    pairs = common.written(pairs, "join-pairs")
    ids = pairs.select("doc_a", "key_a").union(pairs.select("doc_b", "key_b")).toDF("_id", "_key").distinct()
    texts = common.written(_texts_of(ids, docs), "join-texts")
    side = lambda x: texts.select(F.col("text_key").alias(f"key_{x}"), F.col("text").alias(f"text_{x}"))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[np.ndarray, int]] = {}

        def parsed(text: bytes) -> tuple[np.ndarray, int]:
            if text not in seen:
                if len(seen) > 64:
                    seen.clear()
                s = shingle_sets([text])[0]
                seen[text] = s, set_fingerprint(s)
            return seen[text]

        for batch in batches:
            keep = []
            for a, b, t, u in zip(*common.columns_of(batch, "a", "b", "text_a", "text_b")):
                (x, fx), (y, fy) = parsed(t), parsed(u)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(fx == a and fy == b and 100 * both >= 75 * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a"), "key_a").join(side("b"), "key_b").mapInArrow(checked, "a long, b long").distinct()


def _with_root(df: DataFrame, roots: DataFrame, column: str, out: str) -> DataFrame:
    return df.join(roots.select(F.col("node").alias(column), F.col("root").alias(out)), column, "left").withColumn(out, F.coalesce(out, column))


def _apart(lists: DataFrame, roots: DataFrame, what: str) -> DataFrame:
    """Lists with members of several roots: key, number n of members, and root of each member.

    A long list is summed map-side; its rows then meet the one row of its key in a join that can be split.
    """
    rooted = common.written(_with_root(lists.select("key", "a", "n_a", "flags"), roots, "a", "root"), what)
    several = rooted.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count(F.lit(1)).alias("n")).where("_lo <> _hi")
    return rooted.join(several.select("key", "n"), "key")


def _least() -> Column:
    """The row of smallest doc_id (null last) and text_key."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))


def join_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and text_key of each document."""
    return _rooted_classes(docs).drop("root")


def _rooted_classes(docs: DataFrame) -> DataFrame:
    """``join_classes`` with the root of each class, null where there are no shingles."""
    spark = docs.sparkSession
    common.bounded_batches(spark, 128)
    all_docs = common.written(measured(docs), "join-sets")
    n_docs = all_docs.count()
    full = all_docs.where("n_shingles > 0")
    sets = common.written(full.groupBy("fp").agg(_least().alias("_l"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")).select("fp", "_l.doc_id", "_l.text_key", "n_shingles", "sketch"), "join-reps")
    hot = frequent_shingles(docs, n_docs)
    found = common.written(candidates(keyed_blobs(docs, hot, common.width(spark))), "join-candidates")
    hubs = common.written(found.where("kind = 0").groupBy("a", "b").agg(F.sum("flags").alias("shared")), "join-hubs")
    # first each set with the candidate that it shares most keys with
    ends = hubs.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e"), "shared").select("e.x", "e.y", "shared")
    best = ends.groupBy("x").agg(F.max_by("y", F.struct("shared", "y")).alias("y"))
    first = best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    roots = components(verified(plausible(first, sets), docs))
    twos = found.where("kind = 2").select("a", "b").distinct()
    lists = found.where("kind = 1").select("key", "a", "n_a", "flags").dropDuplicates(["key", "a"])
    sketches = sets.select(F.col("fp").alias("a"), "sketch")
    parts = common.width(spark)
    # then along trees that span what is still apart in a list
    apart = common.written(_apart(lists, roots, "join-rooted"), "join-lists")
    spans = common.written(spanning_pairs(apart.join(sketches, "a"), parts).distinct().join(first, ["a", "b"], "left_anti"), "join-spans")
    roots = extended(roots, verified(plausible(spans, sets), docs))
    # then what may still join components: pairs from lists of two, and the open members of longer lists with their sets
    rest = _with_root(_with_root(twos, roots, "a", "_ra"), roots, "b", "_rb").where("_ra <> _rb").select("a", "b").join(first.union(spans), ["a", "b"], "left_anti")
    still = common.written(_apart(apart, roots, "join-rooted"), "join-lists")
    members = common.written(open_members(still.join(sketches, "a"), parts).distinct(), "join-open")
    joining = joining_links(with_elements(members, sets, docs), parts)
    final = extended(roots, verified(plausible(rest, sets), docs).union(joining))
    labelled = sets.select("fp", "doc_id").join(final.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = labelled.join(least, "root").select("fp", "component_id", "root")
    out = full.join(classes, "fp", "left").select("doc_id", "n_shingles", "component_id", "text_key", "root")
    alone = all_docs.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_key", F.lit(None).cast("long").alias("root"))
    return out.union(alone)


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: the one of smallest doc_id. Rows without words all stay."""
    classes = _rooted_classes(docs).where("n_shingles > 0 and doc_id <=> component_id")
    key, doc, row = common.free(docs.columns, "key", "doc", "row")
    chosen = classes.groupBy("root").agg(_least().alias("_l")).select(F.col("_l.doc_id").alias("_id"), F.col("_l.text_key").alias("_key"))
    text = F.col("text").cast("string")
    wordless = ~F.regexp_like(F.coalesce(text, F.lit("")), F.lit(common.WORD))
    keyed = docs.where(~wordless).withColumn(key, F.xxhash64(text.cast("binary"))).withColumn(doc, F.col("doc_id").cast("long"))
    kept = keyed.alias("d").join(chosen.alias("c"), F.col(f"d.{doc}").eqNullSafe(F.col("c._id")) & (F.col(f"d.{key}") == F.col("c._key")), "left_semi")
    # of equal rows only one leaves each task: the window's limit of one is taken before the exchange
    first = kept.withColumn(row, F.row_number().over(Window.partitionBy(doc, key).orderBy(key))).where(F.col(row) == 1)
    own = [F.col(f"`{c}`") for c in docs.columns]
    return first.select(*own).union(docs.where(wordless).select(*own))
