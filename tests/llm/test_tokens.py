import zlib

import numpy as np
import pytest

from strideframe.llm import common, encoding, packing, token_files

from .helpers import ODD, documents, empty, extra, words

TEXTS = [*ODD, words(3000, 1), "<|endoftext|> and <|ENDOFTEXT|> it's we'll x'y", "x" * 9000, "tab\tand\x0bvt\x0cff\rcr \x01 mark \x01\x01"]


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(common.tokenizer_path())
    return [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in TEXTS]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("most", [40, 260_000])
def test_word_by_word_equals_whole_texts(ids, most):
    e = encoding.WordEncoder(common.tokenizer_path(), most)
    for _ in range(2):
        flat, counts = [], []
        for t in TEXTS:
            f, c = e.encode([None if t is None else t.encode()])
            flat += f.tolist()
            counts += c.tolist()
        assert flat == [i for x in ids for i in x[:-1]]
        assert counts == [len(x) - 1 for x in ids]


def test_files_read_back_by_key(spark, ids):
    docs = extra(documents(spark, TEXTS))
    shards = token_files.write_shards(docs, shard_ids=500)
    rows = sorted(token_files.read_documents(shards).collect())
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows] == [(i, starts[i], len(x), crc(x)) for i, x in enumerate(ids)]
    got = [token_files.Shard(r.asDict()) for r in shards.collect()]
    assert len(got) > 3
    for i, x in enumerate(ids):
        found = [s.ids_of(i) for s in got if s.ids_of(i) is not None]
        assert len(found) == 1 and found[0].tolist() == x
    assert all(s.ids_of(10_000 + i) is None for s in got for i in range(50))


def test_lookup_by_index(spark):
    whole = encoding.WordEncoder(common.tokenizer_path()).library
    ids = lambda t: whole.encode(t, add_special_tokens=False).ids
    docs = documents(spark, [words(60, i) for i in range(40)]).union(documents(spark, ["again", None], first=7))
    shards = token_files.write_shards(docs, shard_ids=400)
    rows = token_files.lookup(shards, [7, 3, 8, 12345]).collect()
    want = sorted([(7, words(60, 7)), (7, "again"), (3, words(60, 3)), (8, words(60, 8)), (8, "")])
    assert sorted((r.doc_id, r.ids) for r in rows) == sorted((d, ids(t) + [2]) for d, t in want)
    read = {(r.part, r.shard) for r in rows}
    assert len(read) < shards.count() and token_files.lookup(shards, []).count() == 0 and token_files.lookup(shards, [-5]).count() == 0


def test_files_of_repeated_and_null_ids(spark):
    docs = documents(spark, ["b", "a", "c"]).withColumn("doc_id", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast("long")).union(documents(spark, ["z z", "y"], 5)).union(documents(spark, ["z z", "x"], 5))
    rows = token_files.read_documents(token_files.write_shards(docs)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == [(False, 0)] * 3 + [(True, 5)] * 2 + [(True, 6)] * 2
    assert sorted(r.start for r in rows)[0] == 0 and len({r.start for r in rows}) == 7


def test_no_files_of_an_empty_table(spark):
    assert token_files.read_documents(token_files.write_shards(empty(spark))).count() == 0
    assert packing.pack(empty(spark)).count() == 0


def test_perfect_hash_is_minimal():
    keys = common.mix64(np.arange(20_000, dtype=np.uint64))
    f = token_files.PerfectHash.build(keys)
    assert sorted(f.slots(keys)) == list(range(20_000))
    raw, levels = f.packed()
    assert (token_files.PerfectHash.unpacked(raw, levels).slots(keys) == f.slots(keys)).all()
    assert 8 * len(raw) / 20_000 < 4.5


def test_other_tokenizers_encode_whole_texts(tmp_path):
    """A vocabulary that joins across white space: word by word would give other ids."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.BPE(vocab={"a": 0, " ": 1, "b": 2, " b": 3, "a b": 4}, merges=[(" ", "b"), ("a", " b")]))
    t.save(str(tmp_path / "t.json"))
    e = encoding.WordEncoder(str(tmp_path / "t.json"))
    flat, n = e.encode([b"a b", b"", None, b"b"])
    assert not e.by_words and flat.tolist() == [4, 2] and n.tolist() == [1, 0, 0, 1]
    assert encoding.WordEncoder(common.tokenizer_path()).by_words
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    assert not encoding.splits_at_white_space(__import__("json").loads(t.to_str()))


def plain_packer(lengths, capacity):
    """One piece after the other, longest first, into the open sequence that is filled least, else a new one: padding of all."""
    open_ = []
    for n in sorted(lengths, reverse=True):
        free = max((f for f in open_), default=0)
        if free >= n:
            open_.remove(free)
            open_.append(free - n)
        else:
            open_.append(capacity - n)
    return len(open_)


@pytest.mark.parametrize("seed", range(6))
def test_patterns_need_no_more_sequences_than_a_plain_packer(seed):
    import random

    r = random.Random(seed)
    lengths = [r.randrange(1, 65) for _ in range(400)] if seed % 2 else [r.choice([3, 9, 20, 33, 64]) for _ in range(400)]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    places, sequences = packing.shortest_pack_first(histogram, 64)
    fill = [0] * sequences
    for n in sorted(histogram, reverse=True):
        own = sorted(p for p in places if p[0] == n)
        for rank in range(histogram[n]):
            _, first_rank, first, offset = [p for p in own if p[1] <= rank][-1]
            at = first + rank - first_rank
            assert fill[at] == offset
            fill[at] += n
    assert max(fill) <= 64 and sum(fill) == sum(lengths)
    assert sequences <= plain_packer(lengths, 64) * 1.05 + 1


def test_packing_covers_every_id_once(spark, ids):
    rows = packing.pack(extra(documents(spark, TEXTS)), capacity=256).collect()
    assert sum(r.length for r in rows) == sum(map(len, ids))
    by_doc = {}
    for r in rows:
        assert 0 < r.length <= 256 and r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
    for d, parts in by_doc.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == len(ids[d])
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by_seq) == list(range(len(by_seq)))
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256


def test_shortest_pack_first_by_hand():
    places, n = packing.shortest_pack_first({6: 2, 4: 1, 3: 1, 1: 5}, 10)
    # two packs of 6; 4 fills one, 3 goes to the other, ones to the emptiest
    assert n == 3
    assert (6, 0, 0, 0) in places and (4, 0, 0, 6) in places and (3, 0, 1, 6) in places
    assert sum(1 for p in places if p[0] == 1) >= 2
    assert packing.padding(4096) == 0 and packing.padding(512) == 0 and packing.padding(4000) == 96


def test_little_padding():
    import random

    r = random.Random(3)
    h = {}
    for _ in range(20_000):
        n = min(4096, int(r.lognormvariate(6.5, 1)) + 1)
        h[n] = h.get(n, 0) + 1
    _, n = packing.shortest_pack_first(h)
    assert sum(k * c for k, c in h.items()) / (n * 4096) > 0.99


def test_copies_of_one_document_are_dealt_out(spark):
    """3,000 copies among 3,050 pieces: ranks stay gapless, and no bucket has more than twice the median's pieces."""
    from pyspark.sql import functions as F

    found = spark.range(3050).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit(0).cast("long").alias("start"), F.lit(12).cast("long").alias("length"), F.lit(5).cast("long").alias("ids_crc32"), F.lit(12).cast("long").alias("doc_tokens"), F.col("id").alias("_n"))
    assert sorted(r["rank"] for r in packing.ranked(found).collect()) == list(range(3050))
    dealt = [r["count"] for r in found.groupBy(F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "_n"), F.lit(8))).count().collect()]
    assert len(dealt) == 8 and max(dealt) <= 2 * sorted(dealt)[4]
