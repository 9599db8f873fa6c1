"""Removal of repeated strings against a plain restatement; suffix arrays against sorting."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.llm import queries as llm
from strideframe.llm import suffix_dedup

from .helpers import ODD, documents, empty, extra, words


def restated(rows):
    """rows: (id or None, text). Each window's two smallest ids decide for all documents."""
    rank = lambda i: (i is None, i or 0)
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            first[w] = min(first.get(w, rank(i)), rank(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < rank(i):
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def got(docs, **k):
    return sorted(repr(tuple(r)) for r in suffix_dedup.digest(suffix_dedup.dedup(docs, **k)).collect())


def texts(seed):
    """Passages in several texts, near copies, exact copies, long repeats of one byte, cuts at 49, 50 and 51 bytes."""
    r = random.Random(seed)
    base = [words(r.randrange(5, 120), seed * 100 + i) for i in range(25)]
    passage, line = words(30, seed + 7), "x" * 130
    out = list(base)
    for b in base[:12]:
        k = r.randrange(len(b))
        out.append(b[:k] + passage[: r.randrange(len(passage))] + b[k:])
        out.append(b[:k] + r.choice("äéq ") + b[k + 1 :])
    out += [passage[3:52], passage[3:53], passage[3:54], "é" + passage, passage + "漢字", line, line[:49], line[:50], "y" + line + "y", base[0], base[0], words(400, 9) + passage + words(300, 8)]
    out += ["\x00" * 60, "\x00" * 49 + "a", "b" + "\x00" * 55, "ab" * 60, "ba" * 60]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("options", [{}, {"hot": 2}, {"slice_bytes": 900, "shard_bytes": 300}, {"slice_bytes": 2000, "hot": 4, "shard_bytes": 100}])
def test_restated(spark, options):
    own = texts(1) + ODD
    assert got(documents(spark, own).repartition(3), **options) == restated(list(enumerate(own)))


def test_ids_that_repeat_or_are_null(spark):
    own = texts(2)
    docs = extra(documents(spark, own)).withColumn("meta.url", F.lit("x"))
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 7 == 0, 7).otherwise(-F.col("doc_id")))
    docs = docs.union(docs.limit(9))
    assert got(docs, slice_bytes=3000) == restated([(r.doc_id, r.text) for r in docs.collect()])
    assert got(empty(spark)) == []


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    frame = llm.QUERIES["op11_suffix_dedup"](spark, sf_dir)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in frame.schema] == ["doc_id bigint", "n_bytes bigint", "n_removed bigint", "n_spans bigint", "kept_sha256 string"]
    found = sorted(repr(tuple(r)) for r in frame.collect())
    assert found == restated(rows)


@pytest.mark.parametrize("alphabet", [1, 2, 4, 256])
def test_suffix_arrays_and_common_prefixes(alphabet):
    r = np.random.default_rng(alphabet)
    data = r.integers(0, alphabet, 3000).astype(np.uint8)
    data[1500:1900] = data[200:600]
    raw = data.tobytes()
    order = suffix_dedup.suffix_array(data)
    inner = [i for i in order.tolist() if i <= len(data) - 50]
    assert sorted(order.tolist()) == list(range(len(data)))
    assert [raw[i : i + 50] for i in inner] == sorted(raw[i : i + 50] for i in inner)
    shared = suffix_dedup.common_prefixes(data, order)
    for k in range(1, len(order)):
        a, b = raw[order[k - 1] : order[k - 1] + 64], raw[order[k] : order[k] + 64]
        n = min(len(a), len(b))
        assert shared[k] == next((x for x in range(n) if a[x] != b[x]), n)


def test_steps_and_bounds_of_anchors(monkeypatch):
    """Equal windows name equal anchors wherever they stand; every window within a text is in one stretch."""
    r = np.random.default_rng(4)
    passage = r.integers(97, 101, 300).astype(np.uint8)
    texts = [r.integers(97, 101, n).astype(np.uint8) for n in (0, 49, 50, 51, 700, 0, 1200)] + [np.concatenate([[98], passage]), np.concatenate([passage, [97]])]
    data, lengths = np.concatenate(texts).astype(np.uint8), np.array([len(t) for t in texts])
    named = {}
    for step in (1 << 20, 128, 7):
        monkeypatch.setattr(suffix_dedup, "STEP", step)
        start, windows, key, text = suffix_dedup.anchors(data, lengths)
        place = np.repeat(start, windows) + np.concatenate([np.arange(w) for w in windows])
        ends = np.cumsum(lengths)
        assert place.tolist() == [i for e, n in zip(ends, lengths) for i in range(e - n, e - 49)]
        for i, k in zip(place.tolist(), np.repeat(key, windows).tolist()):
            assert named.setdefault(data[i : i + 50].tobytes(), k) == k
        assert (np.repeat(text, windows) == np.searchsorted(ends, place, "right")).all()
