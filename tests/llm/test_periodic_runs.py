"""Periodic runs against a plain restatement of the contract."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from strideframe.llm import periodic_runs
from strideframe.llm import queries as llm

from .helpers import ODD, documents, empty, extra


def brute(words):
    """start, length, period of every run, straight from the definition."""
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - s
            part = words[s : s + length]
            smallest = all(any(part[k] != part[k + r] for k in range(length - r)) for r in range(1, q))
            if length >= max(6, 4 * q) and smallest:
                found.add((s, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text, plant=True):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if plant and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    top = (None,) * 4 if best is None else (best[0], best[1], best[2], 1000 * best[1] // best[2])
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(found), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def key(row):
    return repr(tuple(row))


TEXTS = [
    "a " * 6, "a " * 5, "a b " * 4, "x a b a b a b a b y", "a b c " * 4 + "a", "a a a a a a b a a a a a a b a a a a a a b a a a a a a b z",
    "a b a b a b a b " * 3 + "c d c d c d c d", "x " + "a a b " * 5 + "b b b b b b b", "ä ö ä ö ä ö ä ö ß", "a\tb\na\x0bb\x0ca\rb a b",
]


def test_runs_equal_the_definition(spark):
    r = random.Random(3)
    texts = TEXTS + ODD + [" ".join(r.choice("ab") for _ in range(r.randrange(60))) for _ in range(80)] + [" ".join(r.choice("abc") for _ in range(r.randrange(90))) for _ in range(40)]
    docs = documents(spark, texts)
    got = periodic_runs.digest(periodic_runs.find(docs)).collect()
    assert sorted(map(key, got)) == sorted(key(expected(i, t, plant=False)) for i, t in enumerate(texts))


def test_planted_repeats_equal_the_definition(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = llm.QUERIES["op13_periodic_runs"](spark, sf_dir)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 6 + ["string"] * 2
    assert sorted(map(key, got.collect())) == sorted(key(expected(r.doc_id, r.text)) for r in docs.collect())


def test_odd_rows(spark):
    docs = extra(documents(spark, ODD + TEXTS)).withColumn("meta.url", periodic_runs.F.lit("x"))
    twice = docs.union(docs).union(docs.withColumn("doc_id", periodic_runs.F.lit(None).cast("long")))
    got = periodic_runs.digest(periodic_runs.find(periodic_runs.planted(twice))).collect()
    want = [expected(i, t) for i, t in enumerate(ODD + TEXTS)]
    assert sorted(map(key, got)) == sorted(map(key, want + want + [expected(None, t) for t in ODD + TEXTS]))
    assert periodic_runs.digest(periodic_runs.find(periodic_runs.planted(empty(spark)))).collect() == []


def test_long_text_and_small_chunks(monkeypatch):
    """One text of 30,000 words; pairs tested a few at a time give the same."""
    r = random.Random(5)
    block = [r.randrange(400) for _ in range(700)]
    numbers = np.array([r.randrange(400) for _ in range(4000)] + block * 5 + [1] * 9 + [r.randrange(3) for _ in range(2000)] + [7, 8] * 40)
    whole = periodic_runs.runs(numbers, np.array([len(numbers)]))
    assert any(p == 700 for _, _, p in whole.tolist())
    monkeypatch.setattr(periodic_runs, "PAIRS", 50)
    assert np.array_equal(whole, periodic_runs.runs(numbers, np.array([len(numbers)])))
    plain = periodic_runs._smallest(np.array(periodic_runs._plain_runs(numbers)))
    assert np.array_equal(whole, plain)


def test_equal_hashes_of_unequal_words_are_found_out(monkeypatch):
    """With a hash that calls all stretches equal every candidate is wrong, and words decide."""
    r = random.Random(6)
    texts = [[r.randrange(2) for _ in range(40)] for _ in range(9)]
    numbers, ends = np.array(sum(texts, [])), np.cumsum([40] * 9)
    right = periodic_runs.runs(numbers, ends)
    monkeypatch.setattr(periodic_runs.Hashes, "equal", lambda self, at, length, period: np.ones(len(at), bool))
    assert np.array_equal(right, periodic_runs.runs(numbers, ends))


@pytest.mark.parametrize("size", [0, 1, 3])
def test_texts_without_runs(size):
    assert len(periodic_runs.runs(np.arange(size), np.array([size]))) == 0
