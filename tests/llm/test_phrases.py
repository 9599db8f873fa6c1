"""Collocations against a plain restatement of the contract and against SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np

from strideframe.llm import phrases
from strideframe.llm import queries as llm

from .helpers import ODD, documents, empty, extra


def restated(rows, least=10, within=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        good = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in good.items():
            if any(100 * b >= within * a for q, b in good.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, _, left, right = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def run(docs, **k):
    return sorted(tuple(r) for r in phrases.ranked(phrases.mine(docs, **k)).collect())


def texts(seed, n=60):
    r = random.Random(seed)
    mark = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", "; ", "\x0b", " 'x' ", "\x00 ", " "]
    return ["".join(r.choice(["New", "york", "city", "hall", "of", "ÄB", "straße", "a"]) + r.choice(mark) for _ in range(r.randrange(80))) for _ in range(n)]


def test_restated(spark):
    own = texts(1) + ODD
    docs = documents(spark, own).union(documents(spark, texts(2), 500, None)).union(documents(spark, texts(3, 20), 900, "und"))
    want = restated([("en", t) for t in own] + [(None, t) for t in texts(2)] + [("und", t) for t in texts(3, 20)])
    assert len(want) > 50
    assert run(docs) == want


def test_ties_top_and_repeated_rows(spark):
    docs = documents(spark, ["b c. a b. c d. x y z"] * 12 + ["q r s t"] * 10 + ["q r"] * 30)
    rows = [("en", r.text) for r in docs.collect()]
    assert run(docs) == restated(rows)
    assert sorted(tuple(r) for r in phrases.ranked(phrases.mine(docs), 2).collect()) == restated(rows, top=2)


def test_colliding_keys_and_a_full_map(spark, monkeypatch):
    """A map of eight bits lets all candidates pass, and slots tell phrases of one key apart."""
    one = documents(spark, texts(4))
    want = restated([("en", t) for t in texts(4)])
    assert run(one, map_bits=8) == want
    monkeypatch.setattr(phrases.Slots, "keys", staticmethod(lambda p: np.array([len(x) % 3 for x in p], np.uint64)))
    slots = phrases.Slots([b"a", b"b", b"dddd", b"ee", b"ff"])
    assert sorted(slots.of([b"a", b"b", b"dddd", b"ee", b"ff"]).tolist()) == list(range(5))
    assert slots.of([b"zz", b""]).tolist() == [-1, -1]


def test_products_beyond_64_bits(spark):
    """Scores of counts whose squares pass 64 bits."""
    big = 10**12
    counts = b"".join(x.to_bytes(8, "little") for x in (big, big - 1, big - 2))
    one = spark.createDataFrame([("en", 0, b"a\nb\na b", counts)], phrases.INDEX)
    got = phrases.scored(one, 1).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.score) for r in got] == [("a b", big - 2, big, big - 1, 1_000_000 * (big - 2) ** 2 // (big * (big - 1)))]


def test_odd_columns_and_empty_table(spark):
    docs = extra(documents(spark, texts(5))).withColumn("meta.url", phrases.F.lit("x")).withColumn("phrase", phrases.F.lit("x"))
    assert run(docs) == restated([("en", t) for t in texts(5)])
    assert run(empty(spark)) == []


def test_sql(spark, sf_dir):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = llm.QUERIES["op12_phrases"](spark, sf_dir)
    want = duck.sql(llm.ORACLE["op12_phrases"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
