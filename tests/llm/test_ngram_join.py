import random

import numpy as np
import pytest

from strideframe.llm import ngram_join as J
from strideframe.llm.components import components, extended

from .helpers import ODD, documents, empty, extra, words


def sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(texts):
    s = sets(texts)
    root = list(range(len(s)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(s[i]), find(i)) for i in range(len(s))]


def corpus(seed, n=60):
    """Random texts, copies with edits near the threshold, a passage that most share, and tiny ones."""
    r = random.Random(seed)
    shared = words(40, "shared").split()
    out = []
    while len(out) < n:
        base = words(r.choice([3, 5, 6, 8, 12, 20, 40, 90, 150, 300, 700]), r.random()).split()
        if r.random() < 0.5:
            at = r.randrange(len(base) + 1)
            base = base[:at] + shared + base[at:]
        out.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, max(1, len(w) // 40), max(1, len(w) // 35), max(1, len(w) // 30)])):
                k = r.randrange(len(w))
                w[k : k + r.choice([0, 1])] = [f"n{r.random()}"][: r.choice([0, 1])]
            out.append(" ".join(w).upper() if r.random() < 0.2 else " ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_classes_equal_brute_force(spark, seed):
    texts = corpus(seed) + ODD
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.join_classes(extra(documents(spark, texts))).collect())
    assert got == brute(texts)


def group(n, seed):
    """Near copies of one text with 0 to 14 changed words, many of them unlinked, and two exact copies of each tenth."""
    r = random.Random(seed)
    base = words(130, seed).split()
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(15)):
            w[r.randrange(len(w))] = f"n{r.random()}"
        out += [" ".join(w)] * (3 if i % 10 == 0 else 1)
    return out


@pytest.mark.parametrize("block", [4096, 16])
def test_a_large_group_of_near_copies_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(J, "LIST_BLOCK", block)
    texts = group(160, 3) + corpus(9, 20)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.join_classes(documents(spark, texts)).collect())
    assert got == brute(texts)


def test_list_stages_give_no_more_rows_than_lists_have_members(spark):
    """All members possible for all others: the open members and the joining links stay linear."""
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base, r.integers(0, 1 << 63, 12).astype(np.uint64)])) for _ in range(70)]
    rows = [(k, 70, i, len(s), 3, i, bytearray(J.parity_sketch(s)), bytearray(s.tobytes())) for k in (4, 9) for i, s in enumerate(sets)]
    lists = spark.createDataFrame(rows, "key long, n long, a long, n_a int, flags int, root long, sketch binary, elements binary")
    assert J.open_members(lists, 2).count() == 140 and J.open_members(lists, 2).distinct().count() == 70
    assert J.spanning_pairs(lists, 2).distinct().count() <= 69
    assert J.joining_links(lists, 2).count() == 0  # 60 of 84 shared: below 75 %
    linked = lists.where("a < 2").union(lists.where("a = 0").replace(0, 90, ["a", "root"]))
    assert [tuple(x) for x in J.joining_links(linked, 2).collect()] == [(0, 90)]


def test_every_pair_has_a_common_key_that_one_vouches_for():
    """The pigeonhole itself: for linked sets of any sizes, without any shortcut."""
    r = np.random.default_rng(5)
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint8))
    for n in [1, 2, 3, 4, 5, 7, 9, 14, 22, 60, 127, 128, 200, 399, 401, 900]:
        for _ in range(12):
            a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
            drop = int(r.integers(0, len(a) // 4 + 1))
            keep = np.sort(r.permutation(a)[: len(a) - drop])
            grow = 0
            while 100 * len(keep) >= 75 * (len(a) + grow + 1) and r.random() < 0.8:
                grow += 1
            b = np.unique(np.concatenate([keep, r.integers(0, 1 << 63, grow).astype(np.uint64)]))
            if 100 * len(np.intersect1d(a, b)) < 75 * len(np.union1d(a, b)):
                continue
            hot = none if r.random() < 0.5 else (a[::2].copy(), np.full(len(a[::2]), 3, np.uint8))
            keys, flags, owner = J.signatures([a, b], hot)
            x, y = ({(int(k), int(f)) for k, f, o in zip(keys, flags, owner) if o == i} for i in (0, 1))
            met = [(f, g) for k, f in x for q, g in y if k == q]
            assert any((f | g) & 1 and (f | g) & 2 for f, g in met), (len(a), len(b))


def test_sketch_never_exceeds_the_difference():
    r = np.random.default_rng(2)
    for _ in range(300):
        a, b = (np.unique(r.integers(0, 3000, int(r.integers(1, 900))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        assert J.sketch_distance(J.parity_sketch(a), J.parity_sketch(b)) <= len(np.setxor1d(a, b))


def test_bands_reach_the_next_one_only():
    for size in range(1, 5000):
        k = int(np.searchsorted(J.BANDS, size, "right")) - 1
        assert J.BANDS[k] <= size < J.BANDS[k + 1] and size * 4 // 3 < J.BANDS[k + 2]


def test_empty_table(spark):
    assert J.join_classes(empty(spark)).count() == 0
    assert J.representatives(empty(spark)).count() == 0


def test_representatives(spark):
    texts = [None, "", "one two three four five six", "ONE two three four five six", words(50, 1), words(50, 1) + " more", words(50, 2)]
    docs = documents(spark, texts).union(documents(spark, texts[:3]))
    kept = sorted((r.doc_id, r.text) for r in J.representatives(docs).select("doc_id", "text").collect() if r.text)
    assert [d for d, _ in kept] == [2, 4, 6]
    assert J.representatives(docs).where("text is null or text = ''").count() == 4


def test_representatives_with_clashing_names(spark):
    docs = documents(spark, [words(50, 1), words(50, 1) + " more", None, words(50, 2)])
    for c in ("_key", "_doc", "_row", "root", "fp", "text_key", "_id", "_l"):
        docs = docs.withColumn(c, docs["lang"])
    kept = J.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r["_key"], r["_row"]) for r in kept.collect()) == [(0, "en", "en"), (2, "en", "en"), (3, "en", "en")]


def test_null_and_repeated_ids_on_different_texts(spark):
    near = words(50, 1)
    rows = [(None, words(50, 2)), (None, words(50, 3)), (None, near), (None, near + " more"), (None, near), (7, words(50, 4)), (7, words(50, 5)), (7, words(50, 5) + " end"), (8, words(50, 4) + " end"), (9, words(50, 6)), (9, words(50, 6))]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in J.representatives(docs).collect()]
    start = lambda t: " ".join(t.split()[:50])
    assert sorted(start(t) for _, t in kept) == sorted(words(50, s) for s in range(1, 7))
    assert {start(t): d for d, t in kept} == {words(50, s): d for s, d in [(1, None), (2, None), (3, None), (4, 7), (5, 7), (6, 9)]}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (200, 150), (5, 3), (7, 7)]
    got = dict((r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(2, 61)}, 101: 100, 102: 100, 200: 150}


def test_links_found_later_join_roots(spark):
    r = random.Random(4)
    edges = [(r.randrange(90), r.randrange(90)) for _ in range(75)]
    least = list(range(90))
    for _ in range(90):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    made = lambda e: spark.createDataFrame(e, "a long, b long").coalesce(1)
    got = extended(components(made(edges[:50])), made(edges[50:]))
    assert dict((x.node, x.root) for x in got.collect()) == {n: m for n, m in enumerate(least) if n != m}
