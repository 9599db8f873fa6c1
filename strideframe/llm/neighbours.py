"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

The tree is fitted on unit vectors of a bounded sample (``SAMPLE`` vectors at most, by hash of the id);
every vector is indexed in its leaf. A query walks the tree through a priority queue of nodes by distance
to their centroids and visits as many leaves as calibration asks for: ``CALIBRATION`` vectors are compared
with all rows exactly, and visits are widened until ``target`` of their nearest are found (all leaves, if
it must be). Leaves that hold many vectors are searched in salted
blocks; of identical vectors in a block only the k + 1 of smallest id can be among the nearest.

Edge cases: vectors that are null, zero or hold null or non-finite components (or another number of
components than most) take no part; fewer than k candidates are all returned; ties go to the smaller id;
repeated ids are separate rows, each with its own list and each a candidate of the others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SAMPLE, BRANCH, LEAF = 16_384, 8, 16
TARGET, CALIBRATION = 0.95, 256
BLOCK = 2048
FLUSH_BYTES = 16 << 20


def usable(rows: list) -> list[int]:
    """Places of vectors that take part."""
    out = []
    for i, v in enumerate(rows):
        if v is not None and len(v) and not any(x is None for x in v):
            a = np.asarray(v, np.float64)
            if np.isfinite(a).all() and a.any():
                out.append(i)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    # scaled first: squares of very large or small components would leave the range of doubles
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``; the same for a pair wherever it stands."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Cluster number of each row by k-means; fewer clusters where rows are equal."""
    different = np.unique(x, axis=0)
    centres = different[rng.choice(len(different), min(k, len(different)), replace=False)]
    at = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        at = np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)
        kept = np.unique(at)
        centres = np.stack([x[at == c].mean(axis=0) for c in kept])
        at = np.searchsorted(kept, at)
    return at


class Tree:
    """Nodes with centroids; inner nodes have children, leaves have numbers."""

    def __init__(self, x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 5):
        self.centroids: list[np.ndarray] = []
        self.children: list[np.ndarray | None] = []
        self.leaf_of: list[int] = []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        stack = [(self._node(x), x)]
        while stack:
            node, rows = stack.pop()
            at = _means(rows, branch, rng) if len(rows) > leaf else np.zeros(len(rows), np.int64)
            if at.max(initial=0) == 0:
                self.leaf_of[node] = self.leaves
                self.leaves += 1
                continue
            kids = []
            for c in range(at.max() + 1):
                kids.append(self._node(rows[at == c]))
                stack.append((kids[-1], rows[at == c]))
            self.children[node] = np.array(kids)
        self.table = np.stack(self.centroids)
        self.squares = 0.5 * (self.table * self.table).sum(axis=1)

    def _node(self, rows: np.ndarray) -> int:
        self.centroids.append(rows.mean(axis=0))
        self.children.append(None)
        self.leaf_of.append(-1)
        return len(self.centroids) - 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by nearest child from the root."""
        node = np.zeros(len(x), np.int64)
        todo = {0: np.arange(len(x))}
        while todo:
            at, rows = todo.popitem()
            kids = self.children[at]
            if kids is None:
                node[rows] = at
                continue
            near = np.argmax(x[rows] @ self.table[kids].T - self.squares[kids], axis=1)
            for c in np.unique(near):
                todo[int(kids[c])] = rows[near == c]
        return np.array(self.leaf_of, np.int64)[node]

    def visits(self, q: np.ndarray, most: int, held: dict[int, int] | None = None, need: int = 0) -> list[int]:
        """``most`` leaves, best bin first; more if these hold fewer than ``need`` vectors (``held``: vectors of each leaf)."""
        queue, out, met = [(0.0, 0)], [], 0
        while queue and (len(out) < most or held is not None and met < need):
            _, at = heapq.heappop(queue)
            kids = self.children[at]
            if kids is None:
                out.append(self.leaf_of[at])
                met += held.get(out[-1], 0) if held else 0
                continue
            for d, c in zip((self.squares[kids] - self.table[kids] @ q).tolist(), kids.tolist()):
                heapq.heappush(queue, (d, c))
        return out


def calibrate(tree: Tree, index: DataFrame, dim: int, k: int, target: float = TARGET, queries: int = CALIBRATION) -> int:
    """Leaf visits with which ``target`` of the exact nearest of some indexed vectors are found.

    ``queries`` vectors, by hash, are compared with every row; only k rows of each come to the driver.
    """
    chosen = index.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id", "row").limit(queries).select("row", "raw").collect()
    ids = np.array([r["row"] for r in chosen], np.int64)
    q = np.array([np.frombuffer(r["raw"], np.float64) for r in chosen]).reshape(-1, dim)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec, row, raw, leaf = common.columns_of(batch, "vec_id", "row", "raw", "leaf")
            if not vec:
                continue
            near = _nearest(np.array(vec), np.array(row), np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim), ids, q, k)
            home = dict(zip(row, leaf))
            yield from near.append_column("leaf", pa.array([home[v] for v in near.column("row").to_pylist()], pa.int64())).combine_chunks().to_batches()

    near = index.select("vec_id", "row", "raw", "leaf").mapInArrow(compared, NEAR + ", leaf long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    needed: list[int] = []
    places = {int(i): {c: n for n, c in enumerate(tree.visits(unit(v[None, :])[0], tree.leaves))} for i, v in zip(ids, q)}
    for r in near.withColumn("_r", rank).where(F.col("_r") <= k).select("query", "leaf").collect():
        needed.append(places[r["query"]][r["leaf"]] + 1)
    return int(np.sort(needed)[int(np.ceil(target * len(needed))) - 1]) if needed else tree.leaves


NEAR = "query long, vec_id long, row long, score double"


def _nearest(ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, k: int) -> pa.Table:
    """Each query's nearest among a block of vectors; a query (known by its row) isn't its own neighbour."""
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, rows, vectors = ids[order], rows[order], vectors[order]
    fresh = np.append(True, (vectors[1:] != vectors[:-1]).any(axis=1))
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(ids)), 0))
    keep = np.arange(len(ids)) - first <= k
    ids, rows, vectors = ids[keep], rows[keep], vectors[keep]
    u, v = unit(vectors), unit(queries)
    found: list[tuple[np.ndarray, ...]] = []
    for a in range(0, len(v), 256):
        rough = v[a : a + 256] @ u.T
        rough[query_rows[a : a + 256, None] == rows[None, :]] = -np.inf
        edge = -np.partition(-rough, min(k, rough.shape[1]) - 1, axis=1)[:, min(k, rough.shape[1]) - 1]
        row, col = np.nonzero((rough >= edge[:, None] - 1e-9) & (rough > -np.inf))
        found.append((query_rows[a + row], ids[col], rows[col], cosines(queries[a + row], vectors[col])))
    return _best([pa.table(dict(zip(("query", "vec_id", "row", "score"), (np.concatenate(x) for x in zip(*found)))))], k)


def _no_rows() -> pa.Table:
    return pa.table({"query": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "row": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})


def _best(found: list[pa.Table], k: int) -> pa.Table:
    """The k nearest of each query in several tables, ties to the smaller id."""
    table = pa.concat_tables(found)
    q, c, r, s = (table.column(n).to_numpy() for n in ("query", "vec_id", "row", "score"))
    order = np.lexsort((r, c, -s, q))
    q, c, r, s = q[order], c[order], r[order], s[order]
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(np.append(True, q[1:] != q[:-1]), np.arange(len(q)), 0)) if len(q) else np.zeros(0, int)
    keep = rank < k
    return pa.table({"query": q[keep], "vec_id": c[keep], "row": r[keep], "score": s[keep]})


def search(table: DataFrame, is_query, k: int = 5, sample: int = SAMPLE, target: float = TARGET, visits: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest ``k`` rows found for each row where ``is_query`` holds."""
    spark = table.sparkSession
    common.bounded_batches(spark, 2000)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("is_query")).where("embedding is not null")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.where(finite & F.col("vec_id").isNotNull())
    n = rows.count()
    every = max(1, -(-n // sample))
    picked = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * sample).select("embedding").toArrow().column(0).to_pylist()
    if not picked:  # repeated ids can leave every hash out
        picked = rows.limit(sample).select("embedding").toArrow().column(0).to_pylist()
    good = [picked[i] for i in usable(picked)]
    if not good:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths, counts = np.unique([len(v) for v in good], return_counts=True)
    dim = int(lengths[np.argmax(counts)])
    x = unit(np.array([v for v in good if len(v) == dim], np.float64))
    tree = Tree(x)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36  # ids may repeat; written once, so a row keeps its number
        for batch in batches:
            ids, vectors, queries = common.columns_of(batch, "vec_id", "embedding", "is_query")
            good = [i for i in usable(vectors) if len(vectors[i]) == dim]
            if not good:
                continue
            m = np.array([vectors[i] for i in good], np.float64)
            leaf = tree.assign(unit(m))
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in good], pa.int64()), pa.array(np.arange(row, row + len(good))), pa.array([r.tobytes() for r in m], pa.binary()), pa.array([bool(queries[i]) for i in good]), pa.array(leaf)], names=["vec_id", "row", "raw", "is_query", "leaf"])
            row += len(good)

    index = common.written(rows.mapInArrow(indexed, "vec_id long, row long, raw binary, is_query boolean, leaf long"), "neighbours")
    many = visits or calibrate(tree, index, dim, k, target)
    sizes = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}  # at most the tree's leaves
    salts = spark.createDataFrame([(leaf, max(1, -(-c // BLOCK))) for leaf, c in sizes.items()] or [], "leaf long, salts long")

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries by leaf: one row for each leaf and some megabytes of queries."""
        held: dict[int, list[tuple[int, bytes]]] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            if held:
                leaves = sorted(held)
                ids = [np.array([i for i, _ in held[c]], np.int64).tobytes() for c in leaves]
                yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array(ids, pa.binary()), pa.array([b"".join(r for _, r in held[c]) for c in leaves], pa.binary())], names=["leaf", "ids", "raw"])
            held.clear()

        for batch in batches:
            for i, r in zip(*common.columns_of(batch, "row", "raw")):
                for c in tree.visits(unit(np.frombuffer(r, np.float64)[None, :])[0], many, sizes, k + 1):
                    held.setdefault(c, []).append((i, r))
                    size += len(r) + 8
                if size > FLUSH_BYTES:
                    yield from flushed()
                    size = 0
        yield from flushed()

    def met(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        """The nearest of each query over all leaves of a bucket."""
        joined = lambda t, c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
        found = [_no_rows()]
        if left.num_rows and right.num_rows:
            left, right = left.sort_by([("leaf", "ascending"), ("salt", "ascending")]), right.sort_by([("leaf", "ascending"), ("salt", "ascending")])
            place = lambda t: t.column("leaf").to_numpy() * (1 << 20) + t.column("salt").to_numpy()
            at, there = place(left), place(right)
            for p in np.intersect1d(at, there):
                x, y = (t.slice(lo, hi - lo) for t, (lo, hi) in ((left, np.searchsorted(at, [p, p + 1])), (right, np.searchsorted(there, [p, p + 1]))))
                found.append(_nearest(x.column("vec_id").to_numpy(), x.column("row").to_numpy(), joined(x, "raw", np.float64).reshape(-1, dim), joined(y, "ids", np.int64), joined(y, "raw", np.float64).reshape(-1, dim), k))
                if len(found) > 64:
                    found = [_best(found, k)]
        return _best(found, k)

    vectors = index.join(F.broadcast(salts), "leaf").withColumn("salt", F.pmod(F.xxhash64("row"), "salts")).select("leaf", "salt", "vec_id", "row", "raw")
    queries = index.where("is_query").select("row", "raw").repartition(common.width(spark)).mapInArrow(walked, "leaf long, ids binary, raw binary")
    queries = queries.join(F.broadcast(salts), "leaf").withColumn("salt", F.explode(F.expr("sequence(0L, salts - 1)"))).select("leaf", "salt", "ids", "raw")
    bucket = F.pmod(F.xxhash64("leaf", "salt"), F.lit(2 * common.width(spark)))
    near = vectors.withColumn("bucket", bucket).groupBy("bucket").cogroup(queries.withColumn("bucket", bucket).groupBy("bucket")).applyInArrow(met, NEAR)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    best = near.withColumn("rank", rank).where(F.col("rank") <= k).drop("row")
    names = index.where("is_query").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return best.join(names, "query").select("query_id", "rank", "vec_id", "score")
