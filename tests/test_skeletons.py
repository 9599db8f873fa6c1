"""Best rotation against singular values; skeletons folded in their rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.functions import vector
from strideframe.operators import pose


def matrix(q):
    x, y, z, w = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def fitted(a, b):
    u, _, vt = np.linalg.svd(b.T @ a)
    return u @ np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt))]) @ vt


def cases():
    r = np.random.default_rng(3)
    for n in (2, 3, 5):
        for noise in (0.0, 0.1, 2.0):
            for _ in range(8):
                a = r.normal(size=(n, 3))
                q = r.normal(size=4)
                yield "unique", a, a @ matrix(q / np.linalg.norm(q)).T + noise * r.normal(size=(n, 3))
    for axis in np.eye(3):  # half turns, and nearly half turns
        for w in (0.0, 1e-7, 1e-3):
            q = np.append(axis, w)
            a = r.normal(size=(3, 3))
            yield "unique", a, a @ matrix(q / np.linalg.norm(q)).T
    for _ in range(5):  # parallel vectors: any turn about them is as good
        d, e = r.normal(size=3), r.normal(size=3)
        yield "several", np.outer([1.0, 2.0, 0.5], d), np.outer([1.0, 2.0, 0.5], e)
    yield "several", np.eye(3)[:1], -np.eye(3)[:1]
    yield "several", np.eye(3), -np.eye(3)
    yield "several", np.diag([1.0, 1.0, 1.0]), np.diag([1.0, 1.0, -1.0])


def test_best_rotation_is_the_best(spark):
    every = list(cases())
    rows = [(i, [tuple(map(float, v)) for v in a], [tuple(map(float, v)) for v in b]) for i, (_, a, b) in enumerate(every)] + [(-1, [], [])]
    df = spark.createDataFrame(rows, "i int, a array<struct<x:double,y:double,z:double>>, b array<struct<x:double,y:double,z:double>>")
    got = {r.i: np.array(r.q) for r in df.select("i", vector.best_rotation(F.col("a"), F.col("b")).alias("q")).collect()}
    assert got.pop(-1).tolist() == [0, 0, 0, 1]
    for i, (kind, a, b) in enumerate(every):
        m = matrix(got[i])
        assert np.linalg.norm(got[i]) == pytest.approx(1) and got[i][3] >= 0
        best = np.sum(fitted(a, b) * (b.T @ a))
        assert np.sum(m * (b.T @ a)) == pytest.approx(best, rel=1e-9, abs=1e-9), i
        values = np.linalg.svd(b.T @ a)[1]
        if kind == "unique" and values[1] - values[2] > 1e-2:
            assert np.abs(m - fitted(a, b)).max() < 1e-6, i


def test_parallel_vectors_take_the_shortest_turn(spark):
    r = np.random.default_rng(4)
    rows = [(tuple(map(float, r.normal(size=3))), tuple(map(float, r.normal(size=3)))) for _ in range(20)]
    df = spark.createDataFrame(rows, "a struct<x:double,y:double,z:double>, b struct<x:double,y:double,z:double>")
    for x in df.select(vector.best_rotation(F.array("a"), F.array("b")).alias("q"), vector.between(F.col("a"), F.col("b")).alias("s")).collect():
        assert np.abs(np.array(x.q) - np.array(x.s)).max() < 1e-5


def test_skeletons_without_closure(spark):
    """One exchange, no join of bones with bones; missing joints take what hangs on them along."""
    r = np.random.default_rng(5)
    rows = [("a", f, j, *map(float, r.normal(size=3))) for f in range(6) for j in range(17) if not (f == 2 and j == 8)]
    rows += [("a", 6, j, *(1.0, float(j == 0), 0.0)) for j in range(17)]  # all bones but those of the root without length
    df = spark.createDataFrame(rows, "clip_id string, frame long, joint int, x double, y double, z double")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plan = pose.constant_lengths(df)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", old)
    assert plan.count("Exchange hashpartitioning") <= 2
    got = {(x.frame, x.joint): np.array([x.x, x.y, x.z]) for x in pose.constant_lengths(df).collect()}
    p = {(f, j): np.array(v) for _, f, j, *v in rows}
    par = pose.H36M_PARENTS
    seg = {(f, j): p[f, j] - p[f, par[j]] for f, j in p if par[j] >= 0 and (f, par[j]) in p}
    bone = {j: np.median([np.linalg.norm(v) for (f, k), v in seg.items() if k == j]) for j in range(1, 17)}
    way = {}
    for f in range(7):
        for j in range(1, 17):
            d = seg.get((f, j))
            way[f, j] = d / np.linalg.norm(d) if d is not None and np.linalg.norm(d) >= 1e-8 else way.get((f - 1, j), np.array([0, 1.0, 0]))
    for f in range(7):
        for j in range(17):
            k, at = j, p.get((f, 0))
            while k > 0 and at is not None:
                at = at + way[f, k] * bone[k] if (f, k) in seg else None
                k = par[k]
            assert ((f, j) in got) == (at is not None), (f, j)
            if at is not None:
                assert np.allclose(got[f, j], at)
