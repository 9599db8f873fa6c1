"""Vectors (struct x, y, z) and quaternions (struct x, y, z, w) as columns (VEC01-VEC15)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def let(*values: Column):
    """``let(a, b)(f)`` is ``f(a, b)`` with each value computed once.

    Columns are expressions, not values: what is used twice is written twice, and nested formulas would
    grow beyond all bounds. A lambda's argument is computed once.
    """

    def bound(f) -> Column:
        names = [f"_{i}" for i in range(len(values))]
        held = F.struct(*(v.alias(n) for v, n in zip(values, names)))
        return F.get(F.transform(F.array(held), lambda h: f(*(h[n] for n in names))), F.lit(0))

    return bound


def vec(x, y, z) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(lit(x).alias("x"), lit(y).alias("y"), lit(z).alias("z"))


def add(a: Column, b: Column) -> Column:
    return vec(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"])


def sub(a: Column, b: Column) -> Column:
    return vec(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def scale(a: Column, f) -> Column:
    return vec(a["x"] * f, a["y"] * f, a["z"] * f)


def mean(*points: Column) -> Column:
    """Mean of the points that aren't null; null if none is."""
    n = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in points[1:]), F.when(points[0].isNotNull(), 1).otherwise(0))
    part = lambda k: sum((F.coalesce(p[k], F.lit(0.0)) for p in points[1:]), F.coalesce(points[0][k], F.lit(0.0))) / n
    return F.when(n > 0, vec(part("x"), part("y"), part("z")))


def weighted(*terms: tuple[float, Column]) -> Column:
    part = lambda k: sum((w * p[k] for w, p in terms[1:]), terms[0][0] * terms[0][1][k])
    return vec(part("x"), part("y"), part("z"))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column, eps: float = EPS) -> Column:
    return let(a)(lambda v: scale(v, 1 / (norm(v) + eps)))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return vec(a["x"] + (b["x"] - a["x"]) * t, a["y"] + (b["y"] - a["y"]) * t, a["z"] + (b["z"] - a["z"]) * t)


def flip_y(a: Column) -> Column:
    """Change of basis that turns Y-down into Y-up."""
    return vec(a["x"], -a["y"], a["z"])


def swap_yz(a: Column) -> Column:
    return vec(a["x"], a["z"], a["y"])


def cycle_yzx(a: Column) -> Column:
    return vec(a["y"], a["z"], a["x"])


def array_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def array_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


# Quaternions


def quat(x, y, z, w) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(lit(x).alias("x"), lit(y).alias("y"), lit(z).alias("z"), lit(w).alias("w"))


IDENTITY = (0.0, 0.0, 0.0, 1.0)


def q_norm(q: Column) -> Column:
    return F.sqrt(q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"] + q["w"] * q["w"])


def q_unit(q: Column) -> Column:
    """Unit quaternion with w >= 0; the identity where the norm is 0."""

    def unit(q: Column, n: Column) -> Column:
        return let(F.try_divide(F.when(q["w"] < 0, -1.0).otherwise(1.0), n))(lambda s: F.when(n > 0, quat(q["x"] * s, q["y"] * s, q["z"] * s, q["w"] * s)).otherwise(quat(*IDENTITY)))

    return let(q)(lambda q: let(q_norm(q))(lambda n: unit(q, n)))


def q_mul(a: Column, b: Column) -> Column:
    return let(a, b)(_product)


def _product(a: Column, b: Column) -> Column:
    return quat(
        a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"],
        a["w"] * b["y"] - a["x"] * b["z"] + a["y"] * b["w"] + a["z"] * b["x"],
        a["w"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["w"],
        a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"],
    )


def q_inverse(q: Column) -> Column:
    """Inverse of a unit quaternion."""
    return quat(-q["x"], -q["y"], -q["z"], q["w"])


def q_local(parent: Column, world: Column) -> Column:
    return q_mul(q_inverse(parent), world)


def q_flip_y(q: Column) -> Column:
    """The rotation seen in the basis with Y turned round."""
    return quat(-q["x"], q["y"], -q["z"], q["w"])


def between(a: Column, b: Column) -> Column:
    """Shortest rotation from direction ``a`` to direction ``b``; half a turn about X (or Y) for opposite ones."""

    def turn(u: Column, c: Column, d: Column) -> Column:
        turned = F.when(F.abs(u["x"]) > 0.9, quat(0, 1, 0, 0)).otherwise(quat(1, 0, 0, 0))
        straight = norm(c) < EPS
        return F.when(straight & (d > 0.9999), quat(*IDENTITY)).when(straight & (d < -0.9999), turned).otherwise(q_unit(quat(c["x"], c["y"], c["z"], 1 + d)))

    return let(normalised(a), normalised(b))(lambda u, v: let(cross(u, v), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v))))(lambda c, d: turn(u, c, d)))


def slerp(a: Column, b: Column, t: Column) -> Column:
    """Along the shorter arc; straight and normalised where the ends nearly agree."""

    def arc(a: Column, b: Column, d: Column, t: Column) -> Column:
        sign = F.when(d < 0, -1.0).otherwise(1.0)
        near = F.abs(d) > 0.9995
        angle = F.acos(F.least(F.lit(1.0), F.abs(d)))
        p = F.when(near, 1 - t).otherwise(F.sin((1 - t) * angle) / F.sin(angle))
        q = F.when(near, t).otherwise(F.sin(t * angle) / F.sin(angle)) * sign
        mixed = let(p, q)(lambda p, q: quat(*(a[k] * p + b[k] * q for k in "xyzw")))
        return let(mixed)(lambda m: let(q_norm(m))(lambda n: quat(*(m[k] / n for k in "xyzw"))))

    inner = lambda a, b: a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"] + a["w"] * b["w"]
    return let(a, b, t)(lambda a, b, t: let(inner(a, b))(lambda d: arc(a, b, d, t)))


def euler_zxy(q: Column) -> Column:
    """Intrinsic Z, X, Y angles in degrees of a unit quaternion."""
    return let(q)(_euler_zxy)


def _euler_zxy(q: Column) -> Column:
    x, y, z, w = (q[k] for k in "xyzw")
    s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (y * z + w * x)))
    locked = F.abs(s) > 1 - 1e-12
    turn_z = F.when(locked, F.atan2(2 * (x * y + w * z), 1 - 2 * (y * y + z * z))).otherwise(F.atan2(-2 * (x * y - w * z), 1 - 2 * (x * x + z * z)))
    turn_y = F.when(locked, 0.0).otherwise(F.atan2(-2 * (x * z - w * y), 1 - 2 * (x * x + y * y)))
    k = 180 / math.pi
    return F.struct((turn_z * k).alias("z"), (F.asin(s) * k).alias("x"), (turn_y * k).alias("y"))


def from_axes(right: Column, up: Column, forward: Column) -> Column:
    """Quaternion of the rotation whose columns are three orthonormal axes."""
    return let(right, up, forward)(_from_axes)


def _from_axes(right: Column, up: Column, forward: Column) -> Column:
    m00, m10, m20 = right["x"], right["y"], right["z"]
    m01, m11, m21 = up["x"], up["y"], up["z"]
    m02, m12, m22 = forward["x"], forward["y"], forward["z"]
    root = lambda s: F.sqrt(F.greatest(F.lit(0.0), s)) / 2
    signed = lambda size, s: F.when(s < 0, -size).otherwise(size)
    w = root(1 + m00 + m11 + m22)
    general = quat(signed(root(1 + m00 - m11 - m22), m21 - m12), signed(root(1 - m00 + m11 - m22), m02 - m20), signed(root(1 - m00 - m11 + m22), m10 - m01), w)
    # half turns: the differences vanish, signs come from the sums
    x, y, z = root(1 + m00 - m11 - m22), root(1 - m00 + m11 - m22), root(1 - m00 - m11 + m22)
    half = F.when((x >= y) & (x >= z), quat(x, signed(y, m01 + m10), signed(z, m02 + m20), w)).when(y >= z, quat(signed(x, m01 + m10), y, signed(z, m12 + m21), w)).otherwise(quat(signed(x, m02 + m20), signed(y, m12 + m21), z, w))
    return q_unit(F.when(w < 1e-7, half).otherwise(general))


def basis_of(first: Column, second: Column) -> Column:
    """Frame of two directions: forward along the first, up at right angles towards the second."""
    one = lambda v: let(v)(lambda v: scale(v, 1 / F.greatest(norm(v), F.lit(EPS))))
    return let(one(first), second)(lambda forward, second: let(one(cross(second, forward)))(lambda right: from_axes(right, cross(forward, right), forward)))


def two_vector_fit(rest_a: Column, rest_b: Column, pose_a: Column, pose_b: Column) -> Column:
    """Rotation that takes the frame of two rest directions to that of two pose directions."""
    parallel = lambda a, b: let(normalised(a), normalised(b))(lambda u, v: let(cross(u, v))(lambda c: norm(c) < 1e-6))
    turned = lambda ra, rb, pa, pb: q_unit(q_mul(basis_of(pa, pb), let(basis_of(ra, rb))(q_inverse)))
    return let(rest_a, rest_b, pose_a, pose_b)(lambda ra, rb, pa, pb: F.when(parallel(ra, rb) | parallel(pa, pb), between(ra, pa)).otherwise(turned(ra, rb, pa, pb)))


def rotate(q: Column, v: Column) -> Column:
    return let(q, v)(_rotate)


def _rotate(q: Column, v: Column) -> Column:
    u = vec(q["x"], q["y"], q["z"])
    t = scale(cross(u, v), 2.0)
    return add(add(v, scale(t, q["w"])), cross(u, t))


def best_rotation(rest: Column, pose: Column, squarings: int = 36) -> Column:
    """Unit quaternion (w >= 0) of the rotation that takes the vectors ``rest`` to ``pose`` (arrays of x, y, z structs) with least
    squared error; of several equally good ones, the one of the smallest angle.

    The quaternion belongs to the largest eigenvalue of a symmetric 4 x 4 matrix. Squared again and again, that matrix (moved to be
    positive) becomes the projection on its eigenvectors, also where there are several; the projection of the identity is
    the quaternion sought, or that of another axis where the rotation is half a turn. Without vectors: the identity.
    """
    names = [a + b for a in "xyz" for b in "xyz"]

    def products(r: Column, p: Column) -> Column:
        return F.struct(*((r[n[0]] * p[n[1]]).alias(n) for n in names), F.sqrt(dot(r, r) * dot(p, p)).alias("n"))

    nothing = F.struct(*(F.lit(0.0).alias(n) for n in [*names, "n"]))
    held = F.aggregate(F.filter(F.zip_with(rest, pose, products), lambda s: s["n"].isNotNull()), nothing, lambda t, s: F.struct(*((t[n] + s[n]).alias(n) for n in [*names, "n"])))

    def matrix(s: Column) -> Column:
        # order w, x, y, z; entries on and above the diagonal
        d = {(0, 0): s["xx"] + s["yy"] + s["zz"], (1, 1): s["xx"] - s["yy"] - s["zz"], (2, 2): s["yy"] - s["xx"] - s["zz"], (3, 3): s["zz"] - s["xx"] - s["yy"]}
        d |= {(0, 1): s["yz"] - s["zy"], (0, 2): s["zx"] - s["xz"], (0, 3): s["xy"] - s["yx"], (1, 2): s["xy"] + s["yx"], (1, 3): s["zx"] + s["xz"], (2, 3): s["yz"] + s["zy"]}
        return F.struct(*(((d[i, j] + s["n"]) if i == j else d[i, j]).alias(f"m{i}{j}") for i in range(4) for j in range(i, 4)))

    def squared(m: Column) -> Column:
        at = lambda i, j: m[f"m{min(i, j)}{max(i, j)}"]
        trace = at(0, 0) + at(1, 1) + at(2, 2) + at(3, 3)
        return let(trace * trace)(lambda t: F.struct(*((sum((at(i, k) * at(k, j) for k in range(1, 4)), at(i, 0) * at(0, j)) / t).alias(f"m{i}{j}") for i in range(4) for j in range(i, 4))))

    def vector(m: Column) -> Column:
        at = lambda i, j: m[f"m{min(i, j)}{max(i, j)}"]
        column = lambda k: quat(at(1, k), at(2, k), at(3, k), at(0, k))
        trace = at(0, 0) + at(1, 1) + at(2, 2) + at(3, 3)
        # the identity's projection where it is long enough to be exact, else the longest of the others
        others = F.when((at(1, 1) >= at(2, 2)) & (at(1, 1) >= at(3, 3)), column(1)).when(at(2, 2) >= at(3, 3), column(2)).otherwise(column(3))
        return F.when(at(0, 0) > 1e-6 * trace, column(0)).otherwise(others)

    def fit(s: Column) -> Column:
        end = F.aggregate(F.sequence(F.lit(1), F.lit(squarings)), matrix(s), lambda m, _: squared(m))
        return F.when(s["n"] > EPS, let(end)(lambda m: q_unit(vector(m)))).otherwise(quat(*IDENTITY))

    return let(held)(fit)
