"""2-D vector expressions. A vector is a pair of Columns ``(x, y)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column]


def vec(x, y) -> Vec:
    return (F.col(x) if isinstance(x, str) else x, F.col(y) if isinstance(y, str) else y)


def field(c: str | Column) -> Vec:
    c = F.col(c) if isinstance(c, str) else c
    return c["x"], c["y"]


def as_struct(v: Vec) -> Column:
    return F.struct(v[0].cast("double").alias("x"), v[1].cast("double").alias("y"))


def sub(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1]


def add(a: Vec, b: Vec) -> Vec:
    return a[0] + b[0], a[1] + b[1]


def scale(a: Vec, k) -> Vec:
    return a[0] * k, a[1] * k


def neg(a: Vec) -> Vec:
    return -a[0], -a[1]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1]


def cross(a: Vec, b: Vec) -> Column:
    return a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(a[0] * a[0] + a[1] * a[1])


def choose(cond: Column, a: Vec, b: Vec) -> Vec:
    return F.when(cond, a[0]).otherwise(b[0]), F.when(cond, a[1]).otherwise(b[1])


def unit(a: Vec, eps: float = 1e-9) -> Vec:
    """Unit vector, (1, 0) for a vanishing one."""
    n = norm(a)
    ok = n >= eps
    return F.when(ok, a[0] / n).otherwise(1.0), F.when(ok, a[1] / n).otherwise(0.0)


def _cosine(a: Vec, b: Vec) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b))))


def axial_angle(a: Vec, b: Vec, degenerate=90.0, eps: float = 1e-12) -> Column:
    """Angle between two undirected axes in degrees, 0..90."""
    fallback = F.lit(degenerate).cast("double")
    return F.when((norm(a) < eps) | (norm(b) < eps), fallback).otherwise(F.degrees(F.acos(F.abs(_cosine(a, b)))))


def directed_angle(a: Vec, b: Vec, degenerate=0.0, eps: float = 1e-12) -> Column:
    """Angle between two directed vectors in degrees, 0..180."""
    fallback = F.lit(degenerate).cast("double")
    return F.when((norm(a) < eps) | (norm(b) < eps), fallback).otherwise(F.degrees(F.acos(_cosine(a, b))))


def reflect(v: Vec, axis: Vec, eps: float = 1e-9) -> Vec:
    """Mirror ``v`` in the line through the origin along ``axis``."""
    n = unit(axis, eps)
    p = dot(v, n)
    return 2.0 * p * n[0] - v[0], 2.0 * p * n[1] - v[1]


def reflect_about(p: Vec, origin: Vec, axis: Vec) -> Vec:
    """Mirror point ``p`` in the line through ``origin`` along ``axis``."""
    return add(origin, reflect(sub(p, origin), axis, 1e-12))


def perpendicular(v: Vec) -> Vec:
    return -v[1], v[0]


def align_sign(v: Vec, ref: Vec) -> Vec:
    """Flip ``v`` when it points against ``ref``."""
    return choose(dot(v, ref) < 0.0, neg(v), v)


def handedness(a: Vec, b: Vec) -> Column:
    """Sign of the cross product with a relative tolerance; 0 when the vectors are parallel."""
    c = cross(a, b)
    tol = F.greatest(1e-6 * norm(a) * norm(b), F.lit(1e-9))
    return F.when(F.abs(c) <= tol, 0).when(c > 0, 1).otherwise(-1).cast("int")


def segments_cross(a1: Vec, a2: Vec, b1: Vec, b2: Vec, eps: float = 1e-9) -> Column:
    """Proper crossing only: shared end points and parallel segments do not count."""
    r, s, q = sub(a2, a1), sub(b2, b1), sub(b1, a1)
    den = cross(r, s)
    t = cross(q, s) / den
    u = cross(q, r) / den
    inside = (t > eps) & (t < 1.0 - eps) & (u > eps) & (u < 1.0 - eps)
    return F.when(F.abs(den) < 1e-12, False).otherwise(inside)


def quad_edges(q: list[Vec]) -> Column:
    """The four directed edges of a quadrilateral as an array of structs."""
    return F.array(*[
        F.struct(q[i][0].alias("ax"), q[i][1].alias("ay"), q[(i + 1) % 4][0].alias("bx"), q[(i + 1) % 4][1].alias("by")) for i in range(4)
    ])


def edges_cross(a: Column, b: Column) -> Column:
    """True when any edge of list ``a`` properly crosses one of list ``b``."""
    def test(e: Column, f: Column) -> Column:
        return segments_cross((e["ax"], e["ay"]), (e["bx"], e["by"]), (f["ax"], f["ay"]), (f["bx"], f["by"]))

    return F.exists(a, lambda e: F.exists(b, lambda f: test(e, f)))


def solve2(da: Vec, db: Vec, v: Vec, eps: float = 1e-9) -> Vec:
    """Coefficients of ``v`` on the basis (da, db); null for a singular basis."""
    det = cross(da, db)
    ok = F.abs(det) >= eps
    return F.when(ok, cross(v, db) / det), F.when(ok, cross(da, v) / det)
