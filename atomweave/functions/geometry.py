"""Vectors and periodic boxes as columns. A vector is a triple of columns, a box nine columns: a, b, c one after another."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
Box = Sequence[Column]


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def vec(x, y=None, z=None) -> Vec:
    """Of three numbers or columns, or of one sequence of them."""
    return tuple(col(v) for v in ((x, y, z) if y is not None else x))


def point(prefix: str = "", names: Sequence[str] = ("x", "y", "z")) -> Vec:
    return tuple(F.col(prefix + n) for n in names)


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def scale(a: Vec, s) -> Vec:
    return tuple(p * s for p in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec) -> Vec:
    return scale(a, 1.0 / norm(a))


def angle(a: Vec, b: Vec) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b)))))


# -- boxes ------------------------------------------------------------------------------------------------------


def box(values) -> list[Column]:
    """Nine columns of nine numbers, or of the name of an array column."""
    if isinstance(values, str):
        return [F.col(values)[i] for i in range(9)]
    return [col(v) for v in values]


def check_box(m: Sequence[float]) -> list[float]:
    """A box given as numbers, or ValueError for a zero vector or no volume."""
    m = [float(v) for v in m]
    if len(m) != 9 or any(math.hypot(*m[i : i + 3]) == 0 for i in (0, 3, 6)):
        raise ValueError("a box vector is zero")
    if abs(determinant_of(m)) < 1e-12:
        raise ValueError("the box has no volume")
    return m


def determinant_of(m: Sequence[float]) -> float:
    (a, b, c) = m[0:3], m[3:6], m[6:9]
    return a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])


def from_lengths_angles(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> list[float]:
    """Nine numbers from lengths and angles in degrees; angles below 60 are refused."""
    if min(alpha, beta, gamma) < 60:
        raise ValueError("box angles below 60 degrees are not supported")
    ca, cb, cg, sg = (math.cos(math.radians(alpha)), math.cos(math.radians(beta)), math.cos(math.radians(gamma)), math.sin(math.radians(gamma)))
    ca, cb, cg = (0.0 if x == 90 else v for x, v in ((alpha, ca), (beta, cb), (gamma, cg)))
    sg = 1.0 if gamma == 90 else sg
    cy = (ca - cb * cg) / sg
    return check_box([a, 0, 0, b * cg, b * sg, 0, c * cb, c * cy, c * math.sqrt(max(0.0, 1 - cb * cb - cy * cy))])


def vectors(m: Box) -> tuple[Vec, Vec, Vec]:
    return tuple(m[0:3]), tuple(m[3:6]), tuple(m[6:9])


def lengths_angles(m: Box) -> dict[str, Column]:
    """Lengths, and angles in degrees."""
    a, b, c = vectors(m)
    return {"a": norm(a), "b": norm(b), "c": norm(c), "alpha": F.degrees(angle(b, c)), "beta": F.degrees(angle(a, c)), "gamma": F.degrees(angle(a, b))}


def volume(m: Box) -> Column:
    a, b, c = vectors(m)
    return dot(a, cross(b, c))


def to_box(p: Vec, m: Box) -> Vec:
    """Fractional coordinates."""
    a, b, c = vectors(m)
    v = volume(m)
    return dot(p, cross(b, c)) / v, dot(p, cross(c, a)) / v, dot(p, cross(a, b)) / v


def to_lab(f: Vec, m: Box) -> Vec:
    a, b, c = vectors(m)
    return tuple(f[0] * a[i] + f[1] * b[i] + f[2] * c[i] for i in range(3))


def is_inside(p: Vec, m: Box) -> Column:
    f = to_box(p, m)
    ok = [(x >= 0) & (x < 1) for x in f]
    return ok[0] & ok[1] & ok[2]


def extents(m: Box) -> Vec:
    """Lengths of the box vectors."""
    return tuple(norm(v) for v in vectors(m))


def lab_extents(m: Box) -> Vec:
    """Sums of the components along each axis."""
    return tuple(m[i] + m[3 + i] + m[6 + i] for i in range(3))


def widths(m: Box) -> Vec:
    """Distances between opposite faces."""
    a, b, c = vectors(m)
    v = F.abs(volume(m))
    return v / norm(cross(b, c)), v / norm(cross(c, a)), v / norm(cross(a, b))


def is_triclinic(m: Box) -> Column:
    return (m[1] != 0) | (m[2] != 0) | (m[3] != 0) | (m[5] != 0) | (m[6] != 0) | (m[7] != 0)


def scale_vectors(m: Box, s: Sequence) -> list[Column]:
    return [v * s[i // 3] for i, v in enumerate(m)]


def wrap(p: Vec, m: Box, dims: Sequence[int] = (1, 1, 1)) -> Vec:
    """The image within the box along the periodic dimensions."""
    f = to_box(p, m)
    return to_lab(tuple(x - F.floor(x) if d else x for x, d in zip(f, dims, strict=True)), m)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def minimum_image(d: Vec, m: Box, dims: Sequence[int] = (1, 1, 1), triclinic: bool | None = None) -> Column:
    """The shortest image of a difference as a struct d (squared length), x, y, z.

    For skewed boxes and all dimensions the 26 neighbours of the rounded image are tried as well. triclinic: whether the
    box is known to be skewed (None: looked at row by row).
    """
    f = to_box(d, m)
    near = to_lab(tuple(x - F.rint(x) if p else x for x, p in zip(f, dims, strict=True)), m)
    measured = lambda t: F.struct(dot(t, t).alias("d"), t[0].alias("x"), t[1].alias("y"), t[2].alias("z"))
    a, b, c = vectors(m)

    def around(n: Column) -> Column:
        if triclinic is False or not all(dims):
            return measured((n["x"], n["y"], n["z"]))
        steps = [tuple(i * a[q] + j * b[q] + k * c[q] for q in range(3)) for i, j, k in itertools.product((-1, 0, 1), repeat=3)]
        shifts = F.array(*[F.struct(s[0].alias("x"), s[1].alias("y"), s[2].alias("z")) for s in steps])
        best = F.array_min(F.transform(shifts, lambda s: measured((n["x"] + s["x"], n["y"] + s["y"], n["z"] + s["z"]))))
        return best if triclinic else F.when(is_triclinic(m), best).otherwise(measured((n["x"], n["y"], n["z"])))

    return _let(F.struct(near[0].alias("x"), near[1].alias("y"), near[2].alias("z")), around)


def shortest(d: Vec, m: Box, dims: Sequence[int] = (1, 1, 1), triclinic: bool | None = None) -> Vec:
    """The components of minimum_image; of boxes known to be orthogonal by plain arithmetic."""
    if triclinic is False:
        f = to_box(d, m)
        return to_lab(tuple(x - F.rint(x) if p else x for x, p in zip(f, dims, strict=True)), m)
    best = minimum_image(d, m, dims, triclinic)
    return best["x"], best["y"], best["z"]


def skewed(values) -> bool | None:
    """For shortest: of a box of numbers whether it is skewed, None for a column."""
    return None if isinstance(values, str) or any(isinstance(v, Column) for v in values) else any(values[i] for i in (1, 2, 3, 5, 6, 7))


def distance(p: Vec, q: Vec, m=None, dims: Sequence[int] = (1, 1, 1)) -> Column:
    d = sub(p, q)
    if m is None:
        return norm(d)
    if skewed(m) is False:
        return norm(shortest(d, box(m), dims, False))
    return F.sqrt(minimum_image(d, box(m), dims, skewed(m))["d"])


def closest_image(p: Vec, target: Vec, m, dims: Sequence[int] = (1, 1, 1)) -> Vec:
    """The image of p nearest to target."""
    return add(target, shortest(sub(p, target), box(m), dims, skewed(m)))


def rotation(axis: Sequence[float], radians: float) -> list[list[float]]:
    """Matrix of a rotation about an axis through the origin."""
    n = math.sqrt(sum(v * v for v in axis))
    x, y, z = (v / n for v in axis)
    c, s = math.cos(radians), math.sin(radians)
    t = 1 - c
    return [[t * x * x + c, t * x * y - s * z, t * x * z + s * y], [t * x * y + s * z, t * y * y + c, t * y * z - s * x], [t * x * z - s * y, t * y * z + s * x, t * z * z + c]]


def apply_matrix(p: Vec, m: Sequence[Sequence], shift: Sequence = (0.0, 0.0, 0.0)) -> Vec:
    return tuple(m[i][0] * p[0] + m[i][1] * p[1] + m[i][2] * p[2] + shift[i] for i in range(3))
