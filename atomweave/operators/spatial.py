"""Distance joins on a grid: an equi-join on cells and an exact test of the distance.

Points go to cells no thinner than the cutoff; one side is repeated for the 27 neighbouring cells, so a pair meets in
exactly one of them and needs no distinct. Of one set against itself half of the neighbours will do. Periodic cells are
counted along the widths between faces and neighbours wrap around. Where every periodic dimension of a fixed box has
three cells or more, the cell in which two points meet tells the image, and the distance is plain arithmetic; otherwise
the shortest image is looked for pair by pair, and where a dimension has fewer than three cells its repeated neighbours
are left out. The result is that of comparing all pairs. With keys (frames, groups) only points of equal keys meet.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g


def _cells(p: g.Vec, cutoff, m, dims: Sequence[int]) -> tuple[list[Column], list[Column | None]]:
    """Cell of each dimension, and the number of cells in periodic ones."""
    if m is None:
        return [F.floor(x / cutoff) for x in p], [None] * 3
    b = g.box(m)
    f, w = g.to_box(p, b), g.widths(b)
    n = [F.greatest(F.lit(1).cast("long"), F.floor(x / cutoff)) for x in w]
    cells = [F.least(F.floor((x - F.floor(x)) * k), k - 1) if d else F.floor(x * k) for x, k, d in zip(f, n, dims, strict=True)]
    return cells, [k if d else None for k, d in zip(n, dims, strict=True)]


def _side(df: DataFrame, keys: Sequence[str], tag: str, cutoff, m, dims, spread: bool) -> DataFrame:
    cells, counts = _cells(g.point(), cutoff, m, dims)
    if spread:
        near = [F.array(*[c + o for o in (-1, 0, 1)]) if n is None else F.array_distinct(F.array(*[F.pmod(c + o, n) for o in (-1, 0, 1)])) for c, n in zip(cells, counts, strict=True)]
    else:
        near = [F.array(c) for c in cells]
    kept = [F.col(k) for k in keys] + [F.col(c).alias(f"{tag}_{c}") for c in df.columns if c not in keys]
    out = df.select(*kept, *[n.alias(f"_n{i}") for i, n in enumerate(near)])
    if spread:
        for i in range(3):
            out = out.withColumn(f"_c{i}", F.explode(f"_n{i}"))
    else:
        out = out.withColumns({f"_c{i}": F.col(f"_n{i}")[0] for i in range(3)})
    return out.drop("_n0", "_n1", "_n2")


#: Cells are wider than the cutoff by this much, so that rounding never puts two points at the cutoff two cells apart.
_ROOM = 1 + 1e-9


#: Neighbours of a cell, itself included, and one half of them.
_AROUND = list(itertools.product((-1, 0, 1), repeat=3))
_HALF = [o for o in _AROUND if o >= (0, 0, 0)]


def _across(m: Sequence[float]) -> list[float]:
    """Distances between opposite faces of a box of numbers."""
    a, b, c = (m[i : i + 3] for i in (0, 3, 6))
    area = lambda p, q: math.hypot(p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0])
    return [abs(g.determinant_of(m)) / area(p, q) for p, q in ((b, c), (c, a), (a, b))]


def _told(cutoff: float, m, dims: Sequence[int]) -> bool:
    """Whether the cell in which two points meet tells their nearest image."""
    if m is None or g.skewed(m) is None:
        return m is None and cutoff > 0
    return cutoff > 0 and all(w >= 3 * cutoff * _ROOM for w, d in zip(_across([float(v) for v in m]), dims, strict=True) if d)


def _placed(df: DataFrame, keys: Sequence[str], tag: str, cutoff: float, m, dims: Sequence[int], offsets: Sequence[tuple[int, int, int]] | None) -> DataFrame:
    """Points with their cell _c and, along periodic dimensions, the number _s of box vectors between them and the box.

    offsets: one row for each of these neighbouring cells, _s then of the image that is next to it; _own: the point's own.
    """
    cell = cutoff * _ROOM
    f = g.point() if m is None else g.to_box(g.point(), g.box(m))
    many = [1 / cell] * 3 if m is None else [w / cell for w in _across([float(v) for v in m])]
    around = [int(k) if d and m is not None else None for k, d in zip(many, dims, strict=True)]
    kept = [F.col(k) for k in keys] + [F.col(c).alias(f"{tag}_{c}") for c in df.columns if c not in keys]
    out = df.select(*kept, *[x.alias(f"_f{i}") for i, x in enumerate(f)])
    for i, (k, n) in enumerate(zip(many, around, strict=True)):
        x = F.col(f"_f{i}")
        if n is None:
            out = out.withColumn(f"_c{i}", F.floor(x / cell) if m is None else F.floor(x * k))
        else:
            out = out.withColumns({f"_c{i}": F.least(F.floor((x - F.floor(x)) * n), F.lit(n - 1).cast("long")), f"_s{i}": F.floor(x).cast("double")})
    out = out.drop("_f0", "_f1", "_f2")
    if offsets is None:
        return out
    out = out.withColumn("_o", F.explode(F.array(*[F.struct(*[F.lit(v).cast("long").alias(f"o{i}") for i, v in enumerate(o)]) for o in offsets])))
    out = out.withColumns({"_own": (F.col("_o.o0") == 0) & (F.col("_o.o1") == 0) & (F.col("_o.o2") == 0), **{f"_c{i}": F.col(f"_c{i}") + F.col(f"_o.o{i}") for i in range(3)}})
    for i, n in enumerate(around):
        if n is not None:
            c = F.col(f"_c{i}")
            turn = F.when(c < 0, -1).when(c >= n, 1).otherwise(0)
            out = out.withColumns({f"_s{i}": F.col(f"_s{i}") + turn, f"_c{i}": c - turn * n})
    return out.drop("_o")


def _image(m, dims: Sequence[int]) -> g.Vec:
    """The difference of a and the image of b that _placed tells."""
    out = []
    for q in range(3):
        d = F.col(f"a_{'xyz'[q]}") - F.col(f"b_{'xyz'[q]}")
        for i in range(3):
            if m is not None and dims[i] and m[3 * i + q]:
                d = d + (F.col(f"_r_s{i}") - F.col(f"_s{i}")) * float(m[3 * i + q])
        out.append(d)
    return tuple(out)


def _meet(left: DataFrame, right: DataFrame, cutoff, reach: Column, m, dims, keys: Sequence[str], how: str = "inner", once: str | None = None) -> DataFrame:
    """Pairs (a_*, b_*) within reach; cutoff bounds reach and sizes the cells. once: of one set against itself, the id of
    whose points must differ; either may come as a."""
    on = [*keys, "_c0", "_c1", "_c2"]
    if _told(cutoff, m, dims):
        a = _placed(left, keys, "a", cutoff, m, dims, None)
        b = _placed(right, keys, "b", cutoff, m, dims, _HALF if once else _AROUND)
        b = b.withColumnsRenamed({k: f"_r{k}" for k in [*on, "_s0", "_s1", "_s2"]}).repartition(*[f"_r{k}" for k in on])
        d = g.norm(_image(m, dims))
        other = (F.col(f"a_{once}") < F.col(f"b_{once}")) | (~F.col("_own") & (F.col(f"a_{once}") > F.col(f"b_{once}"))) if once else None
    else:
        a = _side(left, keys, "a", cutoff, m, dims, False)
        b = _side(right, keys, "b", cutoff, m, dims, True).withColumnsRenamed({k: f"_r{k}" for k in on})
        d = g.distance(g.point("a_"), g.point("b_"), m, dims)
        other = F.col(f"a_{once}") < F.col(f"b_{once}") if once else None
    same = None
    for k in on:
        same = (F.col(k) == F.col(f"_r{k}")) if same is None else same & (F.col(k) == F.col(f"_r{k}"))
    met = a.join(b, same & (d <= reach) if other is None else same & other & (d <= reach), how)
    if how != "inner":
        return met.drop("_c0", "_c1", "_c2", "_s0", "_s1", "_s2")
    return met.withColumn("dist", d).drop(*[f"_r{k}" for k in on], "_c0", "_c1", "_c2", "_own", *[f"{r}_s{i}" for i in range(3) for r in ("", "_r")])


def pairs(left: DataFrame, right: DataFrame, cutoff: float, box=None, dims: Sequence[int] = (1, 1, 1), keys: Sequence[str] = (), id_col: str = "atom_idx") -> DataFrame:
    """keys, i, j, dist of all pairs (one point of each side) no farther apart than cutoff."""
    cols = [*keys, id_col, "x", "y", "z"]
    met = _meet(left.select(*cols), right.select(*cols), float(cutoff), F.lit(float(cutoff)), box, dims, keys)
    return met.select(*keys, F.col(f"a_{id_col}").alias("i"), F.col(f"b_{id_col}").alias("j"), "dist")


def self_pairs(points: DataFrame, cutoff: float, box=None, dims: Sequence[int] = (1, 1, 1), keys: Sequence[str] = (), id_col: str = "atom_idx") -> DataFrame:
    """Every unordered pair of one set once, i < j."""
    cols = [*keys, id_col, "x", "y", "z"]
    met = _meet(points.select(*cols), points.select(*cols), float(cutoff), F.lit(float(cutoff)), box, dims, keys, once=id_col)
    ids = F.col(f"a_{id_col}"), F.col(f"b_{id_col}")
    return met.select(*keys, F.least(*ids).alias("i"), F.greatest(*ids).alias("j"), "dist")


def vdw_pairs(left: DataFrame, right: DataFrame, largest: float, epsilon: float = 0.0, box=None, dims: Sequence[int] = (1, 1, 1), keys: Sequence[str] = (), id_col: str = "atom_idx", radius: str = "vdw") -> DataFrame:
    """Pairs no farther apart than the sum of their radii and epsilon; largest bounds that sum (twice the largest radius)."""
    cols = [*keys, id_col, "x", "y", "z", radius]
    reach = F.col(f"a_{radius}") + F.col(f"b_{radius}") + epsilon
    met = _meet(left.select(*cols), right.select(*cols), float(largest) + epsilon, reach, box, dims, keys)
    return met.select(*keys, F.col(f"a_{id_col}").alias("i"), F.col(f"b_{id_col}").alias("j"), "dist")


def within(atoms: DataFrame, inner: DataFrame, cutoff: float, box=None, dims: Sequence[int] = (1, 1, 1), keys: Sequence[str] = (), include_self: bool = False, id_col: str = "atom_idx") -> DataFrame:
    """Atoms with an inner atom at most cutoff away (a semi-join). Inner atoms among them count as their own neighbours.

    include_self: inner atoms that aren't among atoms are added, once each; columns that inner lacks are null.
    """
    own = inner.select(*[c for c in atoms.columns if c in inner.columns])
    inner = inner.select(*keys, id_col, "x", "y", "z")
    near = _meet(atoms, inner, float(cutoff), F.lit(float(cutoff)), box, dims, keys, "left_semi")
    near = near.select(*[F.col(c) if c in keys else F.col(f"a_{c}").alias(c) for c in atoms.columns])
    if not include_self:
        return near
    known = [*keys, id_col]
    return near.unionByName(own.join(atoms.select(*known), known, "left_anti").dropDuplicates(known), allowMissingColumns=True)


def neighbour_lists(found: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, atom, neighbours (sorted) from pairs, both ways."""
    both = found.select(*keys, F.col("i").alias("atom"), F.col("j").alias("other")).union(found.select(*keys, F.col("j"), F.col("i")))
    return both.groupBy(*keys, "atom").agg(F.array_sort(F.collect_set("other")).alias("neighbours"))


def neighbour_mean(df: DataFrame, pairs: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, i, n and the mean of columns over the n neighbours that pairs (i, j, each once) give to i."""
    both = pairs.select(*keys, "i", "j").union(pairs.select(*keys, "j", "i"))
    met = both.join(df.select(*keys, F.col("atom_idx").alias("j"), *columns), [*keys, "j"])
    return met.groupBy(*keys, "i").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])
