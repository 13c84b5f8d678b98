"""Measures of selections: grouped aggregates over atoms (one row each, per frame or group).

Sums and moments are built-in aggregates; only 3x3 eigen- and singular-value problems go to numpy, on one row a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

AXES = ("x", "y", "z")


def _grouped(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def _positive(mass: Column) -> Column:
    return F.when(mass == 0, F.raise_error(F.lit("the mass of a selection is zero"))).otherwise(mass)


def min_max(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return _grouped(df, keys, *[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in AXES])


def unwrapped(df: DataFrame, keys: Sequence[str], box, dims: Sequence[int] = (1, 1, 1)) -> DataFrame:
    """Every atom as its image nearest to the first atom of its group."""
    first = _grouped(df, keys, *[F.min_by(c, "atom_idx").alias(f"_{c}0") for c in AXES])
    met = df.join(first, list(keys)) if keys else df.crossJoin(F.broadcast(first))
    at = g.closest_image(g.point(), tuple(F.col(f"_{c}0") for c in AXES), box, dims)
    return met.withColumns(dict(zip(AXES, at, strict=True))).select(*df.columns)


def center(df: DataFrame, keys: Sequence[str] = (), weighted: bool = False, box=None, dims: Sequence[int] = (1, 1, 1)) -> DataFrame:
    """x, y, z of the centre of geometry, or of mass; with a box over the images nearest to the first atom."""
    if box is not None:
        df = unwrapped(df, keys, box, dims)
    if not weighted:
        return _grouped(df, keys, *[F.avg(c).alias(c) for c in AXES])
    sums = _grouped(df, keys, F.sum("mass").alias("_m"), *[F.sum(F.col("mass") * F.col(c)).alias(f"_{c}") for c in AXES])
    return sums.select(*keys, *[(F.col(f"_{c}") / _positive(F.col("_m"))).alias(c) for c in AXES])


def moments(df: DataFrame, keys: Sequence[str] = (), box=None, dims: Sequence[int] = (1, 1, 1)) -> DataFrame:
    """Mass, centre of mass and weighted second moments about it (two passes, so that nothing cancels)."""
    if box is not None:
        df = unwrapped(df, keys, box, dims)
    c = center(df, keys, weighted=True).withColumnsRenamed({a: f"c{a}" for a in AXES})
    met = df.join(c, list(keys)) if keys else df.crossJoin(F.broadcast(c))
    d = {a: F.col(a) - F.col(f"c{a}") for a in AXES}
    pairs = [(p, q) for i, p in enumerate(AXES) for q in AXES[i:]]
    return _grouped(met, keys, F.sum("mass").alias("mass"), *[F.first(f"c{a}").alias(f"c{a}") for a in AXES], *[F.sum(F.col("mass") * d[p] * d[q]).alias(p + q) for p, q in pairs])


def gyration(df: DataFrame, keys: Sequence[str] = (), box=None, dims: Sequence[int] = (1, 1, 1)) -> DataFrame:
    m = moments(df, keys, box, dims)
    return m.select(*keys, F.sqrt((F.col("xx") + F.col("yy") + F.col("zz")) / _positive(F.col("mass"))).alias("gyration"))


def inertia_tensor(df: DataFrame, keys: Sequence[str] = (), box=None, dims: Sequence[int] = (1, 1, 1)) -> DataFrame:
    """ixx, iyy, izz, ixy, ixz, iyz about the centre of mass."""
    m = moments(df, keys, box, dims)
    xx, yy, zz = (F.col(a + a) for a in AXES)
    return m.select(*keys, "cx", "cy", "cz", (yy + zz).alias("ixx"), (xx + zz).alias("iyy"), (xx + yy).alias("izz"), (-F.col("xy")).alias("ixy"), (-F.col("xz")).alias("ixz"), (-F.col("yz")).alias("iyz"))


def principal_axes(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and right-handed axes (columns) of a symmetric tensor."""
    values, axes = np.linalg.eigh(t)
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), range(3)] < 0, -1, 1)
    axes[:, 2] = np.cross(axes[:, 0], axes[:, 1])
    return values, axes


def _by_row(df: DataFrame, columns: Sequence[str], keys: Sequence[str], fn, schema: str) -> DataFrame:
    """fn(values of columns) -> dict, for each of a few rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            made = [fn(v) for v in p[list(columns)].to_numpy(float)]
            yield pd.concat([p[list(keys)].reset_index(drop=True), pd.DataFrame(made)], axis=1) if keys else pd.DataFrame(made)

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in keys)
    return df.select(*keys, *columns).mapInPandas(run, f"{head}, {schema}" if keys else schema)


def inertia(df: DataFrame, keys: Sequence[str] = (), box=None, dims: Sequence[int] = (1, 1, 1)) -> DataFrame:
    """moments array (ascending) and axes array (three axes one after another)."""

    def fn(v):
        t = np.array([[v[0], v[3], v[4]], [v[3], v[1], v[5]], [v[4], v[5], v[2]]])
        values, axes = principal_axes(t)
        return {"moments": values.tolist(), "axes": axes.T.ravel().tolist()}

    return _by_row(inertia_tensor(df, keys, box, dims), ("ixx", "iyy", "izz", "ixy", "ixz", "iyz"), keys, fn, "moments array<double>, axes array<double>")


def principal_transform(df: DataFrame, keys: Sequence[str] = (), box=None, dims: Sequence[int] = (1, 1, 1)) -> DataFrame:
    """rotation (nine numbers by row) and shift that lay the principal axes along x, y, z, the centre of mass in place."""

    def fn(v):
        t = np.array([[v[0], v[3], v[4]], [v[3], v[1], v[5]], [v[4], v[5], v[2]]])
        r = np.linalg.inv(principal_axes(t)[1])
        c = v[6:9]
        return {"rotation": r.ravel().tolist(), "shift": (c - r @ c).tolist()}

    return _by_row(inertia_tensor(df, keys, box, dims), ("ixx", "iyy", "izz", "ixy", "ixz", "iyz", "cx", "cy", "cz"), keys, fn, "rotation array<double>, shift array<double>")


def paired(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Atoms of two selections matched by their order: keys, x1.., x2.., m1, m2. Sizes that differ are an error."""

    def ranked(df: DataFrame, n: int) -> DataFrame:
        w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("atom_idx")
        mass = F.col("mass") if "mass" in df.columns else F.lit(1.0)
        return df.select(*keys, (F.row_number().over(w)).alias("_n"), *[F.col(c).alias(f"{c}{n}") for c in AXES], mass.alias(f"m{n}"))

    met = ranked(a, 1).join(ranked(b, 2), [*keys, "_n"], "full")
    uneven = F.col("x1").isNull() | F.col("x2").isNull()
    return met.withColumn("x1", F.when(uneven, F.raise_error(F.lit("the selections differ in size"))).otherwise(F.col("x1")))


def rmsd(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), weighted: bool = False) -> DataFrame:
    """Root mean square deviation without a fit; weighted by the masses of a."""
    p = paired(a, b, keys)
    d2 = sum(((F.col(f"{c}2") - F.col(f"{c}1")) ** 2 for c in AXES), F.lit(0.0))
    if not weighted:
        return _grouped(p, keys, F.sqrt(F.avg(d2)).alias("rmsd"))
    sums = _grouped(p, keys, F.sum(F.col("m1") * d2).alias("_s"), F.sum("m1").alias("_m"))
    return sums.select(*keys, F.sqrt(F.col("_s") / _positive(F.col("_m"))).alias("rmsd"))


def covariance(p: DataFrame, keys: Sequence[str] = (), centred: bool = True) -> DataFrame:
    """Centres c1*, c2* and the nine sums k{xyz}{xyz} of m1 * r2 * r1 over pairs."""
    if centred:
        c = _grouped(p, keys, *[(F.sum(F.col(f"m{n}") * F.col(f"{a}{n}")) / F.sum(f"m{n}")).alias(f"c{n}{a}") for n in (1, 2) for a in AXES])
        p = p.join(c, list(keys)) if keys else p.crossJoin(F.broadcast(c))
    else:
        p = p.withColumns({f"c{n}{a}": F.lit(0.0) for n in (1, 2) for a in AXES})
    d = {(n, a): F.col(f"{a}{n}") - F.col(f"c{n}{a}") for n in (1, 2) for a in AXES}
    return _grouped(p, keys, *[F.first(f"c{n}{a}").alias(f"c{n}{a}") for n in (1, 2) for a in AXES], *[F.sum(F.col("m1") * d[2, p_] * d[1, q]).alias(f"k{p_}{q}") for p_ in AXES for q in AXES])


def kabsch(k: np.ndarray) -> np.ndarray:
    """The rotation that takes r1 onto r2, from the sums of r2 r1^T; never a reflection."""
    u, _, vt = np.linalg.svd(k)
    return u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt)) or 1]) @ vt


def fit_transform(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), centred: bool = True) -> DataFrame:
    """rotation (by row) and shift that superpose a on b best; centred False: rotation about the origin."""
    return fit_pairs(paired(a, b, keys), keys, centred)


def fit_pairs(p: DataFrame, keys: Sequence[str] = (), centred: bool = True) -> DataFrame:
    def fn(v):
        r = kabsch(v[6:].reshape(3, 3))
        return {"rotation": r.ravel().tolist(), "shift": (v[3:6] - r @ v[:3]).tolist()}

    columns = [f"c{n}{a}" for n in (1, 2) for a in AXES] + [f"k{p_}{q}" for p_ in AXES for q in AXES]
    return _by_row(covariance(p, keys, centred), columns, keys, fn, "rotation array<double>, shift array<double>")


def mean_std(df: DataFrame, value: str | Column, keys: Sequence[str] = ()) -> DataFrame:
    """n, mean and population deviation; nulls don't count."""
    v = F.col(value) if isinstance(value, str) else value
    return _grouped(df, keys, F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def mean_std_vec(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """The same for each place of an array: means and stds in order."""
    each = df.select(*keys, F.posexplode(value).alias("_i", "_v"))
    per = each.groupBy(*keys, "_i").agg(F.avg("_v").alias("m"), F.stddev_pop("_v").alias("s"))
    listed = F.array_sort(F.collect_list(F.struct("_i", "m", "s")))
    return _grouped(per, keys, listed.alias("_l")).select(*keys, F.col("_l.m").alias("means"), F.col("_l.s").alias("stds"))


def histogram(df: DataFrame, value: str | Column, low: float, high: float, bins: int, keys: Sequence[str] = (), density: bool = False) -> DataFrame:
    """bin, center, n of values in [low, high); others are dropped; density: n / (all counted * width)."""
    v = F.col(value) if isinstance(value, str) else value
    at = F.floor(bins * (v - low) / (high - low))
    counted = df.select(*keys, at.alias("bin")).where(F.col("bin").between(0, bins - 1)).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    width = (high - low) / bins
    out = counted.withColumn("center", low + (F.col("bin") + 0.5) * width)
    if density:
        w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        out = out.withColumn("density", F.col("n") / (F.sum("n").over(w) * width))
    return out


def counts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """n_atoms, n_residues and n_chains of the atoms."""
    return _grouped(df, keys, F.count(F.lit(1)).alias("n_atoms"), F.count_distinct("resid").alias("n_residues"), F.count_distinct("chain").alias("n_chains"))


def total_charge(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return _grouped(df, keys, F.sum(F.coalesce(F.col("formal_charge"), F.lit(0))).cast("double").alias("total_charge"))


def tail_order(df: DataFrame, keys: Sequence[str], normal: Sequence[str] = ("nx", "ny", "nz"), kind: str = "ScdCorr", order_col: str = "bond_order", carbon: str = "carbon") -> DataFrame:
    """Order parameter of each inner carbon of lipid tails: keys, carbon, order.

    df: per tail (keys) its carbons in sequence, with x, y, z, the local normal, and the order of the bond to the next
    carbon. kind: Sz (from the neighbours' direction), Scd, or ScdCorr (double bonds by their true angles).
    """
    w = Window.partitionBy(*keys).orderBy(carbon)
    at = lambda k: tuple((F.lead(c, k) if k > 0 else F.lag(c, -k) if k < 0 else F.col(c)).over(w) if k else F.col(c) for c in AXES)
    n = tuple(F.col(c) for c in normal)
    m2, m1, p0, q1, q2 = at(-2), at(-1), at(0), at(1), at(2)
    cos = lambda v: g.dot(v, n) / (g.norm(v) * g.norm(n))
    s = lambda a, b: 1.5 * a * b
    if kind == "Sz":
        value = s(cos(g.sub(q1, m1)), cos(g.sub(q1, m1))) - 0.5
    else:
        # single bonds on both sides
        z = g.unit(g.sub(q1, m1))
        x = g.unit(g.cross(g.sub(m1, p0), g.sub(q1, p0)))
        y = g.cross(x, z)
        single = -(2 * (s(cos(x), cos(x)) - 0.5) + s(cos(y), cos(y)) - 0.5) / 3

        def double(before: g.Vec, own: g.Vec, other: g.Vec, side: int) -> Column:
            """own is one end of the double bond, before its neighbour on the outside; side: +1 for the second end."""
            z = g.unit(g.sub(other, own)) if side < 0 else g.unit(g.sub(own, other))
            arm = g.sub(before, own) if side < 0 else g.sub(own, before)
            y = g.cross(g.unit(g.cross(arm, z)), z)
            szz, syy, syz = s(cos(z), cos(z)) - 0.5, s(cos(y), cos(y)) - 0.5, s(cos(y), cos(z))
            if kind == "Scd":
                return -(szz / 4 + 3 * syy / 4 + side * F.sqrt(F.lit(3.0)) * syz / 2)
            a = 0.5 * (F.pi() - g.angle(g.sub(before, own), g.sub(other, own)))
            return -(F.cos(a) ** 2 * syy + F.sin(a) ** 2 * szz + side * 2 * F.cos(a) * F.sin(a) * syz)

        before, after = F.lag(order_col).over(w), F.col(order_col)
        value = F.when(before == 2, double(q1, p0, m1, 1)).when(after == 2, double(m1, p0, q1, -1)).otherwise(single)
    inner = F.lag(carbon).over(w).isNotNull() & F.lead(carbon).over(w).isNotNull()
    return df.select(*keys, F.col(carbon), value.alias("order"), inner.alias("_in")).where("_in").drop("_in")


def sphere_points(n: int) -> np.ndarray:
    """n points spread evenly over the unit sphere."""
    k = np.arange(n) + 0.5
    phi, z = np.pi * (1 + 5**0.5) * k, 1 - 2 * k / n
    r = np.sqrt(1 - z * z)
    return np.stack((r * np.cos(phi), r * np.sin(phi), z), axis=1)


def sasa(df: DataFrame, keys: Sequence[str] = (), probe: float = 0.14, points: int = 500, radius: str = "vdw", largest: float = 0.25) -> DataFrame:
    """keys, atom_idx, area (nm2) and volume (nm3) of each atom's solvent sphere, by test points on it.

    Neighbours come from a grid join, so a task holds one atom and what touches it. largest bounds the radii.
    """
    from . import spatial

    r = df.select(*keys, "atom_idx", "x", "y", "z", (F.col(radius) + probe).alias("r"))
    met = spatial.vdw_pairs(r, r, 2 * (largest + probe), keys=keys, radius="r").where("i != j")
    j = r.select(*keys, F.col("atom_idx").alias("j"), F.struct("x", "y", "z", "r").alias("o"))
    lists = met.join(j, [*keys, "j"]).groupBy(*keys, F.col("i").alias("atom_idx")).agg(F.collect_list("o").alias("near"))
    full = r.join(lists, [*keys, "atom_idx"], "left")
    unit = sphere_points(points)
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in keys)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            area, volume = [], []
            for x, y, z, r_, near in zip(p.x, p.y, p.z, p.r, p.near, strict=True):
                at = np.array([x, y, z]) + r_ * unit
                free = np.ones(points, bool)
                for o in near if near is not None else ():
                    free &= ((at - (o["x"], o["y"], o["z"])) ** 2).sum(axis=1) >= o["r"] ** 2
                area.append(4 * np.pi * r_**2 * free.mean())
                volume.append(r_ * area[-1] / 3 + float(r_**2 * 4 * np.pi / 3 * (unit[free] @ np.array([x, y, z])).sum() / points))
            yield p[[*keys, "atom_idx"]].assign(area=area, volume=volume)

    return full.mapInPandas(run, f"{head}{', ' if head else ''}atom_idx long, area double, volume double")
