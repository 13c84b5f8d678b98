"""Changes of coordinates, attributes and composition: projections, unions and re-numbering."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import measure

AXES = ("x", "y", "z")


def _moved(df: DataFrame, at: g.Vec) -> DataFrame:
    return df.withColumns(dict(zip(AXES, at, strict=True)))


def translate(df: DataFrame, by: Sequence[float]) -> DataFrame:
    return _moved(df, g.add(g.point(), g.vec(by)))


def rotate(df: DataFrame, axis: Sequence[float], degrees: float) -> DataFrame:
    """About an axis through the origin."""
    return _moved(df, g.apply_matrix(g.point(), g.rotation(axis, math.radians(degrees))))


def transform(df: DataFrame, transforms: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Applies rotation (nine numbers by row) and shift, one transform a group."""
    t = transforms.select(*keys, F.col("rotation").alias("_r"), F.col("shift").alias("_s"))
    met = df.join(t, list(keys)) if keys else df.crossJoin(F.broadcast(t))
    m = [[F.col("_r")[3 * i + j] for j in range(3)] for i in range(3)]
    return _moved(met, g.apply_matrix(g.point(), m, [F.col("_s")[i] for i in range(3)])).select(*df.columns)


def unwrap_simple(df: DataFrame, box, keys: Sequence[str] = (), dims: Sequence[int] = (1, 1, 1)) -> DataFrame:
    return measure.unwrapped(df, keys, box, dims)


def wrap(df: DataFrame, box, dims: Sequence[int] = (1, 1, 1)) -> DataFrame:
    return _moved(df, g.wrap(g.point(), g.box(box), dims))


def set_same(df: DataFrame, selected: DataFrame | Column, keys: Sequence[str] = (), **values) -> DataFrame:
    """Gives attributes one value on the selected atoms."""
    if isinstance(selected, Column):
        return df.withColumns({c: F.when(selected, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})
    mark = selected.select(*keys, "atom_idx").distinct().withColumn("_own", F.lit(True))
    met = df.join(mark, [*keys, "atom_idx"], "left")
    return met.withColumns({c: F.when(F.col("_own"), F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}).select(*df.columns)


#: Atoms that are numbered in one task, about.
BUCKET = 1 << 16


def reindex(df: DataFrame, order: Sequence[str] = ("atom_idx",), keys: Sequence[str] = ()) -> DataFrame:
    """atom_idx from 0 without gaps; the old one as old_idx.

    order holds atom_idx. Rows are numbered within buckets of atom_idx (and of what comes before it in order), the
    numbers before a bucket come from one row a bucket.
    """
    parts = [f"_o{i}" for i in range(order.index("atom_idx") + 1)]
    dealt = df.withColumns({p: F.floor(F.col(c) / BUCKET) if c == "atom_idx" else F.col(c) for p, c in zip(parts, order, strict=False)})
    counts = dealt.groupBy(*keys, *parts).agg(F.count(F.lit(1)).alias("_n"))
    ahead = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*[F.col(c).alias(f"_b{c}") for c in (*keys, *parts)], F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    met = dealt.join(before, _same([*keys, *parts]))
    within = F.row_number().over(Window.partitionBy(*keys, *parts).orderBy(*order))
    numbered = met.withColumn("_row", within).withColumn("old_idx", F.col("atom_idx")).withColumn("atom_idx", (F.col("_before") + F.col("_row") - 1).cast("long"))
    return numbered.select(*[c for c in df.columns if c != "old_idx"], "old_idx")


def _same(columns: Sequence[str]) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).eqNullSafe(F.col(f"_b{c}"))
    return ok


def append(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """b after a, numbered on; a may be empty."""
    both = a.withColumn("_part", F.lit(0)).unionByName(b.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    return reindex(both, ("_part", "atom_idx"), keys).drop("_part", "old_idx")


def remove(atoms: DataFrame, gone: DataFrame, bonds: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Atoms without those of gone, numbered anew, and the bonds among them."""
    left = reindex(atoms.join(gone.select("atom_idx"), "atom_idx", "left_anti"))
    if bonds is None:
        return left.drop("old_idx"), None
    new = left.select(F.col("old_idx"), F.col("atom_idx").alias("new"))
    b = bonds
    for c in ("i1", "i2"):
        b = b.join(new.withColumnsRenamed({"old_idx": c, "new": f"_{c}"}), c).drop(c).withColumnRenamed(f"_{c}", c)
    return left.drop("old_idx"), b.select(*bonds.columns)


def replicate(df: DataFrame, box: Sequence[float], n: Sequence[int]) -> tuple[DataFrame, list[float]]:
    """n[0] * n[1] * n[2] periodic images, image after image, and the box that holds them."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    grid = df.crossJoin(F.broadcast(total))
    for k, count in enumerate(n):
        grid = grid.withColumn(f"_i{k}", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    i = [F.col(f"_i{k}").cast("double") for k in range(3)]
    a, b, c = g.vectors(g.box(box))
    at = tuple(F.col(x) + i[0] * a[q] + i[1] * b[q] + i[2] * c[q] for q, x in enumerate(AXES))
    image = (F.col("_i0") * n[1] + F.col("_i1")) * n[2] + F.col("_i2")
    out = _moved(grid, at).withColumn("atom_idx", (image * F.col("_total") + F.col("atom_idx")).cast("long"))
    return out.select(*df.columns), [v * n[k // 3] for k, v in enumerate(box)]


def unwrap_connected(df: DataFrame, cutoff: float, box: Sequence[float], dims: Sequence[int] = (1, 1, 1), keys: Sequence[str] = ("group_id",)) -> DataFrame:
    """Unwraps each part (keys) along its graph of atoms no farther apart than cutoff; adds component (its least atom)."""
    import numpy as np
    import pandas as pd

    m = np.array(box, float).reshape(3, 3).T
    inverse = np.linalg.inv(m)

    def nearest(d):
        f = d @ inverse.T
        f -= np.rint(f) * np.array(dims)
        return f @ m.T

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("atom_idx").reset_index(drop=True)
        at = p[list(AXES)].to_numpy(float).copy()
        component = np.full(len(p), -1)
        for seed in range(len(p)):
            if component[seed] >= 0:
                continue
            component[seed], todo = p.atom_idx[seed], [seed]
            while todo:
                i = todo.pop()
                free = np.flatnonzero(component < 0)
                d = nearest(at[free] - at[i])
                for j, v in zip(free, d, strict=True):
                    if v @ v <= cutoff * cutoff:
                        component[j] = p.atom_idx[seed]
                        at[j] = at[i] + v
                        todo.append(j)
        p[list(AXES)] = at
        return p.assign(component=component)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.groupBy(*keys).applyInPandas(run, f"{schema}, component long")
