"""Whole-system commands: last frame, rearranging, solvation and four-point water."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import modify, sequence, spatial
from .selection import select


def rearrange(atoms: DataFrame, begin: Sequence[str] = (), end: Sequence[str] = ()) -> DataFrame:
    """Atoms of the begin selections first, those of the end selections last, the rest between; numbered anew.

    An atom that two selections name is an error, found when the result is computed.
    """
    named = None
    for at, text in [*enumerate(begin), *enumerate(end, len(begin) + 1)]:
        part = select(atoms, text).select("atom_idx", F.lit(at).alias("_part"))
        named = part if named is None else named.unionByName(part)
    if named is None:
        return atoms
    once = named.groupBy("atom_idx").agg(F.min("_part").alias("_part"), F.count(F.lit(1)).alias("_n"))
    once = once.select("atom_idx", F.when(F.col("_n") > 1, F.raise_error(F.lit("selections overlap"))).otherwise(F.col("_part")).alias("_part"))
    met = atoms.join(once, "atom_idx", "left").withColumn("_part", F.coalesce("_part", F.lit(len(begin))))
    return modify.reindex(met, ("_part", "atom_idx")).drop("_part", "old_idx")


def solvate(solute: DataFrame, box: Sequence[float], solvent: DataFrame, solvent_box: Sequence[float], exclude: str | None = None, largest: float = 0.5) -> DataFrame:
    """Fills a box with whole solvent residues that lie in it and touch no solute atom (radii in column vdw).

    largest bounds the sum of two radii; exclude: a selection over the result that is taken out again.
    """
    copies = [int(-(-e // s)) for e, s in zip([sum(abs(box[k + 3 * i]) for i in range(3)) for k in range(3)], [solvent_box[0], solvent_box[4], solvent_box[8]], strict=True)]
    tiles, _ = modify.replicate(solvent, solvent_box, copies)
    size = F.broadcast(solvent.agg((F.max("resindex") + 1).alias("_r"), F.count(F.lit(1)).alias("_total")))
    tiles = tiles.crossJoin(size).withColumn("resindex", F.floor(F.col("atom_idx") / F.col("_total")) * F.col("_r") + F.col("resindex")).drop("_r", "_total")
    inside = tiles.groupBy("resindex").agg(F.bool_and(g.is_inside(g.point(), g.box(box))).alias("_in")).where("_in").select("resindex")
    tiles = tiles.join(inside, "resindex", "left_semi")
    touching = spatial.vdw_pairs(tiles, solute, largest, box=list(box)).select(F.col("i").alias("atom_idx")).distinct()
    bad = tiles.join(touching, "atom_idx", "left_semi").select("resindex").distinct()
    out = modify.append(solute, tiles.join(bad, "resindex", "left_anti").select(*[c for c in solute.columns if c in tiles.columns]))
    out = sequence.assign_resindex(out)
    if exclude:
        out, _ = modify.remove(out, select(out, exclude))
    return out


def tip3_to_tip4(atoms: DataFrame, distance: float = 0.01546) -> DataFrame:
    """Adds the massless site M to every TIP3 water, on the bisector of its hydrogens; other atoms stay."""
    water = atoms.where(F.col("resname") == "TIP3")
    at = lambda n: F.min_by(F.struct("x", "y", "z"), F.when(F.col("name").isin(*n), F.col("atom_idx")))
    sites = water.groupBy("resindex").agg(F.max("atom_idx").alias("_after"), F.first("resid").alias("resid"), F.first("chain").alias("chain"), at(["OH2", "OW", "O"]).alias("o"), at(["H1", "HW1"]).alias("h1"), at(["H2", "HW2"]).alias("h2"))
    v = lambda c: tuple(F.col(c)[a] for a in "xyz")
    middle = g.scale(g.add(g.sub(v("h1"), v("o")), g.sub(v("h2"), v("o"))), 0.5)
    m = g.add(v("o"), g.scale(g.unit(middle), distance))
    new = sites.select(F.col("_after").alias("atom_idx"), F.lit(1).alias("_part"), "resindex", "resid", "chain", F.lit("M").alias("name"), F.lit("TIP4").alias("resname"), F.lit(0.0).alias("mass"), *[x.alias(a) for x, a in zip(m, "xyz", strict=True)])
    old = atoms.withColumn("resname", F.when(F.col("resname") == "TIP3", "TIP4").otherwise(F.col("resname"))).withColumn("_part", F.lit(0))
    return modify.reindex(old.unionByName(new, allowMissingColumns=True), ("atom_idx", "_part")).drop("_part", "old_idx")
