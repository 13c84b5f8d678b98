"""Secondary structure of proteins after Kabsch and Sander, one letter a residue, per frame.

Backbones, hydrogens and bends come from windows over residues; hydrogen bonds from a grid join of C=O and N-H groups;
the assembly of helices, ladders and stretches from one grouped function per frame over its residues and bonds.
Letters: H G I helices (4, 3, 5), B bridge, E strand, T turn, S bend, P polyproline, ~ coil, = break.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import spatial
from .selection import PROTEIN

#: Which letter stays when two apply; a break is never overwritten.
PRIORITY = {c: p for p, c in enumerate("~PSTIGEBH")} | {"=": 255}
#: Energy of a hydrogen bond in kcal/mol at most; factor of the energy for lengths in nm.
BOND_ENERGY, COULOMB = -0.5, 0.084 * 33.2


def backbones(atoms: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row a protein residue: n, ca, c, o (structs of x, y, z), h (rebuilt from the residue before), valid."""
    parts = {"n": ["N"], "ca": ["CA"], "c": ["C"], "o": ["O", "OT1", "OXT"]}
    at = lambda names: F.min_by(F.struct("x", "y", "z"), F.when(F.col("name").isin(*names), F.col("atom_idx")))
    found = atoms.where(F.col("resname").isin(*PROTEIN))
    rows = found.groupBy(*keys, "resindex").agg(F.first("resname").alias("resname"), *[at(v).alias(k) for k, v in parts.items()], *[F.max(F.col("name").isin(*v)).alias(f"_{k}") for k, v in parts.items()])
    rows = rows.withColumns({k: F.when(F.col(f"_{k}"), F.col(k)) for k in parts}).drop(*[f"_{k}" for k in parts])
    valid = F.col("n").isNotNull() & F.col("ca").isNotNull() & F.col("c").isNotNull() & F.col("o").isNotNull()
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("resindex")
    v = lambda c: tuple(F.col(c)[a] for a in "xyz")
    rows = rows.withColumn("valid", valid).withColumn("_lc", F.lag("c").over(w)).withColumn("_lo", F.lag("o").over(w)).withColumn("_lr", F.lag("resindex").over(w))
    h = g.add(v("n"), g.scale(g.unit(g.sub(v("_lc"), v("_lo"))), 0.1))
    has = (F.col("_lr") == F.col("resindex") - 1) & F.col("_lc").isNotNull() & F.col("_lo").isNotNull() & (F.col("resname") != "PRO")
    return rows.withColumn("h", F.when(has, F.struct(*[x.alias(a) for x, a in zip(h, "xyz", strict=True)]))).drop("_lc", "_lo", "_lr")


def hydrogen_bonds(residues: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, donor, acceptor (resindex), energy of the bonds between N-H and C=O at least two residues apart."""
    centre = residues.where("valid").select(*keys, F.col("resindex").alias("atom_idx"), "ca.x", "ca.y", "ca.z")
    near = spatial.self_pairs(centre, 0.9, keys=keys).where("abs(i - j) >= 2")
    both = near.select(*keys, F.col("i").alias("donor"), F.col("j").alias("acceptor")).union(near.select(*keys, "j", "i"))
    d = residues.where("valid and h is not null").select(*keys, F.col("resindex").alias("donor"), F.col("n").alias("dn"), F.col("h").alias("dh"))
    a = residues.where("valid").select(*keys, F.col("resindex").alias("acceptor"), F.col("c").alias("ac"), F.col("o").alias("ao"))
    met = both.join(d, [*keys, "donor"]).join(a, [*keys, "acceptor"])
    v = lambda c: tuple(F.col(c)[x] for x in "xyz")
    r = lambda p, q: g.norm(g.sub(v(p), v(q)))
    energy = COULOMB * (1 / r("ao", "dn") + 1 / r("ac", "dh") - 1 / r("ao", "dh") - 1 / r("ac", "dn"))
    return met.withColumn("energy", energy).where(F.col("energy") < BOND_ENERGY).select(*keys, "donor", "acceptor", "energy")


class Assembly:
    """Letters of one frame from its residues and bonds."""

    def __init__(self, residues: pd.DataFrame, bonds: set[tuple[int, int]]):
        self.r = residues.sort_values("resindex").reset_index(drop=True)
        place = {int(x): k for k, x in enumerate(self.r.resindex)}
        self.n, self.valid = len(self.r), self.r.valid.to_numpy(bool)
        self.bond = {(place[d], place[a]) for d, a in bonds if d in place and a in place}
        self.code = ["~" if v else "=" for v in self.valid]
        self.at = {k: np.array([[np.nan] * 3 if p is None else [p["x"], p["y"], p["z"]] for p in self.r[k]], float).reshape(-1, 3) for k in ("n", "ca", "c", "o")}

    def give(self, k: int, code: str) -> None:
        if PRIORITY[code] > PRIORITY[self.code[k]]:
            self.code[k] = code

    def helices(self) -> None:
        """4-turns first; residues that stronger letters hold block 3- and 5-helices."""
        for size, code, block in ((4, "H", 256), (3, "G", PRIORITY["E"]), (5, "I", PRIORITY["G"])):
            turn = [i + size < self.n and (i + size, i) in self.bond for i in range(self.n)]
            for i in range(self.n - 1):
                if turn[i] and turn[i + 1]:
                    span = range(i + 1, min(i + size, self.n - 1) + 1)
                    if all(PRIORITY[self.code[k]] < block for k in span):
                        for k in span:
                            self.give(k, code)
            for i in np.flatnonzero(turn):
                for k in range(i + 1, min(i + size, self.n)):
                    self.give(k, "T")

    def strands(self) -> None:
        """Bridges, ladders of them, and ladders joined over bulges of at most one residue on a side and four on the other."""
        b, bridges = self.bond, defaultdict(set)
        near = {(min(i, j) + s, max(i, j) + t) for i, j in b for s in (-1, 0, 1) for t in (-1, 0, 1)}
        whole = lambda k: 0 < k < self.n - 1 and self.valid[k - 1 : k + 2].all()
        for i, j in sorted(near):
            if j - i < 3 or not whole(i) or not whole(j):
                continue
            if ((j, i - 1) in b and (i + 1, j) in b) or ((i, j - 1) in b and (j + 1, i) in b):
                bridges["parallel"].add((i, j))
            if ((i, j) in b and (j, i) in b) or ((j + 1, i - 1) in b and (i + 1, j - 1) in b):
                bridges["anti"].add((i, j))
        strand, single = set(), set()
        for kind, found in bridges.items():
            step = 1 if kind == "parallel" else -1
            ladders = []
            for i, j in sorted(found):
                if (i - 1, j - step) in found:
                    continue
                ladder = [(i, j)]
                while (ladder[-1][0] + 1, ladder[-1][1] + step) in found:
                    ladder.append((ladder[-1][0] + 1, ladder[-1][1] + step))
                ladders.append(ladder)
            for ladder in ladders:
                (strand if len(ladder) > 1 else single).update(k for pair in ladder for k in pair)
            for p in ladders:
                for q in ladders:
                    gap_i, gap_j = q[0][0] - p[-1][0] - 1, (q[0][1] - p[-1][1]) * step - 1
                    if p is not q and min(gap_i, gap_j) >= 0 and max(gap_i, gap_j) <= 4 and min(gap_i, gap_j) <= 1:
                        ends = sorted((p[0][1], p[-1][1], q[0][1], q[-1][1]))
                        strand.update(range(p[0][0], q[-1][0] + 1), range(ends[0], ends[-1] + 1))
        for k in sorted(strand):
            self.give(k, "E")
        for k in sorted(single - strand):
            self.give(k, "B")

    def bends(self) -> None:
        ca = self.at["ca"]
        for i in range(2, self.n - 2):
            if self.valid[[i - 2, i, i + 2]].all():
                a, b = ca[i] - ca[i - 2], ca[i + 2] - ca[i]
                if np.degrees(np.arccos(np.clip(a @ b / np.linalg.norm(a) / np.linalg.norm(b), -1, 1))) >= 70:
                    self.give(i, "S")

    def polyproline(self) -> None:
        """Three residues in a row with phi near -75 and psi near 145 degrees."""
        ok = np.zeros(self.n, bool)
        for i in range(1, self.n - 1):
            if self.valid[i - 1 : i + 2].all():
                phi = dihedral(self.at["c"][i - 1], self.at["n"][i], self.at["ca"][i], self.at["c"][i])
                psi = dihedral(self.at["n"][i], self.at["ca"][i], self.at["c"][i], self.at["n"][i + 1])
                ok[i] = abs(phi + 75) <= 29 and abs(psi - 145) <= 29
        for i in range(1, self.n - 3):
            if ok[i : i + 3].all():
                for k in range(i, i + 3):
                    self.give(k, "P")

    def run(self) -> str:
        self.strands()
        self.helices()
        self.bends()
        self.polyproline()
        return "".join(self.code)


def dihedral(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> float:
    """Degrees, IUPAC sign."""
    u, v, w = b - a, c - b, d - c
    m, n = np.cross(u, v), np.cross(v, w)
    return float(np.degrees(np.arctan2(np.linalg.norm(v) * (u @ n), m @ n)))


def assign(atoms: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, resindex, ss of every protein residue."""
    own = list(keys) or ["_all"]
    if not keys:
        atoms = atoms.withColumn("_all", F.lit(0))
    res = backbones(atoms, own)
    bonds = hydrogen_bonds(res, own)
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in res.schema if f.name in own)

    def run(r: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(r):
            return pd.DataFrame(columns=[*own, "resindex", "ss"])
        code = Assembly(r, set(zip(b.donor, b.acceptor, strict=True)) if len(b) else set()).run()
        r = r.sort_values("resindex")
        return r[[*own, "resindex"]].assign(ss=list(code))

    bonds = bonds.withColumnsRenamed({k: f"_b_{k}" for k in own})  # the sides of a cogroup must not share columns
    out = res.groupBy(*own).cogroup(bonds.groupBy(*[f"_b_{k}" for k in own])).applyInPandas(run, f"{head}, resindex long, ss string")
    return out.drop("_all")


def ss_string(assigned: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, ss: the letters in order of residues."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("resindex", "ss"))), lambda s: s["ss"]), "")
    return (assigned.groupBy(*keys) if keys else assigned.groupBy()).agg(listed.alias("ss"))
