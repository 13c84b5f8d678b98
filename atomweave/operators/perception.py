"""Bond graphs of molecules: neighbours, components, rings, aromaticity and implicit hydrogens."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bond orders: 0 unspecified, 1 single, 2 double, 3 triple, 4 aromatic.
AROMATIC = 4
# Valences of neutral atoms by atomic number.
VALENCE = {1: 1, 5: 3, 6: 4, 7: 3, 8: 2, 9: 1, 15: 3, 16: 2, 17: 1, 35: 1, 53: 1}


def adjacency(bonds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, atom_idx, other, bond_idx, order: every bond from both ends; bonds of an atom with itself are left out."""
    b = bonds.where("i1 != i2")
    return b.select(*keys, F.col("i1").alias("atom_idx"), F.col("i2").alias("other"), "bond_idx", "order").union(b.select(*keys, "i2", "i1", "bond_idx", "order"))


def degrees(atoms: DataFrame, bonds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, atom_idx, degree, n_hydrogen and the number of bonds of each order."""
    z = atoms.select(*keys, F.col("atom_idx").alias("other"), F.col("atomic_number").alias("_z"))
    counts = {"n_single": F.col("order").isin(0, 1), "n_double": F.col("order") == 2, "n_triple": F.col("order") == 3, "n_aromatic": F.col("order") == 4, "n_hydrogen": F.col("_z") == 1}
    per = adjacency(bonds, keys).join(z, [*keys, "other"]).groupBy(*keys, "atom_idx").agg(F.count(F.lit(1)).alias("degree"), *[F.count_if(c).alias(k) for k, c in counts.items()])
    return atoms.select(*keys, "atom_idx").join(per, [*keys, "atom_idx"], "left").na.fill(0, ["degree", *counts])


def missing_orders(bonds: DataFrame) -> DataFrame:
    """Bonds whose order a file doesn't state."""
    return bonds.where("order = 0 or order is null")


def open_bonds(selected: DataFrame, bonds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Bonds that leave a selection; force-field typing needs none of them."""
    s = selected.select(*keys, "atom_idx").withColumn("_in", F.lit(1))
    for c in ("i1", "i2"):
        bonds = bonds.join(s.withColumnsRenamed({"atom_idx": c, "_in": f"_{c}"}), [*keys, c], "left")
    return bonds.where("(_i1 is null) != (_i2 is null)").drop("_i1", "_i2")


class Molecule:
    """One molecule's graph: z by atom (0..n-1), bonds (i, j, order)."""

    def __init__(self, z: Sequence[int], bonds: Sequence[tuple[int, int, int]]):
        self.z, self.bonds = list(z), [tuple(b) for b in bonds]
        self.near: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, (i, j, _) in enumerate(self.bonds):
            if i != j:
                self.near[i].append((j, k))
                self.near[j].append((i, k))

    def components(self) -> list[int]:
        """The least atom of each atom's component."""
        out = [-1] * len(self.z)
        for s in range(len(out)):
            if out[s] < 0:
                todo = [s]
                out[s] = s
                while todo:
                    for j, _ in self.near[todo.pop()]:
                        if out[j] < 0:
                            out[j] = s
                            todo.append(j)
        return out

    def cycle_through(self, bond: int) -> list[int] | None:
        """Atoms of a shortest cycle that a bond closes."""
        i, j, _ = self.bonds[bond]
        before, todo = {i: -1}, deque([i])
        while todo:
            a = todo.popleft()
            if a == j:
                path = [j]
                while before[path[-1]] >= 0:
                    path.append(before[path[-1]])
                return path
            for b, k in self.near[a]:
                if k != bond and b not in before:
                    before[b] = a
                    todo.append(b)
        return None

    def rings(self) -> list[list[int]]:
        """Smallest independent rings: shortest cycles by size, kept while they add to the space of cycles."""
        number = {frozenset(b[:2]): k for k, b in enumerate(self.bonds)}
        want = len(self.bonds) - len(self.z) + len(set(self.components()))
        found = {}
        for k in range(len(self.bonds)):
            if (c := self.cycle_through(k)) and len(c) > 2:
                found[frozenset(c)] = c
        basis: dict[int, int] = {}
        out = []
        for c in sorted(found.values(), key=lambda c: (len(c), sorted(c))):
            if len(out) >= want:
                break
            v = sum(1 << number[frozenset((a, b))] for a, b in zip(c, c[1:] + c[:1]))
            while v and (v.bit_length() in basis):
                v ^= basis[v.bit_length()]
            if v:
                basis[v.bit_length()] = v
                out.append(c)
        return out

    def is_aromatic(self, ring: list[int], ringed: set[int]) -> bool:
        """All bonds aromatic already, or 4n+2 electrons in a ring of 5 or 6 without sp3 atoms or outward double bonds."""
        if len(ring) not in (5, 6):
            return False
        edges = {frozenset((a, b)) for a, b in zip(ring, ring[1:] + ring[:1])}
        if all(order == AROMATIC for i, j, order in self.bonds if frozenset((i, j)) in edges):
            return True
        electrons = 0
        for a in ring:
            doubles = [j for j, k in self.near[a] if self.bonds[k][2] == 2]
            if any(j not in ringed for j in doubles):
                return False
            if self.z[a] == 6 and doubles:
                electrons += 1
            elif self.z[a] == 7:
                electrons += 1 if doubles else 2
            elif self.z[a] in (8, 16) and not doubles:
                electrons += 2
            else:
                return False
        return electrons in (2, 6, 10)

    def perceive(self) -> tuple[list[list[int]], list[bool]]:
        """Rings and, for each, whether it is aromatic by the orders as they came."""
        rings = self.rings()
        ringed = {a for r in rings for a in r}
        return rings, [self.is_aromatic(r, ringed) for r in rings]

    def implicit_hydrogens(self, charges: Sequence[int]) -> list[int]:
        smallest: dict[int, int] = {}
        for r in self.rings():
            for a in r:
                smallest[a] = min(smallest.get(a, 99), len(r))
        out = []
        for a, (z, q) in enumerate(zip(self.z, charges, strict=True)):
            base = VALENCE.get(z, 0)
            target = 0 if not base else max(0, base - abs(q)) if z == 6 else base + q if z in (7, 8, 15, 16) else max(0, base + q)
            flat = 1.0 if z in (8, 16) or (z == 7 and smallest.get(a) == 5) else 1.5
            used = sum({2: 2.0, 3: 3.0, 4: flat}.get(self.bonds[k][2], 1.0) for _, k in self.near[a])
            out.append(max(0, int(target - used + 0.5)) if target > used else 0)
        return out


def _per_molecule(atoms: DataFrame, bonds: DataFrame, key: str, fn, schema: str) -> DataFrame:
    """fn(atoms, graph) of each molecule; atoms in order of atom_idx, graph numbered 0..n-1."""
    a = atoms.select(key, "atom_idx", "atomic_number", F.coalesce("formal_charge", F.lit(0)).alias("formal_charge") if "formal_charge" in atoms.columns else F.lit(0).alias("formal_charge"))

    def run(p: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(p):
            return pd.DataFrame()
        p = p.sort_values("atom_idx").reset_index(drop=True)
        place = {i: k for k, i in enumerate(p.atom_idx)}
        b = b.sort_values("bond_idx") if len(b) else b
        edges = [(place[i], place[j], int(o)) for i, j, o in zip(b.i1, b.i2, b.order, strict=True) if i in place and j in place] if len(b) else []
        return fn(p, Molecule(p.atomic_number.tolist(), edges))

    return a.groupBy(key).cogroup(bonds.select(key, "bond_idx", "i1", "i2", "order").groupBy(key)).applyInPandas(run, schema)


def rings(atoms: DataFrame, bonds: DataFrame, key: str = "mol_id") -> DataFrame:
    """key, ring_idx, size, aromatic, atoms of the smallest independent rings of each molecule."""

    def fn(p: pd.DataFrame, m: Molecule) -> pd.DataFrame:
        found, flags = m.perceive()
        return pd.DataFrame([(p[key][0], k, len(r), f, sorted(p.atom_idx[a] for a in r)) for k, (r, f) in enumerate(zip(found, flags, strict=True))], columns=[key, "ring_idx", "size", "aromatic", "atoms"])

    kind = dict(atoms.dtypes)[key]
    return _per_molecule(atoms, bonds, key, fn, f"{key} {kind}, ring_idx int, size int, aromatic boolean, atoms array<long>")


def perceive(atoms: DataFrame, bonds: DataFrame, key: str = "mol_id") -> DataFrame:
    """key, atom_idx, in_ring, aromatic, implicit_h, component."""

    def fn(p: pd.DataFrame, m: Molecule) -> pd.DataFrame:
        found, flags = m.perceive()
        ringed, flat = {a for r in found for a in r}, {a for r, f in zip(found, flags, strict=True) if f for a in r}
        ids = range(len(p))
        return p[[key, "atom_idx"]].assign(in_ring=[i in ringed for i in ids], aromatic=[i in flat for i in ids], implicit_h=m.implicit_hydrogens(p.formal_charge.tolist()), component=[int(p.atom_idx[c]) for c in m.components()])

    kind = dict(atoms.dtypes)[key]
    return _per_molecule(atoms, bonds, key, fn, f"{key} {kind}, atom_idx long, in_ring boolean, aromatic boolean, implicit_h int, component long")


def aromatized(bonds: DataFrame, found: DataFrame, key: str = "mol_id") -> DataFrame:
    """Bonds with order 4 where both ends are neighbours in an aromatic ring (found: of rings)."""
    r = found.where("aromatic").select(key, F.explode("atoms").alias("i1"), "ring_idx")
    pairs = r.join(r.withColumnRenamed("i1", "i2"), [key, "ring_idx"]).where("i1 != i2").select(key, "i1", "i2").distinct().withColumn("_flat", F.lit(True))
    return bonds.join(pairs, [key, "i1", "i2"], "left").withColumn("order", F.when(F.col("_flat"), F.lit(4)).otherwise(F.col("order")).cast("byte")).select(*bonds.columns)


def equilibrate(atoms: DataFrame, key: str = "mol_id", e: str = "e", s: str = "s", total: str = "formal_charge") -> DataFrame:
    """Charges q = -e/s + (Q + sum(e/s)) / sum(1/s) / s: electronegativity e and hardness s to a total charge Q."""
    sums = atoms.groupBy(key).agg(F.sum(F.col(e) / F.col(s)).alias("_es"), F.sum(1 / F.col(s)).alias("_is"), F.sum(total).alias("_q"))
    return atoms.join(sums, key).withColumn("charge", -F.col(e) / F.col(s) + (F.col("_q") + F.col("_es")) / F.col("_is") / F.col(s)).drop("_es", "_is", "_q")
