"""What readers make of a file, and the tables it becomes."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

ATOMS = "atom_idx long, name string, resname string, resid int, resindex long, atomic_number short, mass double, charge double, chain string, bfactor double, occupancy double, type_name string, formal_charge int"
BONDS = "bond_idx long, i1 long, i2 long, order byte"
FRAMES = "frame_idx long, time double, box array<double>"
COORDS = "frame_idx long, atom_idx long, x double, y double, z double, vx double, vy double, vz double, fx double, fy double, fz double"
SCHEMAS = {"atoms": ATOMS, "bonds": BONDS, "frames": FRAMES, "coords": COORDS}


class FormatError(ValueError):
    """A file that its format doesn't allow."""


@dataclass
class Frame:
    time: float = 0.0
    box: list[float] | None = None  # a, b, c one after another, nm
    xyz: np.ndarray | None = None  # nm
    velocity: np.ndarray | None = None
    force: np.ndarray | None = None
    absent: np.ndarray | None = None  # atoms that the frame has a place for but doesn't hold; None: holds all

    def held(self) -> np.ndarray:
        """Places of the atoms that the frame holds."""
        return np.arange(len(self.xyz)) if self.absent is None else np.flatnonzero(~self.absent)


@dataclass
class Structure:
    """atoms: dicts with the columns of ATOMS that a format knows; bonds: (i1, i2, order)."""

    atoms: list[dict] = field(default_factory=list)
    bonds: list[tuple[int, int, int]] = field(default_factory=list)
    frames: list[Frame] = field(default_factory=list)

    def number_residues(self) -> Structure:
        at, last = -1, None
        for a in self.atoms:
            if at < 0 or a["resid"] != last:
                at, last = at + 1, a["resid"]
            a["resindex"] = at
        return self

    def rows(self, table: str) -> list[tuple]:
        if table == "atoms":
            names = [c.split()[0] for c in ATOMS.split(", ")]
            base = {"resname": "", "resid": 1, "mass": 0.0, "charge": 0.0, "chain": " ", "bfactor": 0.0, "occupancy": 1.0, "atomic_number": 0}
            return [tuple((base | a | {"atom_idx": i}).get(n) for n in names) for i, a in enumerate(self.atoms)]
        if table == "bonds":
            return [(k, a, b, order) for k, (a, b, order) in enumerate(self.bonds)]
        if table == "frames":
            return [(k, f.time, f.box) for k, f in enumerate(self.frames)]
        out = []
        for k, f in enumerate(self.frames):
            none = [(None, None, None)] * len(f.xyz)
            parts = [f.xyz.tolist(), f.velocity.tolist() if f.velocity is not None else none, f.force.tolist() if f.force is not None else none]
            rows = [(k, i, *p, *v, *w) for i, (p, v, w) in enumerate(zip(*parts, strict=True))]
            out += rows if f.absent is None else [rows[i] for i in f.held()]
        return out


def real(text: str, default: float = 0.0) -> float:
    try:
        return float(text)
    except ValueError:
        return default


def whole(text: str, default: int = 0) -> int:
    try:
        return int(text)
    except ValueError:
        return default
