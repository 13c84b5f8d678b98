"""A system of atoms with the coordinates of its frames, and selections of it, as objects over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import measure, modify, sequence, spatial
from .operators.selection import EmptySelectionError, select
from .sources import binary, files
from .sources import frames as by_frame
from .sources.model import COORDS


@dataclass(frozen=True)
class System:
    """Topology (atoms, bonds) and state (coords by frame). Changes give new systems.

    box: nine numbers, or the name of the column of coords that holds them frame by frame.
    """

    atoms: DataFrame
    coords: DataFrame
    bonds: DataFrame | None = None
    box: Sequence[float] | str | None = None
    keys: tuple[str, ...] = ("frame_idx",)

    @classmethod
    def open(cls, spark: SparkSession, path: str, trajectory: str | None = None) -> System:
        """Topology from path, coordinates from it or from a trajectory file."""
        atoms, bonds = files.read(spark, path, "atoms"), files.read(spark, path, "bonds")
        state = trajectory or path
        if files.extension(state) in binary.INDEXES:  # by ranges of frames
            coords = by_frame.read_frames(spark, state, [c.split()[0] for c in COORDS.split(", ")])
            frames = by_frame.read_frames(spark, state, ("frame_idx", "box"))
        else:
            coords, frames = files.read(spark, state, "coords"), files.read(spark, state, "frames").select("frame_idx", "box")
        boxes = frames.select("box").distinct().limit(2).collect()
        box = boxes[0]["box"] if boxes else None
        if len(boxes) > 1:  # it changes: every row has its frame's
            coords, box = coords.join(frames, "frame_idx", "left"), "box"
        return cls(atoms.drop("path", "mol_idx"), coords.drop("path", "mol_idx"), bonds.drop("path", "mol_idx"), box)

    def table(self) -> DataFrame:
        """Atoms joined with the coordinates of every frame."""
        return self.atoms.join(self.coords, "atom_idx")

    def __call__(self, what=None) -> Sel:
        """Everything; a text; a half-open pair of indices; a list of indices."""
        if what is None or what == "":
            return Sel(self, self.table())
        if isinstance(what, tuple) and len(what) == 2:
            what = range(*what)
        return Sel(self, select(self.table(), what, self.keys, self.box, self.bonds))

    def check_sizes(self) -> bool:
        """Whether every frame has as many atoms as the topology."""
        n = self.atoms.count()
        return self.coords.groupBy(*self.keys).count().where(F.col("count") != n).isEmpty()

    def with_coords(self, coords: DataFrame) -> System:
        return replace(self, coords=coords)

    def save(self, path: str) -> int:
        return files.write(path, self.atoms, self.coords, bonds=self.bonds)


@dataclass(frozen=True)
class Sel:
    """Some atoms of a system, in every frame."""

    system: System
    rows: DataFrame

    def __call__(self, what) -> Sel:
        """A part of the selection; a pair of indices is inclusive here."""
        if isinstance(what, tuple) and len(what) == 2:
            what = range(what[0], what[1] + 1)
        s = self.system
        return replace(self, rows=select(self.rows, what, s.keys, s.box, s.bonds))

    def __or__(self, other: Sel) -> Sel:
        return replace(self, rows=sequence.union(self.rows, other.rows, self.system.keys))

    def __and__(self, other: Sel) -> Sel:
        return replace(self, rows=sequence.intersect(self.rows, other.rows, self.system.keys))

    def __sub__(self, other: Sel) -> Sel:
        return replace(self, rows=sequence.difference(self.rows, other.rows, self.system.keys))

    def __invert__(self) -> Sel:
        return replace(self, rows=sequence.complement(self.system.table(), self.rows, self.system.keys))

    def checked(self) -> Sel:
        """Itself, or an error if it is empty (runs a job)."""
        if self.rows.isEmpty():
            raise EmptySelectionError("the selection is empty")
        return self

    def com(self, pbc: bool = False) -> DataFrame:
        return measure.center(self.rows, self.system.keys, True, self.system.box if pbc else None)

    def cog(self, pbc: bool = False) -> DataFrame:
        return measure.center(self.rows, self.system.keys, False, self.system.box if pbc else None)

    def min_max(self) -> DataFrame:
        return measure.min_max(self.rows, self.system.keys)

    def gyration(self) -> DataFrame:
        return measure.gyration(self.rows, self.system.keys)

    def inertia(self) -> DataFrame:
        return measure.inertia(self.rows, self.system.keys)

    def split(self, column: str) -> DataFrame:
        return sequence.split(self.rows, column, self.system.keys)

    def whole_residues(self) -> Sel:
        return replace(self, rows=sequence.whole(self.rows, self.system.table(), "resindex", self.system.keys))

    def neighbours(self, other: Sel | None, cutoff: float, pbc: bool = False) -> DataFrame:
        """Pairs within the selection, or with another one."""
        box = self.system.box if pbc else None
        if other is None:
            return spatial.self_pairs(self.rows, cutoff, box, keys=self.system.keys)
        return spatial.pairs(self.rows, other.rows, cutoff, box, keys=self.system.keys)

    def translate(self, by: Sequence[float]) -> Sel:
        return replace(self, rows=modify.translate(self.rows, by))
