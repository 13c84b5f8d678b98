"""Files of structures and trajectories as tables, and tables as files.

Reading is distributed by file through Spark's own file reader, so any store that Spark reaches will do: every row of
the result carries the path, and parsing happens in the tasks. Only the table asked for leaves them. Writing makes
the bytes of each frame in parallel and streams them into one file in order. Trajectories of many frames are read by
ranges of frames in module frames instead, atoms of ITP files by ranges of bytes in module lines.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary, lines, text
from .model import SCHEMAS, FormatError, Frame, Structure

_TEXT = {"pdb": text.read_pdb, "ent": text.read_pdb, "gro": text.read_gro, "xyz": text.read_xyz, "itp": text.read_itp}
_BINARY = {"xtc": binary.read_xtc, "trr": binary.read_trr, "dcd": binary.read_dcd, "nc": binary.read_netcdf, "ncdf": binary.read_netcdf}
_MOLECULES = ("sdf", "sd", "mol")
WRITERS = {"pdb": text.write_pdb, "ent": text.write_pdb, "gro": text.write_gro, "xyz": text.write_xyz, "sdf": text.write_sdf, "sd": text.write_sdf, "mol": lambda s: text.write_sdf(s, close=False)}
BINARY_WRITERS = {"xtc": binary.write_xtc, "trr": binary.write_trr, "dcd": binary.write_dcd, "nc": binary.write_netcdf}  # write() streams the last two


def extension(path: str) -> str:
    return os.path.splitext(path)[1][1:]


def parse(data: bytes, kind: str) -> list[Structure]:
    """The structures of a file of a kind (its lower-case extension); SDF may hold many."""
    if kind in _TEXT:
        return [_TEXT[kind](data.decode("utf-8", "replace"))]
    if kind in _BINARY:
        return [_BINARY[kind](data)]
    if kind in _MOLECULES:
        return text.read_sdf(data.decode("utf-8", "replace"))
    raise FormatError(f"files of kind {kind!r} are not recognised")


def read(spark: SparkSession, path: str | list[str], table: str = "atoms", mode: str = "FAILFAST", kind: str | None = None) -> DataFrame:
    """path, mol_idx and the columns of a table (atoms, bonds, frames, coords) of all files that path names.

    mode PERMISSIVE: a file that can't be parsed gives no rows.
    """
    if table == "atoms" and lines.suits(spark, path, kind):
        return lines.read_itp_atoms(spark, path)
    found = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [c.split()[0] for c in SCHEMAS[table].split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for where, data in zip(p.path, p.content, strict=True):
                try:
                    made = parse(bytes(data), kind or extension(where))
                except (ValueError, IndexError) as e:
                    if mode == "PERMISSIVE":
                        continue
                    raise FormatError(f"{where}: {e}") from e
                for m, s in enumerate(made):
                    yield pd.DataFrame([(where, m, *r) for r in s.rows(table)], columns=["path", "mol_idx", *names])

    return found.mapInPandas(run, f"path string, mol_idx int, {SCHEMAS[table]}")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """path, name, atom_idx of index groups."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for where, data in zip(p.path, p.content, strict=True):
                for name, ids in text.read_ndx(bytes(data).decode()).items():
                    yield pd.DataFrame({"path": where, "name": name, "atom_idx": ids})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, name string, atom_idx long")


def frames_of(atoms: DataFrame, coords: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """One row a frame: frame_idx, time, box, rows (atoms with their coordinates in order), for writers."""
    met = coords.join(atoms, "atom_idx")
    columns = [c for c in met.columns if c not in ("frame_idx", "atom_idx", "path", "mol_idx")]
    rows = met.groupBy("frame_idx").agg(F.array_sort(F.collect_list(F.struct("atom_idx", *columns))).alias("rows"))
    if frames is None:
        return rows.withColumn("time", F.col("frame_idx").cast("double")).withColumn("box", F.lit(None).cast("array<double>"))
    return rows.join(frames.select("frame_idx", "time", "box"), "frame_idx", "left")


def _structure(row) -> Structure:
    rows = [r.asDict() for r in row["rows"]]
    triple = lambda a: np.array([[r[c] for c in a] for r in rows], float) if all(c in rows[0] and rows[0][c] is not None for c in a) else None
    xyz, velocity, force = (triple(a) for a in (("x", "y", "z"), ("vx", "vy", "vz"), ("fx", "fy", "fz")))
    return Structure(rows, [], [Frame(row["time"] or 0.0, row["box"], xyz, velocity, force)])


def _laid(row, ids: np.ndarray) -> Frame:
    """The frame with a place for each of ids (sorted), whether it holds the atom or not."""
    s = _structure(row)
    f, at = s.frames[0], np.searchsorted(ids, [r["atom_idx"] for r in s.atoms])
    if len(np.unique(at)) < len(at):
        raise FormatError(f"frame {row['frame_idx']} holds an atom twice")
    if len(at) < len(ids):
        xyz, absent = np.full((len(ids), 3), np.nan), np.ones(len(ids), bool)
        xyz[at], absent[at] = f.xyz, False
        f = Frame(f.time, f.box, xyz, absent=absent)
    return f


def _boxed(coords: DataFrame, frames: DataFrame) -> bool:
    """Whether every frame of coords has a box."""
    return coords.select("frame_idx").distinct().join(frames.where("box is not null"), "frame_idx", "left_anti").isEmpty()


def write(path: str, atoms: DataFrame, coords: DataFrame, frames: DataFrame | None = None, bonds: DataFrame | None = None) -> int:
    """Writes a file of the kind that path ends in and returns the number of frames; one frame is in memory at a time.

    DCD and NetCDF hold one number of atoms: there every frame has a place for each atom of any frame, and atoms that a
    frame lacks are marked and left out again when the file is read.
    """
    kind = extension(path)
    if kind not in WRITERS and kind not in BINARY_WRITERS:
        raise FormatError(f"files of kind {kind!r} can't be written")
    rows = frames_of(atoms, coords, frames).orderBy("frame_idx").toLocalIterator()
    pairs = [(r["i1"], r["i2"], r["order"]) for r in bonds.orderBy("bond_idx").toLocalIterator()] if bonds is not None else []
    n = 0
    if kind in ("dcd", "nc"):  # their heads count the frames and are written again at the end
        ids = np.sort(coords.join(atoms, "atom_idx").select("atom_idx").distinct().toPandas()["atom_idx"].to_numpy())
        every = (_laid(r, ids) for r in rows)
        with open(path, "wb") as f:
            return binary.stream_dcd(every, f) if kind == "dcd" else binary.stream_netcdf(every, f, frames is not None and _boxed(coords, frames))
    with open(path, "wb") as f:
        for n, r in enumerate(rows, 1):
            s = _structure(r)
            s.bonds = pairs
            f.write(BINARY_WRITERS[kind](s.frames, n - 1) if kind in BINARY_WRITERS else WRITERS[kind](s).encode())
    return n
