"""Commands over files: python -m atomweave last|rearrange|solvate|tip3to4 ..."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .facade import System
from .functions import elements
from .operators import commands
from .sources import binary, files
from .sources import frames as by_frame
from .streaming import task


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="atomweave", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, outfile: str, several: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about)
        c.add_argument("-f", "--files" if several else "--file", nargs="+" if several else None, required=True)
        c.add_argument("-o", "--outfile", default=outfile)
        return c

    command("last", "the last frame of a trajectory; a structure and a trajectory in either order, or one file", "last.gro", True)
    c = command("rearrange", "puts selections first or last", "rearranged.gro")
    c.add_argument("-b", "--begin", action="append", default=[])
    c.add_argument("-e", "--end", action="append", default=[])
    c = command("solvate", "fills the box with a solvent", "solvated.gro")
    c.add_argument("-s", "--solvent", required=True)
    c.add_argument("--exclude")
    command("tip3to4", "makes three-point water four-point water", "tip4.gro")
    return p


def _whole(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Atoms of a file's first frame with coordinates, and that frame's box."""
    coords = files.read(spark, path, "coords").where("frame_idx = 0").select("atom_idx", "x", "y", "z")
    return files.read(spark, path, "atoms").drop("path", "mol_idx").join(coords, "atom_idx"), files.read(spark, path, "frames").where("frame_idx = 0").select("frame_idx", "time", "box")


def _save(path: str, atoms: DataFrame, frames: DataFrame) -> int:
    coords = atoms.select(F.lit(0).cast("long").alias("frame_idx"), "atom_idx", "x", "y", "z")
    return files.write(path, atoms.drop("x", "y", "z", "frame_idx"), coords, frames)


def last(spark: SparkSession, paths: Sequence[str], outfile: str) -> int:
    if len(paths) > 2:
        raise ValueError("one file or two")
    kinds = [files.extension(p) in binary.INDEXES for p in paths]  # such files hold no atoms
    if sum(kinds) > 1 or (len(paths) == 1 and kinds[0]):
        raise ValueError("a file with atoms is needed")
    structure, state = (paths[0], paths[-1]) if not kinds[0] else (paths[1], paths[0])
    atoms = files.read(spark, structure, "atoms").drop("path", "mol_idx")
    if files.extension(state) in binary.INDEXES:
        coords = by_frame.read_frames(spark, state, ("frame_idx", "atom_idx", "x", "y", "z"), task.last_frame)
        frames = by_frame.read_frames(spark, state, ("frame_idx", "time", "box"), task.last_frame)
    else:
        coords, frames = (task.last_frame(files.read(spark, state, t)).drop("path", "mol_idx") for t in ("coords", "frames"))
    found = System(atoms, coords)
    if not found.check_sizes():
        raise ValueError("the trajectory has another number of atoms")
    return files.write(outfile, atoms, coords, frames)


def run(spark: SparkSession, argv: Sequence[str]) -> int:
    """Runs a command and returns the number of frames written."""
    a = parser().parse_args(argv)
    if a.command == "last":
        return last(spark, a.files, a.outfile)
    atoms, frames = _whole(spark, a.file)
    if a.command == "rearrange":
        return _save(a.outfile, commands.rearrange(atoms, a.begin, a.end), frames)
    if a.command == "tip3to4":
        return _save(a.outfile, commands.tip3_to_tip4(atoms), frames)
    solvent, of_solvent = _whole(spark, a.solvent)
    boxes = [t.first() for t in (frames, of_solvent)]
    if any(b is None or b["box"] is None for b in boxes):
        raise ValueError("solvation needs the boxes of both files")
    sized = [t.withColumn("vdw", elements.vdw_of(F.col("atomic_number"))) for t in (atoms, solvent)]
    return _save(a.outfile, commands.solvate(sized[0], boxes[0]["box"], sized[1], boxes[1]["box"], a.exclude).drop("vdw"), frames)


def main() -> None:
    spark = SparkSession.builder.appName("atomweave").getOrCreate()
    print(run(spark, sys.argv[1:]))


if __name__ == "__main__":
    main()
