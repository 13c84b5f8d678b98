"""Large files of lines: written by parts in parallel, and atoms of ITP files read by ranges of bytes.

A line belongs to the range in which it begins. A first pass counts each range's atoms, one row a range; from these comes
where the section of atoms begins and ends and the number of each range's first atom, then the ranges are read again.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.elements import guess_name
from .frames import _listed, _open
from .model import ATOMS, real, whole

#: Bytes of a range, and lines of a part that is written.
RANGE_BYTES, PART_LINES = 8 << 20, 1 << 19

_WHOLE, _REAL = r"^-?[0-9]{1,9}$", r"^-?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?$"


def write_lines(path: str, rows: DataFrame, number: str, line: Column, head: str = "", tail: str = "") -> None:
    """head, the lines in order of number (from 0, without large gaps) and tail as one file in a folder that all executors share."""
    parts = f"{os.path.abspath(path)}.parts-{uuid.uuid4().hex}"
    made = rows.select((F.col(number) / PART_LINES).cast("long").alias("part"), F.col(number).alias("_n"), F.coalesce(line, F.raise_error(F.lit("a line lacks a value"))).alias("value"))
    made.repartition("part").sortWithinPartitions("part", "_n").select("part", "value").write.partitionBy("part").text(f"file://{parts}", lineSep="\n")
    with open(path, "wb") as out:
        out.write(head.encode())
        for part in sorted((p for p in os.listdir(parts) if p.startswith("part=")), key=lambda p: int(p[5:])):
            (name,) = (n for n in os.listdir(f"{parts}/{part}") if n.startswith("part-"))
            with open(f"{parts}/{part}/{name}", "rb") as f:
                shutil.copyfileobj(f, out, 1 << 20)
            os.remove(f"{parts}/{part}/{name}")
        out.write(tail.encode())
    shutil.rmtree(parts)


def suits(spark: SparkSession, path: str | list[str], kind: str | None) -> bool:
    """Whether path names ITP files only, in stores that pyarrow reaches too."""
    every = [path] if isinstance(path, str) else path
    if not every or any((kind or os.path.splitext(p)[1][1:]) != "itp" for p in every):
        return False
    first = _listed(spark, path).select("path").first()
    try:
        return first is not None and (first.path.startswith("file:") or bool(fs.FileSystem.from_uri(first.path)))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def _cleaned(path: str, start: int, length: int) -> pa.Array:
    """The lines that begin in a range, without comments and blanks around, empty ones and directives."""
    f, size = _open(path)
    with f:
        f.seek(max(0, start - 1))
        data = f.read(length + min(start, 1))
        if start:  # the rest of a line that began before is another range's
            data = data[data.find(b"\n") + 1 :] if b"\n" in data else b""
        end = start + length
        f.seek(min(end, size))
        while data and not data.endswith(b"\n") and (more := f.read(1 << 16)):
            data += more[: more.find(b"\n") + 1] if b"\n" in more else more
    out = pa.array(data.decode("utf-8", "replace").splitlines(), pa.string())
    out = pc.utf8_trim_whitespace(pc.replace_substring_regex(out, r"(?s);.*", "") if b";" in data else out)
    return out.filter(pc.and_(pc.not_equal(out, ""), pc.invert(pc.starts_with(out, "#"))))


def _stop(lines: pa.Array, begin: int) -> tuple[int, bool]:
    """Where the section that is open at begin ends in lines, and whether it does."""
    rest = lines.slice(begin)
    ends = pc.or_(pc.starts_with(rest, "["), pc.less(pc.list_value_length(pc.utf8_split_whitespace(rest, max_splits=8)), 8))
    k = pc.index(ends, True).as_py()
    return (len(lines), False) if k < 0 else (begin + k, True)


def _head(lines: pa.Array) -> int:
    """Place behind the first head of a section of atoms, -1 without."""
    for k in np.flatnonzero(pc.starts_with(lines, "[").to_numpy(zero_copy_only=False)):
        if lines[int(k)].as_py().strip("[] \t") == "atoms":
            return int(k) + 1
    return -1


def _numbers(texts: pa.Array, kind: pa.DataType, pattern: str, plain) -> pa.Array:
    if pc.all(pc.match_substring_regex(texts, pattern)).as_py() is not False:
        return texts.cast(kind)
    return pa.array([plain(t) for t in texts.to_pylist()], kind)


def _atoms(lines: pa.Array, path: str, first: int) -> pa.RecordBatch:
    parts, n = pc.utf8_split_whitespace(lines, max_splits=8), len(lines)
    field = lambda k: pc.list_element(parts, k)
    name, resname = field(4), field(3)
    both = pc.binary_join_element_wise(name, resname, " ").dictionary_encode()
    kinds = np.array([guess_name(*v.split(" ")) for v in both.dictionary.to_pylist()], np.int16)
    held = {
        "path": pa.repeat(path, n), "mol_idx": pa.repeat(pa.scalar(0, pa.int32()), n), "atom_idx": pa.array(np.arange(first, first + n)), "name": name, "resname": resname,
        "resid": _numbers(field(2), pa.int32(), _WHOLE, whole), "atomic_number": pa.array(kinds[both.indices.to_numpy()]), "mass": _numbers(field(7), pa.float64(), _REAL, real),
        "charge": _numbers(field(6), pa.float64(), _REAL, real), "chain": pa.repeat(" ", n), "bfactor": pa.repeat(0.0, n), "occupancy": pa.repeat(1.0, n), "type_name": field(1),
    }
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "short": pa.int16(), "double": pa.float64()}
    names = [c.split() for c in f"path string, mol_idx int, {ATOMS}".split(", ")]
    return pa.RecordBatch.from_arrays([held[c] if c in held else pa.nulls(n, types[t]) for c, t in names], names=[c for c, _ in names])


def read_itp_atoms(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, mol_idx and the columns of atoms, as text.read_itp gives them."""
    size = RANGE_BYTES
    starts = _listed(spark, path).where("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"))
    ranges = starts.repartition("path", "start")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                lines = _cleaned(r["path"], r["start"], size)
                (n, ends), head = _stop(lines, 0), _head(lines)
                m, over = _stop(lines, head) if head >= 0 else (0, False)
                yield pa.RecordBatch.from_pylist([r | {"n": n, "ends": ends, "head": head >= 0, "m": m - max(head, 0), "over": over}])

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        out, state, at = [], "before", 0
        for r in p.sort_values("start").itertuples():
            if state == "before" and r.head:
                out.append((r.path, r.start, at, True))
                at, state = at + r.m, "after" if r.over else "in"
            elif state == "in":
                out.append((r.path, r.start, at, False))
                at, state = at + r.n, "after" if r.ends else "in"
        return pd.DataFrame(out, columns=["path", "start", "first", "head"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                lines = _cleaned(r["path"], r["start"], size)
                begin = _head(lines) if r["head"] else 0
                end, first = _stop(lines, begin)[0], r["first"]
                for low in range(begin, end, 1 << 16):
                    yield _atoms(lines.slice(low, min(end - low, 1 << 16)), r["path"], first + low - begin)

    counted = ranges.mapInArrow(count, "path string, start long, n long, ends boolean, head boolean, m long, over boolean")
    placed = counted.groupBy("path").applyInPandas(fold, "path string, start long, first long, head boolean")
    return placed.repartition("path", "start").mapInArrow(parse, f"path string, mol_idx int, {ATOMS}")
