"""Binary trajectories (TRR, XTC, DCD, NetCDF) by frames: an index from heads alone, then ranges of frames in parallel.

A file is never held whole: the index walks heads, one task a file; a task of the second step opens a file once, reads
the frames of its range one after another and holds one. Windows, seeks and the last frame are taken on the index, so
frames outside them aren't read at all. Files must be in a store that every executor reaches by pyarrow's file systems.
"""

from __future__ import annotations

import logging
import os
import struct
from collections.abc import Callable, Iterator, Sequence
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary
from .model import FormatError, Frame

INDEX = "path string, frame_idx long, time double, offset long, size long"
_TYPES = {"path": "string", "frame_idx": "long", "time": "double", "box": "array<double>", "atom_idx": "long"} | dict.fromkeys(("x", "y", "z", "vx", "vy", "vz", "fx", "fy", "fz"), "double")
_ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}

#: Frames that one task reads one after another, bytes that a task should read, and rows of a batch that it gives.
RANGE, TASK_BYTES, BATCH = 64, 256 << 20, 1 << 16


def _kind(path: str) -> str:
    kind = os.path.splitext(path)[1][1:]
    if kind not in binary.INDEXES:
        raise FormatError(f"files of kind {kind!r} have no index of frames")
    return kind


def _open(path: str) -> tuple[BinaryIO, int]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    store, inner = fs.FileSystem.from_uri(path)
    f = store.open_input_file(inner)
    return f, f.size()


def _listed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path and length of the files; their content isn't read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def frame_index(spark: SparkSession, path: str | list[str], mode: str = "FAILFAST") -> DataFrame:
    """path, frame_idx (from 0 in each file), time, offset and size of every frame.

    mode PERMISSIVE: a file's frames end before the first damaged one, with a warning in the task's log.
    """
    names = [c.split()[0] for c in INDEX.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, _ARROW[_TYPES.get(n, "long")]) for n in names])
        for p in parts:
            for where in p.column("path").to_pylist():
                rows: list[tuple] = []
                f, size = _open(where)
                with f:
                    try:
                        for k, place in enumerate(binary.INDEXES[_kind(where)](f, size)):
                            rows.append((where, k, *place))
                            if len(rows) == BATCH:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                                rows = []
                    except (ValueError, IndexError, struct.error) as e:
                        if mode != "PERMISSIVE":
                            raise FormatError(f"{where}: {e}") from e
                        logging.getLogger(__name__).warning("%s: read up to its first damaged frame: %s", where, e)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return _listed(spark, path).select("path").mapInArrow(run, INDEX)


def statistics(index: DataFrame) -> DataFrame:
    """path, frames, last_time and bytes of each file."""
    return index.groupBy("path").agg(F.count(F.lit(1)).alias("frames"), F.max_by("time", "frame_idx").alias("last_time"), F.sum("size").alias("bytes"))


def _columns(frame: Frame, names: Sequence[str], where: str, k: int, low: int, high: int, held: np.ndarray | None) -> list[pa.Array]:
    """Rows low to high of a frame's columns; held: places of the atoms it holds, None for one row a frame."""
    out = []
    rows = slice(low, high) if frame.absent is None or held is None else held[low:high]
    for name in names:
        if name == "atom_idx":
            out.append(pa.array(held[low:high]))
        elif _TYPES[name] == "double" and name != "time":
            table = frame.xyz if len(name) == 1 else frame.velocity if name[0] == "v" else frame.force
            out.append(pa.nulls(high - low, pa.float64()) if table is None else pa.array(np.ascontiguousarray(table[rows, "xyz".index(name[-1])])))
        else:
            value = {"path": where, "frame_idx": k, "time": frame.time, "box": frame.box}[name]
            out.append(pa.array([value] * (high - low), _ARROW[_TYPES[name]]))
    return out


def read_frames(
    spark: SparkSession, path: str | list[str], columns: Sequence[str] = ("frame_idx", "atom_idx", "x", "y", "z"), chosen: Callable[[DataFrame], DataFrame] | Column | None = None,
    mode: str = "FAILFAST", task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """The columns asked for of every atom of every frame; one row a frame if no column belongs to atoms.

    chosen: a condition on the index (frame_idx, time), or what makes of the index the index of the frames wanted, like
    FrameWindow.apply, task.last_frame or task.seek_time. columns: path, frame_idx, time, box, atom_idx, x to fz; what a
    file doesn't hold is null, velocities and forces that aren't asked for are skipped.
    """
    unknown = [c for c in columns if c not in _TYPES]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    per_atom = any(c not in ("path", "frame_idx", "time", "box") for c in columns)
    parts = "x" + "".join(p for p in "vf" if any(c[0] == p and len(c) == 2 for c in columns))
    index = frame_index(spark, path, mode)
    if chosen is not None:
        index = index.where(chosen) if isinstance(chosen, Column) else chosen(index)
    # rows of the index are small, so the number of tasks follows the files' bytes (one number a call), not the rows
    total = _listed(spark, path).agg(F.sum("length")).first()[0] or 0
    spread = index.select("path", "frame_idx", "time", "offset", "size").repartition(max(1, -(-total // task_bytes)), "path", F.floor(F.col("frame_idx") / RANGE)).sortWithinPartitions("path", "offset")
    schema = pa.schema([(c, _ARROW[_TYPES[c]]) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, f, before, kind = None, None, b"", ""
        try:
            for b in batches:
                for row in b.to_pylist():
                    where = row["path"]
                    if where != at:
                        if f is not None:
                            f.close()
                        (f, size), kind, at = _open(where), _kind(where), where
                        before = binary.opening(f, kind, size)
                    f.seek(row["offset"])
                    try:
                        frame = binary.decode(kind, before, f.read(row["size"]), parts)
                    except (ValueError, IndexError, struct.error) as e:
                        raise FormatError(f"{where}, frame {row['frame_idx']}: {e}") from e
                    frame.time = row["time"]
                    held = frame.held() if per_atom else None
                    n = 1 if held is None else len(held)
                    for low in range(0, n, BATCH):
                        yield pa.RecordBatch.from_arrays(_columns(frame, columns, where, row["frame_idx"], low, min(n, low + BATCH), held), schema=schema)
        finally:
            if f is not None:
                f.close()

    return spread.mapInArrow(run, ", ".join(f"{c} {_TYPES[c]}" for c in columns))
