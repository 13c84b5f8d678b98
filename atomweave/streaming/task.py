"""Analysis tasks over frames: begin, end and skip windows, several files as one trajectory, batch and stream drivers."""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SCALE = {"ps": 1.0, "ns": 1e3, "us": 1e6}


class NoFramesError(ValueError):
    """The window of a task holds no frame."""


def parse_suffix(text: str) -> tuple[int | None, float | None]:
    """(frame, time in ps): '' is neither, a bare integer or 'fr' a frame, ps/ns/us a time."""
    text = text.strip()
    if not text:
        return None, None
    m = re.fullmatch(r"([+-]?\d+(?:\.\d+)?)(fr|ps|ns|us)?", text)
    if not m or (m[2] in (None, "fr") and "." in m[1]):
        raise ValueError(f"not a frame or time: {text!r}")
    if m[2] in (None, "fr"):
        return int(m[1]), None
    return None, float(m[1]) * _SCALE[m[2]]


@dataclass(frozen=True)
class FrameWindow:
    """begin and end as text with suffix; every skip-th frame from begin. End frames are exclusive, end times inclusive."""

    begin: str = ""
    end: str = ""
    skip: int = 1

    def condition(self) -> Column:
        (b_frame, b_time), (e_frame, e_time) = parse_suffix(self.begin), parse_suffix(self.end)
        ok = F.lit(True)
        if b_frame is not None:
            ok = ok & (F.col("frame_idx") >= b_frame)
        if b_time is not None:
            ok = ok & (F.col("time") >= b_time)
        if e_frame is not None:
            ok = ok & (F.col("frame_idx") < e_frame)
        if e_time is not None:
            ok = ok & (F.col("time") <= e_time)
        return ok

    def apply(self, frames: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        """The frames (one row each) of the window."""
        kept = frames.where(self.condition())
        if self.skip == 1:
            return kept
        w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("frame_idx")
        return kept.withColumn("_n", F.row_number().over(w)).where(F.pmod(F.col("_n") - 1, F.lit(self.skip)) == 0).drop("_n")


def concatenate(parts: Sequence[DataFrame], structure: DataFrame | None = None) -> DataFrame:
    """Trajectories (frame_idx from 0 in each) one after another with global frame numbers; structure goes first as a frame."""
    parts = ([structure] if structure is not None else []) + list(parts)
    out, before = None, None
    for i, p in enumerate(parts):
        tagged = p.withColumn("_part", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    counts = out.groupBy("_part").agg((F.max("frame_idx") + 1).alias("_n"))
    w = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return out.join(F.broadcast(before), "_part").withColumn("frame_idx", F.col("frame_idx") + F.col("_before")).drop("_part", "_before")


def last_frame(frames: DataFrame) -> DataFrame:
    top = frames.agg(F.max("frame_idx").alias("frame_idx"))
    return frames.join(F.broadcast(top), "frame_idx", "left_semi")


def seek_time(frames: DataFrame, time: float) -> DataFrame:
    """The first frame at or after a time."""
    first = frames.where(F.col("time") >= time).agg(F.min("frame_idx").alias("frame_idx"))
    return frames.join(F.broadcast(first), "frame_idx", "left_semi")


class FrameTask(ABC):
    """A task over frames: per_frame is a plan over coordinates (keyed by frame_idx), finish one over its results."""

    def __init__(self, window: FrameWindow | None = None):
        self.window = window or FrameWindow()

    @abstractmethod
    def per_frame(self, coords: DataFrame) -> DataFrame: ...

    def finish(self, results: DataFrame) -> DataFrame:
        return results

    def run(self, coords: DataFrame, strict: bool = False) -> DataFrame:
        """Batch: coords hold frame_idx and time on each row; strict: no frame is an error (runs a job)."""
        if self.window.skip == 1:
            kept = coords.where(self.window.condition())
        else:
            frames = self.window.apply(coords.select("frame_idx", "time").distinct())
            kept = coords.join(frames.select("frame_idx"), "frame_idx", "left_semi")
        if strict and kept.isEmpty():
            raise NoFramesError("no frames were consumed")
        return self.finish(self.per_frame(kept))

    def stream(self, coords: DataFrame, sink, checkpoint: str, trigger: dict | None = None):
        """Streaming: every micro-batch holds whole frames; sink(results, batch_id) gets what per_frame makes of it.

        Frames are numbered over the whole stream, so a skip counts from the window's first frame (0 without one); a skip
        from a time and a finish over all results need all frames and are refused.
        """
        frame, time = parse_suffix(self.window.begin)
        if type(self).finish is not FrameTask.finish:
            raise ValueError("a task with a finish runs over a whole trajectory, not over a stream")
        if self.window.skip != 1 and time is not None:
            raise ValueError("over a stream, skip counts from a frame, not from a time")
        wanted = self.window.condition()
        if self.window.skip != 1:
            wanted = wanted & (F.pmod(F.col("frame_idx") - (frame or 0), F.lit(self.window.skip)) == 0)

        def each(batch: DataFrame, batch_id: int) -> None:
            sink(self.per_frame(batch.where(wanted)), batch_id)

        return coords.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def frame_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of coordinate tables that appear in a folder."""
    return spark.readStream.schema(schema).parquet(path)
