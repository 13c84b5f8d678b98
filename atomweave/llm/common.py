"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import glob
import os
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z only; other letters stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors and the driver share.

    Where the setting is missing, a session of one machine (tests) gets a folder of that machine; a cluster's is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "atomweave-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/aw-{uuid.uuid4().hex}"


def cut(df: DataFrame, path: str) -> DataFrame:
    """Writes df as a table of the shared folder and reads it again: lineage ends here."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows and bytes of a batch that goes to or from a Python worker.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that Python workers get by bytes as well as by rows: texts may be long."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if int(re.sub(r"\D", "", spark.conf.get(name))) > most:
            spark.conf.set(name, str(most))


def give_back() -> None:
    """Returns the memory that this process has freed to the machine: workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: Items that a fold takes as one part.
PART = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once: a column named in a lambda is otherwise evaluated at each of its calls."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(items: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """An array of kind (DDL): what step(state, item) -> (state, array) adds item by item.

    Items are taken in parts of PART and the parts' arrays are joined at the end, as an array that grows item by item
    would be copied at each.
    """
    none, nones = F.expr(f"cast(array() as array<{kind}>)"), F.expr(f"cast(array() as array<array<{kind}>>)")

    def one(acc: Column, x: Column) -> Column:
        now, more = step(acc["state"], x)
        return F.struct(now.alias("state"), F.concat(acc["out"], more).alias("out"))

    def every(bound: Column) -> Column:
        def part(acc: Column, k: Column) -> Column:
            done = F.aggregate(F.slice(bound, k * PART + 1, F.lit(PART)), F.struct(acc["state"].alias("state"), none.alias("out")), one)
            return let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

        parts = F.sequence(F.lit(0), F.floor((F.greatest(F.size(bound), F.lit(1)) - 1) / PART).cast("int"))
        return F.aggregate(parts, F.struct(state.alias("state"), nones.alias("out")), part, lambda acc: F.flatten(acc["out"]))

    return let(items, every)


def one_thread() -> None:
    """Makes this process's matrix library use one thread: Python workers share an executor's cores as they are."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                return
