"""Order along the atom index: residues, runs, splits, expansion to whole residues, and sets of atoms."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _window(keys: Sequence[str], order: str = "atom_idx"):
    return (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(order)


def runs(df: DataFrame, value: Column, out: str, keys: Sequence[str] = (), order: str = "atom_idx") -> DataFrame:
    """Adds the number (from 0) of each row's run of equal values; rows of null value get null and don't end a run."""
    w = _window(keys, order)
    last = F.last("_value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_value", value).withColumn("_last", last)
    start = (F.col("_value").isNotNull() & (F.col("_last").isNull() | (F.col("_value") != F.col("_last")))).cast("long")
    marked = marked.withColumn("_start", start)
    number = F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return marked.withColumn(out, F.when(F.col("_value").isNotNull(), number)).drop("_value", "_last", "_start")


def assign_resindex(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """resindex grows by one at each change of resid; a change of chain alone starts no residue."""
    return runs(df, F.col("resid"), "resindex", keys)


def split(df: DataFrame, value: Column | str, keys: Sequence[str] = ()) -> DataFrame:
    """Contiguous parts of equal value as group_id; rows of null value are left out."""
    value = F.col(value) if isinstance(value, str) else value
    return runs(df, value, "group_id", keys).where(F.col("group_id").isNotNull())


#: Atoms of a bucket that ranges of atoms are met in.
BUCKET = 4096


def split_molecules(df: DataFrame, molecules: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Parts of a selection by molecule (inclusive ranges first_atom..last_atom): mol_idx as group_id.

    A range meets the atoms in the buckets that it reaches into: a row a bucket, not a row an atom.
    """
    on = [k for k in keys if k in molecules.columns]
    reach = F.explode(F.sequence(F.floor(F.col("first_atom") / BUCKET), F.floor(F.col("last_atom") / BUCKET)))
    m = molecules.select(*on, F.col("mol_idx").alias("group_id"), F.col("first_atom").alias("_first"), F.col("last_atom").alias("_last"), reach.alias("_bucket"))
    met = df.withColumn("_bucket", F.floor(F.col("atom_idx") / BUCKET)).join(m, [*on, "_bucket"])
    return met.where(F.col("atom_idx").between(F.col("_first"), F.col("_last"))).drop("_bucket", "_first", "_last")


def apply_groups(df: DataFrame, fn: Callable, schema: str, keys: Sequence[str] = ("group_id",)) -> DataFrame:
    """fn(pandas frame of one part) -> pandas frame, parts in parallel."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


def whole(df: DataFrame, system: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """All atoms of the system whose column has a value that df has."""
    on = [*keys, column]
    return system.join(df.select(*on), on, "left_semi")


def union(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return a.unionByName(b).dropDuplicates([*keys, "atom_idx"])


def intersect(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return a.join(b.select(*keys, "atom_idx"), [*keys, "atom_idx"], "left_semi")


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return a.join(b.select(*keys, "atom_idx"), [*keys, "atom_idx"], "left_anti")


complement = difference  # of the whole system


def nth(df: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """Atom number n (from 0, negative from the end) of a selection, by index."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("atom_idx" if n >= 0 else F.desc("atom_idx"))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == (n + 1 if n >= 0 else -n)).drop("_n")


def ndx_text(df: DataFrame, name: str, per_line: int = 15) -> DataFrame:
    """line_no, line of an index group: numbers from 1, so many on a line."""
    w = Window.partitionBy(F.lit(0)).orderBy("atom_idx")
    lines = df.select("atom_idx", F.floor((F.row_number().over(w) - 1) / per_line).alias("line_no"))
    body = lines.groupBy("line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("atom_idx")), lambda i: (i + 1).cast("string")), " ").alias("line"))
    return df.sparkSession.createDataFrame([(-1, f"[ {name} ]")], "line_no long, line string").unionByName(body)
