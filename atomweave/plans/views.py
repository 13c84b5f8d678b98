"""The driver's tables read as atoms, points and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A total order of lineitem: every column, keys first.
ORDER = "l_orderkey l_linenumber l_partkey l_suppkey l_shipdate l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as atoms, numbered without moving all rows to one task: keys are ranked within buckets of the order key."""
    li = table(spark, sf_dir, "lineitem")
    counts = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("_n"))
    wide = counts.withColumn("_b", F.floor(F.col("l_orderkey") / 1024))
    totals = wide.groupBy("_b").agg(F.sum("_n").alias("_t"))
    w = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_b", F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_before"))
    in_bucket = Window.partitionBy("_b").orderBy("l_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    in_row = Window.partitionBy("_b").orderBy("l_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    starts = wide.withColumn("_own", F.coalesce(F.sum("_n").over(in_bucket), F.lit(0))).withColumn("_res", F.count(F.lit(1)).over(in_row))
    res_before = wide.groupBy("_b").agg(F.count(F.lit(1)).alias("_r"))
    res_before = res_before.select("_b", F.coalesce(F.sum("_r").over(w), F.lit(0)).alias("_rb"))
    starts = starts.join(before, "_b").join(res_before, "_b")
    starts = starts.select("l_orderkey", (F.col("_before") + F.col("_own")).alias("_start"), (F.col("_rb") + F.col("_res")).alias("resindex"))
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER[1:]))
    li = li.withColumn("_nth", nth).join(starts, "l_orderkey")
    return li.select(
        (F.col("_start") + F.col("_nth") - 1).cast("long").alias("atom_idx"), F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("name"),
        F.concat(F.lit("R"), F.pmod("l_partkey", F.lit(7)).cast("string")).alias("resname"), F.col("l_orderkey").cast("long").alias("resid"), F.col("resindex").cast("long").alias("resindex"),
        F.col("l_returnflag").alias("chain"), F.col("l_quantity").alias("mass"), F.col("l_discount").alias("charge"),
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_tax") * 100).alias("z"),
    )


#: The same in SQL; queries put it before theirs.
ATOMS_SQL = f"""
with li as (select *, row_number() over (order by {", ".join(ORDER)}) - 1 as atom_idx from lineitem),
atoms as (select cast(atom_idx as bigint) as atom_idx, 'L' || cast(l_linenumber as varchar) as name, 'R' || cast(l_partkey % 7 as varchar) as resname,
  cast(l_orderkey as bigint) as resid, cast(dense_rank() over (order by l_orderkey) - 1 as bigint) as resindex, l_returnflag as chain, l_quantity as mass,
  l_discount as charge, l_quantity as x, l_extendedprice / 1000 as y, l_tax * 100 as z from li)
"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as points: the first three components; label as group, mass label + 1, vdw 0.02 + label / 1000."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").cast("long").alias("atom_idx"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")],
        F.col("label").cast("int").alias("grp"), (F.col("label") + 1).cast("double").alias("mass"), (F.lit(0.02) + F.col("label") / 1000).alias("vdw"),
    )


POINTS_SQL = """
with pts as (select cast(vec_id as bigint) as atom_idx, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[3] as double) as z,
  cast(label as integer) as grp, cast(label + 1 as double) as mass, 0.02 + label / 1000 as vdw from embeddings)
"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as frames in order of time: time in ms since 2020, value as x, user as group."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy(F.lit(0)).orderBy("ts", "event_id")
    return e.select((F.row_number().over(w) - 1).cast("long").alias("frame_idx"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("time"), F.col("user_id").alias("grp"), F.col("value").alias("x"), F.col("event_type").alias("kind"))


FRAMES_SQL = """
with frames as (select cast(row_number() over (order by ts, event_id) - 1 as bigint) as frame_idx, epoch_us(ts) / 1000 as time, user_id as grp, value as x, event_type as kind from events)
"""
