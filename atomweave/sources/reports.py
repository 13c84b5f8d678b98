"""Results as text: one row a line, in order of line_no, for small tables and for drawings of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.membrane import VALUES

#: Names of VALUES in reports.
_SHORT = dict(zip(VALUES, ("area", "tilt", "mean_curv", "gauss_curv"), strict=True))


def save(lines: DataFrame, path: str) -> int:
    """Writes lines (line_no, line) into one file and returns their number; one partition is held at a time."""
    n = 0
    with open(path, "w") as f:
        for n, r in enumerate(lines.orderBy("line_no").select("line").toLocalIterator(), 1):
            f.write(r["line"] + "\n")
    return n


def _number(c: Column) -> Column:
    return F.format_string("%8.3f", c)


def stats_lines(stats: DataFrame, group: str) -> DataFrame:
    """A group's rows of membrane.species_stats under a line of names, by species; columns are parted by tabs."""
    values = ["num", "num_std", *[x for c in VALUES for x in (c, f"{c}_std")]]
    names = ["num", "num_std", *[x for c in VALUES for x in (_SHORT[c], f"{_SHORT[c]}_std")]]
    body = stats.where(F.col("group") == group).select(F.col("species").alias("line_no"), F.concat_ws("\t", "species", *[_number(F.col(c)) for c in values]).alias("line"))
    return stats.sparkSession.createDataFrame([("", "#species\t" + "\t".join(names))], "line_no string, line string").unionByName(body)


def neighbour_lines(stats: DataFrame, neighbours: DataFrame, group: str) -> DataFrame:
    """For each species of a group its number of neighbours, then those of each species; an empty line between."""
    own = stats.where(F.col("group") == group)
    head = own.select(F.struct("species", F.lit(0).alias("part"), F.lit("").alias("other")).alias("line_no"), F.concat(F.col("species"), F.lit(":\t\t"), _number(F.col("neighbours")), F.lit("\t"), _number(F.col("neighbours_std"))).alias("line"))
    each = neighbours.where(F.col("group") == group).select(F.struct("species", F.lit(1).alias("part"), F.col("neighbour").alias("other")).alias("line_no"), F.concat(F.lit("\t"), "neighbour", F.lit("\t"), _number(F.col("mean")), F.lit("\t"), _number(F.col("std"))).alias("line"))
    empty = own.select(F.struct("species", F.lit(2).alias("part"), F.lit("").alias("other")).alias("line_no"), F.lit("").alias("line"))
    return head.unionByName(each).unionByName(empty)


def order_lines(order: DataFrame) -> DataFrame:
    """Tail order (tail from 0, carbon, order): a line a place with the mean over tails, then each tail's; -- where it has none."""
    mean = order.groupBy("carbon", "tail").agg(F.avg("order").alias("v"))
    tails = sorted(r[0] for r in mean.select("tail").distinct().collect())  # as many as a species has
    wide = mean.groupBy("carbon").pivot("tail", tails).agg(F.first("v"))
    number = lambda c: F.coalesce(F.format_string("%.3f", c), F.lit("--"))
    known = F.array_compact(F.array(*[F.col(f"`{t}`") for t in tails]))
    average = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    cells = [F.when(F.col(f"`{t}`").isNull(), "--").otherwise(number(F.col(f"`{t}`"))) for t in tails]
    body = wide.select(F.col("carbon").cast("long").alias("line_no"), F.concat_ws("\t", F.format_string("%.3f", F.col("carbon").cast("double")), number(average), *cells).alias("line"))
    return order.sparkSession.createDataFrame([(-1, "# time\taver\t" + "\t".join(f"tail{k + 1}" for k in range(len(tails))))], "line_no long, line string").unionByName(body)


def histogram_lines(found: DataFrame, low: float, high: float, bins: int, value: str = "n") -> DataFrame:
    """Centre and value of every bin of measure.histogram, empty ones too."""
    spark, width = found.sparkSession, (high - low) / bins
    all_ = spark.range(bins).select(F.col("id").alias("bin"))
    met = all_.join(F.broadcast(found.select("bin", F.col(value).cast("double").alias("v"))), "bin", "left")
    centre = low + F.col("bin") * width + 0.5 * width
    return met.select(F.col("bin").alias("line_no"), F.concat_ws(" ", centre.cast("string"), F.coalesce("v", F.lit(0.0)).cast("string")).alias("line"))


def polygon_lines(vertices: Sequence[Sequence[float]]) -> str:
    """The vertices of a Voronoi cell, one a line."""
    return "".join(f"{x} {y}\n" for x, y in vertices)


# -- drawings: commands of a viewer, in its unit of 0.1 nm; points are tuples of columns ---------------------------


def _at(p: Sequence[Column]) -> Column:
    return F.concat(F.lit('"'), F.concat_ws(" ", *[(c * 10).cast("string") for c in p]), F.lit('"'))


def _colour(name: str) -> Column:
    return F.lit(f"draw color {name}")


def sphere(p: Sequence[Column], radius: float, colour: str) -> Column:
    return F.concat_ws("\n", _colour(colour), F.concat(F.lit("draw sphere "), _at(p), F.lit(f" radius {radius} resolution 12")))


def cylinder(p: Sequence[Column], q: Sequence[Column], colour: str) -> Column:
    return F.concat_ws("\n", _colour(colour), F.concat(F.lit("draw cylinder "), _at(p), F.lit(" "), _at(q), F.lit(" radius 0.2 resolution 12")))


def arrow(p: Sequence[Column], d: Sequence[Column], colour: str, length: float = 0.5) -> Column:
    """A shaft of half the length and a tip behind it."""
    to = lambda f: [a + f * length * b for a, b in zip(p, d, strict=True)]
    tip = F.concat(F.lit("draw cone "), _at(to(0.5)), F.lit(" "), _at(to(0.7)), F.lit(" radius 0.4 resolution 12"))
    return F.concat_ws("\n", cylinder(p, to(0.5), colour), tip)


def membrane_drawing(lipids: DataFrame, fit: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Heads as spheres, normals as arrows and Voronoi cells as outlines of all valid lipids."""
    met = lipids.join(fit.where("valid").select(*keys, "lipid_id", "cell"), [*keys, "lipid_id"])
    v = lambda s: tuple(s[a] for a in "xyz")
    head = v(F.col("head"))
    after = F.concat(F.slice("cell", 2, F.size("cell")), F.slice("cell", 1, 1))
    lab = lambda s: tuple(a + b for a, b in zip(head, v(s), strict=True))
    sides = F.transform(F.arrays_zip(F.col("cell").alias("a"), after.alias("b")), lambda e: cylinder(lab(e["a"]), lab(e["b"]), "green"))
    text = F.concat_ws("\n", sphere(head, 0.8, "white"), arrow(head, v(F.col("normal")), "orange"), F.array_join(sides, "\n"))
    return met.select(F.struct(*keys, "lipid_id").alias("line_no"), text.alias("line"))
