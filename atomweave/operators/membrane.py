"""Lipid membranes: markers, patches, normals, fitted surfaces, Voronoi areas, curvatures and group statistics, per frame."""

from __future__ import annotations

import tomllib
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import measure, modify, spatial
from .selection import select


@dataclass(frozen=True)
class Species:
    """A kind of lipid: selections of the whole, head and middle, tails as carbon names with their bond orders."""

    name: str
    whole: str
    head: str
    mid: str
    tails: tuple[str, ...] = ()
    max_area: float = 100.0

    def parsed_tails(self) -> list[tuple[list[str], list[int]]]:
        return [parse_tail(t) for t in self.tails]


def parse_tail(text: str) -> tuple[list[str], list[int]]:
    """C1-C2=C3: names, and 1 or 2 for the bond after each but the last."""
    names, orders, word = [], [], ""
    for c in text.strip():
        if c in "-=":
            names.append(word.strip())
            orders.append(1 if c == "-" else 2)
            word = ""
        else:
            word += c
    names.append(word.strip())
    if not all(names):
        raise ValueError(f"a tail with an empty name: {text!r}")
    return names, orders


@dataclass
class Config:
    sel: str = "all"
    cutoff: float = 2.5
    order_type: str = "ScdCorr"
    max_smooth_iter: int = 1
    global_normal: list[float] | None = None
    output_dir: str = "."
    n_shells_patch: int = 0
    n_shells_smoothing: int = 0
    groups: list[str] = field(default_factory=list)
    lipids: dict[str, Species] = field(default_factory=dict)


def read_config(text: str) -> Config:
    raw = tomllib.loads(text)
    lipids = {k: Species(k, v["whole"], v["head"], v["mid"], tuple(v.get("tails", ())), v.get("max_area", 100.0)) for k, v in raw.pop("lipids", {}).items()}
    known = {k: v for k, v in raw.items() if k in Config.__dataclass_fields__}
    return Config(**known, lipids=lipids)


def markers(atoms: DataFrame, species: Sequence[Species], box, keys: Sequence[str] = ()) -> DataFrame:
    """keys, lipid_id (resindex), species, head, mid, tail (structs of x, y, z): centres of mass of unwrapped lipids."""
    out = None
    for s in species:
        own = modify.unwrap_simple(select(atoms, s.whole, keys), box, [*keys, "resindex"])
        ends = [names[-1] for names, _ in s.parsed_tails()]
        parts = {"head": select(own, s.head), "mid": select(own, s.mid), "tail": own.where(F.col("name").isin(*ends))}
        row = None
        for k, p in parts.items():
            c = measure.center(p, [*keys, "resindex"], weighted=True).select(*keys, F.col("resindex").alias("lipid_id"), F.struct("x", "y", "z").alias(k))
            row = c if row is None else row.join(c, [*keys, "lipid_id"])
        row = row.withColumn("species", F.lit(s.name))
        out = row if out is None else out.unionByName(row)
    return out


def patches(lipids: DataFrame, cutoff: float, box, keys: Sequence[str] = ()) -> DataFrame:
    """keys, i, j, d (struct: vector from i to j): heads no farther apart than cutoff, both ways."""
    heads = lipids.select(*keys, F.col("lipid_id").alias("atom_idx"), "head.x", "head.y", "head.z")
    p = spatial.self_pairs(heads, cutoff, box, keys=keys).select(*keys, "i", "j")
    return reaches(p.union(p.select(*keys, "j", "i")), lipids, box, keys)


def reaches(pairs: DataFrame, lipids: DataFrame, box, keys: Sequence[str] = ()) -> DataFrame:
    """Adds d, the vector from the head of i to the nearest image of the head of j, to keys, i, j."""
    at = lambda c: lipids.select(*keys, F.col("lipid_id").alias(c), F.col("head").alias(f"h{c}"))
    met = pairs.join(at("i"), [*keys, "i"]).join(at("j"), [*keys, "j"])
    v = lambda c: tuple(F.col(c)[a] for a in "xyz")
    d = g.shortest(g.sub(v("hj"), v("hi")), g.box(box), (1, 1, 1), g.skewed(box))
    return met.select(*keys, "i", "j", F.struct(*[x.alias(a) for x, a in zip(d, "xyz", strict=True)]).alias("d"))


def normals(lipids: DataFrame, near: DataFrame, keys: Sequence[str] = (), passes: int = 2) -> DataFrame:
    """Adds normal: from tail to head, averaged with neighbours at most 90 degrees off, pass after pass (all at once)."""
    v = lambda c: tuple(F.col(c)[a] for a in "xyz")
    pack = lambda t, n: F.struct(*[x.alias(a) for x, a in zip(t, "xyz", strict=True)]).alias(n)
    now = lipids.withColumn("normal", pack(g.unit(g.sub(v("head"), v("tail"))), "normal"))
    for _ in range(passes):
        i = now.select(*keys, F.col("lipid_id").alias("i"), F.col("normal").alias("ni"))
        j = now.select(*keys, F.col("lipid_id").alias("j"), F.col("normal").alias("nj"))
        met = near.select(*keys, "i", "j").join(i, [*keys, "i"]).join(j, [*keys, "j"]).where(g.dot(v("ni"), v("nj")) >= 0)
        sums = met.groupBy(*keys, "i").agg(*[F.sum(F.col("nj")[a]).alias(f"s{a}") for a in "xyz"]).withColumnRenamed("i", "lipid_id")
        full = now.join(sums, [*keys, "lipid_id"], "left")
        total = tuple(F.col("normal")[a] + F.coalesce(F.col(f"s{a}"), F.lit(0.0)) for a in "xyz")
        now = full.withColumn("normal", pack(g.unit(total), "normal")).drop("sx", "sy", "sz")
    return now


def frame_of(normal: np.ndarray) -> np.ndarray:
    """Rows: two axes of the plane and the normal."""
    x = np.cross(normal, [1.0, 0, 0] if abs(normal[0]) < 0.9 else [0, 1.0, 0])
    x /= np.linalg.norm(x)
    return np.stack((x, np.cross(normal, x), normal))


def fit_quadric(p: np.ndarray) -> np.ndarray | None:
    """Coefficients of z = A x2 + B y2 + C xy + D x + E y + F by least squares; None if the points don't determine them."""
    x, y, z = p.T
    m = np.stack((x * x, y * y, x * y, x, y, np.ones_like(x)), axis=1)
    n = m.T @ m
    if len(p) < 6 or np.linalg.matrix_rank(n) < 6:
        return None
    return np.linalg.solve(n, m.T @ z)


def curvatures(q: Sequence[float]) -> tuple[float, float, float, float]:
    """Mean, Gaussian and both principal curvatures of a quadric at the origin."""
    a, b, c, d, e, _ = q
    w = 1 + d * d + e * e
    gaussian = (4 * a * b - c * c) / w**2
    mean = (a * (1 + e * e) + b * (1 + d * d) - c * d * e) / w**1.5
    root = np.sqrt(max(0.0, mean * mean - gaussian))
    return mean, gaussian, mean + root, mean - root


def voronoi(points: np.ndarray, size: float = 10.0) -> tuple[np.ndarray, list[int]]:
    """The cell of the origin among points of a plane: vertices in order, and for each edge from it the point behind it (-1: wall)."""
    poly = [np.array(v, float) for v in ((-size, -size), (size, -size), (size, size), (-size, size))]
    edge = [-1] * 4
    for k in np.argsort((points**2).sum(axis=1)):
        p, half = points[k], (points[k] ** 2).sum() / 2
        side = [v @ p - half for v in poly]
        if all(s <= 0 for s in side):
            continue
        new, owners = [], []
        for i in range(len(poly)):
            j = (i + 1) % len(poly)
            if side[i] <= 0:
                new.append(poly[i])
                owners.append(edge[i])
            if (side[i] <= 0) != (side[j] <= 0):
                t = side[i] / (side[i] - side[j])
                new.append(poly[i] + t * (poly[j] - poly[i]))
                owners.append(int(k) if side[i] <= 0 else edge[i])
        poly, edge = new, owners
        if len(poly) < 3:
            break
    return np.array(poly).reshape(-1, 2), edge


def polygon_area(v: np.ndarray) -> float:
    return 0.5 * abs(float((v[:, 0] * np.roll(v[:, 1], -1) - v[:, 1] * np.roll(v[:, 0], -1)).sum())) if len(v) > 2 else 0.0


#: A fitted surface this far (nm) from its lipid's head makes the lipid invalid.
FARTHEST = 0.5

_POINT = "struct<x: double, y: double, z: double>"
_SURFACE = "lipid_id long, valid boolean, area double, mean_curvature double, gaussian_curvature double, k1 double, k2 double, neighbours array<long>"
_FIT = f"{_SURFACE}, up {_POINT}, moves array<struct<lipid_id: long, x: double, y: double, z: double>>, cell array<{_POINT}>"


def fits(lipids: DataFrame, near: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The columns of surfaces, and of valid lipids: up (the surface's normal at the head), moves (from each head of the
    patch, its own among them, onto the surface) and cell (vertices on the surface, seen from the head).

    A lipid is invalid if its patch determines no surface, its Voronoi cell is open, the surface runs more than FARTHEST
    from its head, or it was so before (column lost).
    """
    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in lipids.schema if f.name in keys)
    met = near.groupBy(*keys, F.col("i").alias("lipid_id")).agg(F.collect_list(F.struct("j", "d")).alias("near"))
    lost = F.col("lost") if "lost" in lipids.columns else F.lit(False)
    rows = lipids.select(*keys, "lipid_id", "normal", lost.alias("lost")).join(met, [*keys, "lipid_id"], "left")

    def run(parts):
        for p in parts:
            out = []
            for own, n, near_, gone in zip(p.lipid_id, p.normal, p.near, p.lost, strict=True):
                axes = frame_of(np.array([n["x"], n["y"], n["z"]]))
                near_ = [] if near_ is None else near_
                local = np.array([[o["d"]["x"], o["d"]["y"], o["d"]["z"]] for o in near_]).reshape(-1, 3) @ axes.T
                q = fit_quadric(np.vstack((local, np.zeros(3)))) if len(local) else None
                cell, edge = voronoi(local[:, :2])
                valid = not gone and q is not None and -1 not in edge and len(cell) > 2 and abs(q[5]) <= FARTHEST
                k = curvatures(q) if q is not None else (None,) * 4
                area, up, moves, lift = None, None, [], []
                if valid:
                    on = lambda xy: q[0] * xy[:, 0] ** 2 + q[1] * xy[:, 1] ** 2 + q[2] * xy[:, 0] * xy[:, 1] + q[3] * xy[:, 0] + q[4] * xy[:, 1] + q[5]  # noqa: B023, E731
                    lift = np.column_stack((cell, on(cell)))
                    top = np.array([0, 0, q[5]])
                    area = float(sum(np.linalg.norm(np.cross(a - top, b - top)) / 2 for a, b in zip(lift, np.roll(lift, -1, axis=0), strict=True)))
                    up = np.array([-q[3], -q[4], 1.0]) @ axes / np.sqrt(q[3] ** 2 + q[4] ** 2 + 1)
                    moved = np.append(on(local) - local[:, 2], q[5])[:, None] * axes[2]
                    moves = [{"lipid_id": int(i), "x": v[0], "y": v[1], "z": v[2]} for i, v in zip([*(o["j"] for o in near_), own], moved.tolist(), strict=True)]
                    lift = (lift @ axes).tolist()
                point = lambda v: dict(zip("xyz", map(float, v), strict=True))
                out.append((valid, area, *k, sorted({int(near_[e]["j"]) for e in edge if e >= 0}), None if up is None else point(up), moves, [point(v) for v in lift]))
            made = pd.DataFrame(out, columns=["valid", "area", "mean_curvature", "gaussian_curvature", "k1", "k2", "neighbours", "up", "moves", "cell"])
            yield pd.concat([p[[*keys, "lipid_id"]].reset_index(drop=True), made], axis=1)

    return rows.mapInPandas(run, head + _FIT)


def surfaces(lipids: DataFrame, near: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, lipid_id, valid, area, mean_curvature, gaussian_curvature, k1, k2, neighbours, from each lipid's patch."""
    return fits(lipids, near, keys).drop("up", "moves", "cell")


def smooth_markers(lipids: DataFrame, fit: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Heads of valid lipids move to the mean of the points that their own and their neighbours' surfaces give them; normals
    become those of the surfaces; lost marks lipids that aren't valid."""
    each = fit.where("valid").select(*keys, F.explode("moves").alias("m")).select(*keys, "m.*")
    mean = each.groupBy(*keys, "lipid_id").agg(*[F.avg(c).alias(f"_{c}") for c in "xyz"])
    met = lipids.drop("lost").join(fit.select(*keys, "lipid_id", "valid", "up"), [*keys, "lipid_id"]).join(mean, [*keys, "lipid_id"], "left")
    head = F.struct(*[(F.col("head")[c] + F.when(F.col("valid"), F.col(f"_{c}")).otherwise(0.0)).alias(c) for c in "xyz"])
    return met.withColumns({"head": head, "normal": F.coalesce("up", "normal"), "lost": ~F.col("valid")}).drop("valid", "up", "_x", "_y", "_z")


def shells(surface: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """keys, lipid_id, other: lipids within n shells of Voronoi neighbours (n of 1 and 2 are the same shell), itself included."""
    first = surface.select(*keys, "lipid_id", F.explode("neighbours").alias("other"))
    reach = first.union(surface.select(*keys, "lipid_id", "lipid_id")).distinct()
    for _ in range(2, n):
        step = first.select(*keys, F.col("lipid_id").alias("other"), F.col("other").alias("_to"))
        reach = reach.union(reach.join(step, [*keys, "other"]).select(*keys, "lipid_id", "_to")).distinct()
    return reach


def smoothed(surface: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """Curvatures averaged over valid lipids of n shells."""
    if n <= 0:
        return surface
    names = ("mean_curvature", "gaussian_curvature", "k1", "k2")
    other = surface.where("valid").select(*keys, F.col("lipid_id").alias("other"), *names)
    avg = shells(surface, n, keys).join(other, [*keys, "other"]).groupBy(*keys, "lipid_id").agg(*[F.avg(c).alias(f"_{c}") for c in names])
    return surface.join(avg, [*keys, "lipid_id"], "left").withColumns({c: F.coalesce(f"_{c}", c) for c in names}).drop(*[f"_{c}" for c in names])


def group_stats(lipids: DataFrame, surface: DataFrame, keys: Sequence[str] = (), group: str = "species") -> DataFrame:
    """group, n, and mean and deviation of area, tilt (degrees between normal and tail-to-head) and curvatures, over frames."""
    met = _tilted(lipids).join(surface.where("valid"), [*keys, "lipid_id"])
    return met.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{k}") for c in VALUES for k, f in (("mean", F.avg), ("std", F.stddev_pop))])


#: What statistics are made of, besides numbers of lipids and neighbours.
VALUES = ("area", "tilt", "mean_curvature", "gaussian_curvature")


def _tilted(lipids: DataFrame) -> DataFrame:
    v = lambda c: tuple(F.col(c)[a] for a in "xyz")
    return lipids.withColumn("tilt", F.degrees(g.angle(v("normal"), g.sub(v("head"), v("tail")))))


def groups_of(lipids: DataFrame, named: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """keys, group, lipid_id: lipids that meet the condition of each name; groups may overlap and change by frame."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]))
    return lipids.select(*keys, "lipid_id", F.explode(names).alias("group"))


def _met(lipids: DataFrame, surface: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Valid lipids of each group; frames are told apart in column _frame."""
    own = _tilted(lipids).select(*keys, "lipid_id", "species", "tilt").join(surface.where("valid"), [*keys, "lipid_id"])
    on = [c for c in (*keys, "lipid_id") if c in groups.columns]
    return own.join(groups, on).withColumn("_frame", F.struct(*keys) if keys else F.lit(0))


def species_stats(lipids: DataFrame, surface: DataFrame, groups: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """group, species, num, num_std (valid lipids a frame, frames without them too) and mean and deviation of VALUES and of
    the number of neighbours, over all valid lipids of all frames."""
    met = _met(lipids, surface, groups, keys).withColumn("neighbours", F.size("neighbours").cast("double"))
    names = (*VALUES, "neighbours")
    # frame by frame first, as moments that add up
    per = met.groupBy("group", "species", "_frame").agg(F.count(F.lit(1)).alias("_n"), *[x for c in names for x in (F.sum(c).alias(f"{c}_s"), F.sum(F.col(c) * F.col(c)).alias(f"{c}_q"))])
    all_ = per.groupBy("group", "species").agg(F.sum("_n").alias("_n"), F.sum(F.col("_n") * F.col("_n")).alias("_nq"), *[F.sum(f"{c}_{k}").alias(f"{c}_{k}") for c in names for k in "sq"])
    frames = lipids.select(*keys).distinct().agg(F.count(F.lit(1)).alias("_frames")) if keys else lipids.sparkSession.range(1).select(F.lit(1).alias("_frames"))
    spread = lambda q, s, n: F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0)))
    n, f = F.col("_n"), F.col("_frames")
    return all_.crossJoin(F.broadcast(frames)).select(
        "group", "species", (n / f).alias("num"), spread(F.col("_nq"), n, f).alias("num_std"),
        *[x for c in names for x in ((F.col(f"{c}_s") / n).alias(c), spread(F.col(f"{c}_q"), F.col(f"{c}_s"), n).alias(f"{c}_std"))],
    )


def neighbour_stats(lipids: DataFrame, surface: DataFrame, groups: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """group, species, neighbour, mean, std: neighbours of a species for each valid lipid of another, frame by frame, then
    over the frames that have such lipids; a species that is never met there counts as 0 in its frames."""
    met = _met(lipids, surface, groups, keys)
    number = met.groupBy("group", "species", "_frame").agg(F.count(F.lit(1)).alias("_n"))
    kinds = lipids.select(*keys, F.col("lipid_id").alias("_other"), F.col("species").alias("neighbour"))
    pairs = met.select(*keys, "group", "species", "_frame", F.explode("neighbours").alias("_other")).join(kinds, [*keys, "_other"])
    found = pairs.groupBy("group", "species", "_frame", "neighbour").agg(F.count(F.lit(1)).alias("_k")).join(number, ["group", "species", "_frame"])
    share = F.col("_k") / F.col("_n")
    sums = found.groupBy("group", "species", "neighbour").agg(F.sum(share).alias("_s"), F.sum(share * share).alias("_q"))
    frames = number.groupBy("group", "species").agg(F.count(F.lit(1)).alias("_f"))
    s, q, f = F.col("_s"), F.col("_q"), F.col("_f")
    return sums.join(frames, ["group", "species"]).select("group", "species", "neighbour", (s / f).alias("mean"), F.sqrt(F.greatest(q / f - (s / f) * (s / f), F.lit(0.0))).alias("std"))


def _cut(df: DataFrame) -> DataFrame:
    """Written to the folder for checkpoints, where one is set, else kept: every step uses the one before several times."""
    sc = df.sparkSession.sparkContext
    base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if base and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return df.checkpoint() if sc.getCheckpointDir() is not None else df.cache()


def fitted(atoms: DataFrame, config: Config, box, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Lipids and the fits of the last of max_smooth_iter rounds: fit, move the heads onto the surfaces, fit again.

    n_shells_patch: one round more, whose Voronoi neighbours up to that shell are the patches of the later ones. Normals
    are those of the surfaces; a global normal replaces all. Runs jobs: lineage is cut after each step.
    """
    lipids = _cut(markers(select(atoms, config.sel, keys), list(config.lipids.values()), box, keys))
    near = _cut(patches(lipids, config.cutoff, box, keys))
    lipids = _cut(normals(lipids, near, keys))
    fixed = F.struct(*[F.lit(float(x)).alias(a) for x, a in zip(config.global_normal, "xyz", strict=True)]) if config.global_normal else None
    if fixed is not None:
        lipids = lipids.withColumn("normal", fixed)
    rounds = max(1, config.max_smooth_iter) + (config.n_shells_patch > 0)
    for k in range(rounds - 1):
        fit = _cut(fits(lipids, near, keys))
        pairs = near.select(*keys, "i", "j")
        if config.n_shells_patch > 0 and k == 0:
            pairs = shells(fit.select(*keys, "lipid_id", "neighbours"), config.n_shells_patch, keys).where("lipid_id <> other").select(*keys, F.col("lipid_id").alias("i"), F.col("other").alias("j"))
        lipids = _cut(smooth_markers(lipids, fit, keys).withColumn("normal", F.col("normal") if fixed is None else fixed))
        near = _cut(reaches(pairs, lipids, box, keys))
    fit = _cut(fits(lipids, near, keys))
    if fixed is None:
        lipids = lipids.join(fit.select(*keys, "lipid_id", "up"), [*keys, "lipid_id"]).withColumn("normal", F.coalesce("up", "normal")).drop("up")
    return lipids, fit


def analyse(atoms: DataFrame, config: Config, box, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Lipids with normals and their surfaces for every frame of atoms."""
    lipids, fit = fitted(atoms, config, box, keys)
    return lipids, smoothed(fit.drop("up", "moves", "cell"), config.n_shells_smoothing, keys)
