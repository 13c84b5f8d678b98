"""Queries over the driver's tables, one for each operator, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import elements as el
from ..functions import geometry as g
from ..operators import measure, modify, perception, sequence, spatial
from ..operators.selection import select
from ..streaming import task
from .views import ATOMS_SQL, FRAMES_SQL, POINTS_SQL, atoms, frames, points, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Orthogonal and skewed boxes for periodic queries over points (whose extents are below one).
ORTHO = [0.8, 0, 0, 0, 0.7, 0, 0, 0, 0.6]
SKEW = [0.8, 0, 0, 0.2, 0.7, 0, -0.1, 0.15, 0.6]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


# -- selections -------------------------------------------------------------------------------------------------

#: Key: selection, SQL condition over atoms (aliased a).
_ROW = {
    "sel_all": ("all", "true"),
    "sel_chain": ("chain A N and x < 20", "chain in ('A', 'N') and x < 20"),
    "sel_resid_range": ("resid 1 5:40 100", "resid = 1 or resid = 100 or resid between 5 and 40"),
    "sel_resindex_range": ("resindex 0:30 77", "resindex between 0 and 30 or resindex = 77"),
    "sel_index_range": ("index 0 10 20:30 5000:6000", "atom_idx in (0, 10) or atom_idx between 20 and 30 or atom_idx between 5000 and 6000"),
    "sel_name_regex": ("name L1 /L[3-5]/", "name = 'L1' or regexp_matches(name, '^L[3-5]$')"),
    "sel_resname": ("resname R1 R2", "resname in ('R1', 'R2')"),
    "sel_not": ("not (chain A or x > 30)", "not (chain = 'A' or x > 30)"),
    "sel_and_or_same_level": ("chain A or chain N and x < 10", "(chain = 'A' or chain = 'N') and x < 10"),
    "sel_comparison": ("mass >= 25 and charge != 0 and occ == 1 or beta < 0", "mass >= 25 and charge <> 0"),
    "sel_chained_cmp": ("10 <= x < 20 and 30 > y >= 5.5", "10 <= x and x < 20 and 30 > y and y >= 5.5"),
    "sel_math_sqrt": ("sqrt(x) + abs(z - 4) * 2 < 6", "sqrt(x) + abs(z - 4) * 2 < 6"),
    "sel_math_power": ("-x^2 + y*z/2 < 700 and z > 0", "(-x) * (-x) + y * z / 2 < 700 and z > 0"),
    "sel_trig": ("sin(x) > 0.5 or cos(y) < -0.5", "sin(x) > 0.5 or cos(y) < -0.5"),
    "sel_dist_point": ("dist point 10 20 3 < 12", "sqrt((x-10)*(x-10) + (y-20)*(y-20) + (z-3)*(z-3)) < 12"),
    "sel_dist_line": ("dist line 0 0 0 dir 0 0 1 < 25", "sqrt(x*x + y*y) < 25"),
    "sel_dist_plane": ("dist plane 10 0 0 normal 1 0 0 <= 5", "abs(x - 10) <= 5"),
    "sel_within_point": ("within 8 of 10 20 3", "sqrt((x-10)*(x-10) + (y-20)*(y-20) + (z-3)*(z-3)) <= 8"),
    "sel_same_residue": ("same residue as (x > 49 and chain A)", "resindex in (select resindex from atoms where x > 49 and chain = 'A')"),
    "sel_same_chain": ("same chain as resid 1", "chain in (select chain from atoms where resid = 1)"),
    "sel_com_of": ("x > x of com of chain A", "x > (select sum(mass * x) / sum(mass) from atoms where chain = 'A')"),
    "sel_cog_of": ("y < y of cog of resid 1:50", "y < (select avg(y) from atoms where resid between 1 and 50)"),
    "sel_pos_of": ("x < x of pos 3 of chain R", "x < (select x from atoms where chain = 'R' order by atom_idx limit 1 offset 3)"),
    "sel_and_narrows": ("chain A and x > x of com of all", "chain = 'A' and x > (select sum(mass * x) / sum(mass) from atoms)"),
    "sel_not_within": ("chain A and not within 2.5 of index 0:5", "chain = 'A' and not exists (select 1 from atoms b where b.atom_idx between 0 and 5 and sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 2.5)"),
    "sel_within_open": ("within 1.5 of index 0:40", "exists (select 1 from atoms b where b.atom_idx between 0 and 40 and sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 1.5)"),
}


def _selection(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = atoms(spark, sf_dir)
        if "occ" in text:
            a = a.withColumns({"occupancy": F.lit(1.0), "bfactor": F.lit(0.0)})
        return select(a, text).select("atom_idx", "name", "chain", "resid", "resindex")

    return run


for _key, (_text, _where) in _ROW.items():
    QUERIES[_key] = _selection(_text)
    ORACLE_SQL[_key] = f"{ATOMS_SQL} select atom_idx, name, chain, resid, resindex from atoms a where {_where}"


@query(f"{ATOMS_SQL} select atom_idx, name, chain, resid from atoms where (chain = 'A' and x < 20) or resid between 1 and 50")
def set_union(spark, sf_dir):
    a = atoms(spark, sf_dir)
    return sequence.union(select(a, "chain A and x < 20"), select(a, "resid 1:50")).select("atom_idx", "name", "chain", "resid")


@query(f"{ATOMS_SQL} select atom_idx, name, chain, resid from atoms where chain = 'A' and x < 20")
def set_intersect(spark, sf_dir):
    a = atoms(spark, sf_dir)
    return sequence.intersect(select(a, "chain A"), select(a, "x < 20")).select("atom_idx", "name", "chain", "resid")


@query(f"{ATOMS_SQL} select atom_idx, name, chain, resid from atoms where chain = 'A' and not x < 20")
def set_difference(spark, sf_dir):
    a = atoms(spark, sf_dir)
    return sequence.difference(select(a, "chain A"), select(a, "x < 20")).select("atom_idx", "name", "chain", "resid")


@query(f"{ATOMS_SQL} select atom_idx, name, chain, resid from atoms where chain <> 'A'")
def set_complement(spark, sf_dir):
    a = atoms(spark, sf_dir)
    return sequence.complement(a, select(a, "chain A")).select("atom_idx", "name", "chain", "resid")


@query(f"{ATOMS_SQL} select atom_idx, name, chain from atoms where resid between 10 and 60 and chain = 'A'")
def sub_selection(spark, sf_dir):
    return select(select(atoms(spark, sf_dir), "resid 10:60"), "chain A").select("atom_idx", "name", "chain")


# -- order ------------------------------------------------------------------------------------------------------


@query(f"{ATOMS_SQL} select resindex, min(resid) as resid, count(*) as n_atoms from atoms group by resindex")
def resindex(spark, sf_dir):
    numbered = sequence.assign_resindex(atoms(spark, sf_dir).drop("resindex"))
    return numbered.groupBy("resindex").agg(F.min("resid").alias("resid"), F.count(F.lit(1)).alias("n_atoms"))


_RUNS = """, marked as (select *, case when lag({value}) over (partition by {part} order by {order}) = {value} then 0 else 1 end as s from {source}),
runs as (select *, cast(sum(s) over (partition by {part} order by {order}) - 1 as bigint) as group_id from marked)"""


@query(f"{ATOMS_SQL}{_RUNS.format(value='chain', part='resid', order='atom_idx', source='atoms')} select resid, group_id, min(chain) as chain, count(*) as n_atoms from runs group by resid, group_id")
def split_runs(spark, sf_dir):
    parts = sequence.split(atoms(spark, sf_dir), "chain", ["resid"])
    return parts.groupBy("resid", "group_id").agg(F.min("chain").alias("chain"), F.count(F.lit(1)).alias("n_atoms"))


@query(f"{FRAMES_SQL}{_RUNS.format(value='kind', part='grp', order='frame_idx', source='frames')} select grp, group_id, min(kind) as kind, count(*) as n, round(sum(x), 4) as sum_x from runs group by grp, group_id")
def split_frames(spark, sf_dir):
    parts = sequence.runs(frames(spark, sf_dir), F.col("kind"), "group_id", ["grp"], "frame_idx")
    return parts.groupBy("grp", "group_id").agg(F.min("kind").alias("kind"), F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("sum_x"))


@query(f"{ATOMS_SQL} select cast(resid // 1000 as bigint) as mol_idx, count(*) as n_atoms, min(resid) as first_resid, max(resid) as last_resid from atoms where chain = 'A' group by 1")
def split_molecule(spark, sf_dir):
    a = atoms(spark, sf_dir)
    spans = a.groupBy(F.floor(F.col("resid") / 1000).alias("mol_idx")).agg(F.min("atom_idx").alias("first_atom"), F.max("atom_idx").alias("last_atom"))
    parts = sequence.split_molecules(select(a, "chain A"), spans)
    return parts.groupBy(F.col("group_id").alias("mol_idx")).agg(F.count(F.lit(1)).alias("n_atoms"), F.min("resid").alias("first_resid"), F.max("resid").alias("last_resid"))


@query(f"{ATOMS_SQL} select atom_idx, resid, chain from atoms where resindex in (select resindex from atoms where x >= 50)")
def whole_residues(spark, sf_dir):
    a = atoms(spark, sf_dir)
    return sequence.whole(select(a, "x >= 50"), a, "resindex").select("atom_idx", "resid", "chain")


@query(f"{ATOMS_SQL} select atom_idx, chain from atoms where chain in (select chain from atoms where resid = 1)")
def whole_chains(spark, sf_dir):
    a = atoms(spark, sf_dir)
    return sequence.whole(select(a, "resid 1"), a, "chain").select("atom_idx", "chain")


@query(f"{ATOMS_SQL}, n as (select *, row_number() over (partition by resid order by atom_idx) as k, row_number() over (partition by resid order by atom_idx desc) as q from atoms) select resid, max(case when k = 1 then atom_idx end) as first_atom, max(case when q = 1 then atom_idx end) as last_atom from n group by resid")
def element_access(spark, sf_dir):
    a = atoms(spark, sf_dir)
    first = sequence.nth(a, 0, ["resid"]).select("resid", F.col("atom_idx").alias("first_atom"))
    return first.join(sequence.nth(a, -1, ["resid"]).select("resid", F.col("atom_idx").alias("last_atom")), "resid")


# -- spatial joins ----------------------------------------------------------------------------------------------

_D = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"
_NEAR = lambda c, w: f"((a.{c}-b.{c}) - {w} * round((a.{c}-b.{c}) / {w}))"
_P = "sqrt(" + " + ".join(f"{_NEAR(c, w)} * {_NEAR(c, w)}" for c, w in zip("xyz", (0.8, 0.7, 0.6), strict=True)) + ")"
_PXY = "sqrt(" + " + ".join(f"{_NEAR(c, w)} * {_NEAR(c, w)}" for c, w in zip("xy", (0.8, 0.7), strict=True)) + " + (a.z-b.z)*(a.z-b.z))"
_T = "sqrt(list_min(list_transform([{}], lambda v: v[1]*v[1] + v[2]*v[2] + v[3]*v[3])))".format(
    ", ".join(f"[a.x-b.x + {i}*0.8 + {j}*0.2 - {k}*0.1, a.y-b.y + {j}*0.7 + {k}*0.15, a.z-b.z + {k}*0.6]".replace("+ -", "- ").replace("- -", "+ ") for i in range(-3, 4) for j in range(-3, 4) for k in range(-3, 4))
)


def _pairs_sql(d: str, cutoff: str, where: str = "a.atom_idx < b.atom_idx") -> str:
    return f"{POINTS_SQL} select a.atom_idx as i, b.atom_idx as j, round({d}, 6) as dist from pts a, pts b where {where} and {d} <= {cutoff}"


def _pairs(df: DataFrame) -> DataFrame:
    return df.select("i", "j", r6("dist"))


@query(_pairs_sql(_D, "0.08", "a.grp < 5 and b.grp >= 5"))
def dist_double(spark, sf_dir):
    p = points(spark, sf_dir)
    return _pairs(spatial.pairs(p.where("grp < 5"), p.where("grp >= 5"), 0.08))


@query(_pairs_sql(_D, "0.07"))
def dist_single(spark, sf_dir):
    return _pairs(spatial.self_pairs(points(spark, sf_dir), 0.07))


@query(_pairs_sql(_P, "0.08", "a.grp < 5 and b.grp >= 5"))
def dist_double_pbc(spark, sf_dir):
    p = points(spark, sf_dir)
    return _pairs(spatial.pairs(p.where("grp < 5"), p.where("grp >= 5"), 0.08, ORTHO))


@query(_pairs_sql(_P, "0.07"))
def dist_single_pbc(spark, sf_dir):
    return _pairs(spatial.self_pairs(points(spark, sf_dir), 0.07, ORTHO))


@query(_pairs_sql(_PXY, "0.07"))
def dist_single_pbc_dims(spark, sf_dir):
    return _pairs(spatial.self_pairs(points(spark, sf_dir), 0.07, ORTHO, (1, 1, 0)))


@query(_pairs_sql(_T, "0.07"))
def dist_single_triclinic(spark, sf_dir):
    return _pairs(spatial.self_pairs(points(spark, sf_dir), 0.07, SKEW))


@query(_pairs_sql(_D, "a.vdw + b.vdw + 0.01", "a.grp < 5 and b.grp >= 5"))
def dist_vdw(spark, sf_dir):
    p = points(spark, sf_dir)
    return _pairs(spatial.vdw_pairs(p.where("grp < 5"), p.where("grp >= 5"), 0.06, 0.01))


@query(_pairs_sql(_P, "a.vdw + b.vdw", "a.grp < 5 and b.grp >= 5"))
def dist_vdw_pbc(spark, sf_dir):
    p = points(spark, sf_dir)
    return _pairs(spatial.vdw_pairs(p.where("grp < 5"), p.where("grp >= 5"), 0.06, box=ORTHO))


@query(f"{POINTS_SQL} select atom_idx, grp from pts a where exists (select 1 from pts b where b.grp = 3 and {_P} <= 0.06)")
def within_pbc(spark, sf_dir):
    p = points(spark, sf_dir)
    return select(p.withColumn("resid", F.col("grp")), "within 0.06 pbc of resid 3", box=ORTHO).select("atom_idx", "grp")


@query(f"{POINTS_SQL} select a.atom_idx as i, b.atom_idx as j, round({_D}, 6) as dist, a.grp as grp from pts a, pts b where a.grp = b.grp and a.atom_idx < b.atom_idx and {_D} <= 0.12")
def dist_by_group(spark, sf_dir):
    return spatial.self_pairs(points(spark, sf_dir), 0.12, keys=["grp"]).select("i", "j", r6("dist"), "grp")


@query(f"{POINTS_SQL}, e as (select a.atom_idx as i, b.atom_idx as j from pts a, pts b where a.atom_idx <> b.atom_idx and {_D} <= 0.07) select i as atom, count(*) as n, cast(sum(j) as bigint) as sum_j from e group by i")
def neighbour_lists(spark, sf_dir):
    lists = spatial.neighbour_lists(spatial.self_pairs(points(spark, sf_dir), 0.07))
    return lists.select("atom", F.size("neighbours").cast("long").alias("n"), F.aggregate("neighbours", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_j"))


# -- measures ---------------------------------------------------------------------------------------------------


@query(f"{ATOMS_SQL} select chain, min(x) as min_x, min(y) as min_y, min(z) as min_z, max(x) as max_x, max(y) as max_y, max(z) as max_z from atoms group by chain")
def bbox(spark, sf_dir):
    return measure.min_max(atoms(spark, sf_dir), ["chain"])


@query(f"{ATOMS_SQL} select chain, round(avg(x), 6) as x, round(avg(y), 6) as y, round(avg(z), 6) as z from atoms group by chain")
def cog(spark, sf_dir):
    return measure.center(atoms(spark, sf_dir), ["chain"]).select("chain", r6("x"), r6("y"), r6("z"))


@query(f"{ATOMS_SQL} select resindex, round(sum(mass*x)/sum(mass) + 1e-7, 4) as x, round(sum(mass*y)/sum(mass) + 1e-7, 4) as y, round(sum(mass*z)/sum(mass) + 1e-7, 4) as z from atoms where chain = 'A' and x < 20 group by resindex")
def com(spark, sf_dir):
    chosen = select(atoms(spark, sf_dir), "chain A and x < 20")
    return measure.center(chosen, ["resindex"], weighted=True).select("resindex", *[F.round(F.col(c) + 1e-7, 4).alias(c) for c in "xyz"])


_FIRST = ", f as (select grp, arg_min(x, atom_idx) as x0, arg_min(y, atom_idx) as y0, arg_min(z, atom_idx) as z0 from pts group by grp), u as (select pts.grp, atom_idx, mass, " + ", ".join(f"{c}0 + (({c}-{c}0) - {w} * round(({c}-{c}0) / {w})) as {c}" for c, w in zip("xyz", (0.8, 0.7, 0.6), strict=True)) + " from pts join f on pts.grp = f.grp)"


@query(f"{POINTS_SQL}{_FIRST} select grp, round(avg(x), 6) as x, round(avg(y), 6) as y, round(avg(z), 6) as z from u group by grp")
def cog_pbc(spark, sf_dir):
    return measure.center(points(spark, sf_dir), ["grp"], box=ORTHO).select("grp", r6("x"), r6("y"), r6("z"))


@query(f"{POINTS_SQL}{_FIRST} select grp, round(sum(mass*x)/sum(mass), 6) as x, round(sum(mass*y)/sum(mass), 6) as y, round(sum(mass*z)/sum(mass), 6) as z from u group by grp")
def com_pbc(spark, sf_dir):
    return measure.center(points(spark, sf_dir), ["grp"], weighted=True, box=ORTHO).select("grp", r6("x"), r6("y"), r6("z"))


_CENTRED = ", c as (select {k}, sum(mass*x)/sum(mass) as cx, sum(mass*y)/sum(mass) as cy, sum(mass*z)/sum(mass) as cz from {t} group by {k}), d as (select {t}.*, x-cx as dx, y-cy as dy, z-cz as dz from {t} join c on {t}.{k} = c.{k})"


@query(f"{POINTS_SQL}{_CENTRED.format(k='grp', t='pts')} select grp, round(sqrt(sum(mass*(dx*dx+dy*dy+dz*dz))/sum(mass)), 6) as gyration from d group by grp")
def gyration(spark, sf_dir):
    return measure.gyration(points(spark, sf_dir), ["grp"]).select("grp", r6("gyration"))


@query(f"{POINTS_SQL}{_FIRST}{_CENTRED.format(k='grp', t='u')} select grp, round(sqrt(sum(mass*(dx*dx+dy*dy+dz*dz))/sum(mass)), 6) as gyration from d group by grp")
def gyration_pbc(spark, sf_dir):
    return measure.gyration(points(spark, sf_dir), ["grp"], ORTHO).select("grp", r6("gyration"))


@query(f"{POINTS_SQL}{_CENTRED.format(k='grp', t='pts')} select grp, round(sum(mass*(dy*dy+dz*dz)), 5) as ixx, round(sum(mass*(dx*dx+dz*dz)), 5) as iyy, round(sum(mass*(dx*dx+dy*dy)), 5) as izz, round(-sum(mass*dx*dy), 5) as ixy, round(-sum(mass*dx*dz), 5) as ixz, round(-sum(mass*dy*dz), 5) as iyz from d group by grp")
def inertia_tensor(spark, sf_dir):
    t = measure.inertia_tensor(points(spark, sf_dir), ["grp"])
    return t.select("grp", *[F.round(c, 5).alias(c) for c in ("ixx", "iyy", "izz", "ixy", "ixz", "iyz")])


@query(f"{POINTS_SQL}{_CENTRED.format(k='grp', t='pts')} select grp, round(2*sum(mass*(dx*dx+dy*dy+dz*dz)), 5) as trace from d group by grp")
def inertia_eigen(spark, sf_dir):
    t = measure.inertia(points(spark, sf_dir), ["grp"])
    return t.select("grp", F.round(F.col("moments")[0] + F.col("moments")[1] + F.col("moments")[2], 5).alias("trace"))


def _halves(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.where("grp = 1"), p.where("grp = 1").withColumns({"x": F.col("y") + 0.1, "y": F.col("x") * 1.5, "z": F.col("z") - 0.2})


_PAIRED = f"{POINTS_SQL}, p as (select x as x1, y as y1, z as z1, y + 0.1 as x2, x * 1.5 as y2, z - 0.2 as z2, mass as m from pts where grp = 1)"


@query(f"{_PAIRED} select round(sqrt(avg((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)+(z2-z1)*(z2-z1))), 6) as rmsd from p")
def rmsd(spark, sf_dir):
    return measure.rmsd(*_halves(spark, sf_dir)).select(r6("rmsd"))


@query(f"{_PAIRED} select round(sqrt(sum(m*((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)+(z2-z1)*(z2-z1)))/sum(m)), 6) as rmsd from p")
def rmsd_mw(spark, sf_dir):
    return measure.rmsd(*_halves(spark, sf_dir), weighted=True).select(r6("rmsd"))


@query(f"{_PAIRED}, c as (select sum(m*x1)/sum(m) as a, sum(m*y1)/sum(m) as b, sum(m*z1)/sum(m) as c, sum(m*x2)/sum(m) as d, sum(m*y2)/sum(m) as e, sum(m*z2)/sum(m) as f from p) select round(sum(m*(x2-d)*(x1-a)), 5) as kxx, round(sum(m*(x2-d)*(y1-b)), 5) as kxy, round(sum(m*(y2-e)*(x1-a)), 5) as kyx, round(sum(m*(z2-f)*(z1-c)), 5) as kzz from p, c")
def cov_matrix(spark, sf_dir):
    k = measure.covariance(measure.paired(*_halves(spark, sf_dir)))
    return k.select(*[F.round(c, 5).alias(c) for c in ("kxx", "kxy", "kyx", "kzz")])


@query(f"{POINTS_SQL} select distinct grp, cast(0 as double) as rmsd from pts")
def kabsch_fit(spark, sf_dir):
    a = points(spark, sf_dir)
    moved = modify.translate(modify.rotate(a, (1, 2, 3), 40.0), (1.0, -2.0, 0.5))
    fitted = modify.transform(a, measure.fit_transform(a, moved, ["grp"]), ["grp"])
    return measure.rmsd(fitted, moved, ["grp"]).select("grp", r6("rmsd"))


@query(f"{POINTS_SQL} select distinct grp, cast(0 as double) as ixy, cast(0 as double) as ixz, cast(0 as double) as iyz from pts")
def principal_axes(spark, sf_dir):
    a = points(spark, sf_dir)
    laid = modify.transform(a, measure.principal_transform(a, ["grp"]), ["grp"])
    return measure.inertia_tensor(laid, ["grp"]).select("grp", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("ixy", "ixz", "iyz")])


@query(f"{ATOMS_SQL} select chain, count(x) as n, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std from atoms group by chain")
def mean_std(spark, sf_dir):
    return measure.mean_std(atoms(spark, sf_dir), "x", ["chain"]).select("chain", "n", r6("mean"), r6("std"))


@query("select label as grp, round(avg(embedding[1]), 6) as m0, round(stddev_pop(embedding[64]), 6) as s63 from embeddings group by label")
def mean_std_vec(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("grp"), F.col("embedding").cast("array<double>").alias("v"))
    return measure.mean_std_vec(e, "v", ["grp"]).select("grp", r6(F.col("means")[0], "m0"), r6(F.col("stds")[63], "s63"))


@query(f"{ATOMS_SQL}, b as (select cast(floor(20 * (x - 5) / 40) as bigint) as bin from atoms) select bin, count(*) as n, round(5 + (bin + 0.5) * 2, 6) as center, round(count(*) / (sum(count(*)) over () * 2), 6) as density from b where bin between 0 and 19 group by bin")
def histogram(spark, sf_dir):
    return measure.histogram(atoms(spark, sf_dir), "x", 5, 45, 20, density=True).select("bin", "n", r6("center"), r6("density"))


@query(f"{ATOMS_SQL} select count(*) as n_atoms, count(distinct resid) as n_residues, count(distinct chain) as n_chains from atoms")
def counts(spark, sf_dir):
    return measure.counts(atoms(spark, sf_dir))


# -- changes ----------------------------------------------------------------------------------------------------


def _xyz(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*(keys or ("atom_idx",)), r6("x"), r6("y"), r6("z"))


@query(f"{POINTS_SQL} select atom_idx, round(x + 1, 6) as x, round(y - 2, 6) as y, round(z + 0.5, 6) as z from pts")
def translate(spark, sf_dir):
    return _xyz(modify.translate(points(spark, sf_dir), (1.0, -2.0, 0.5)))


@query(f"{POINTS_SQL} select atom_idx, round(cos(radians(30))*x - sin(radians(30))*y, 6) as x, round(sin(radians(30))*x + cos(radians(30))*y, 6) as y, round(z, 6) as z from pts")
def rotate(spark, sf_dir):
    return _xyz(modify.rotate(points(spark, sf_dir), (0, 0, 1), 30.0))


@query(f"{POINTS_SQL} select atom_idx, " + ", ".join(f"round(({c} / {w} - floor({c} / {w})) * {w}, 6) as {c}" for c, w in zip("xyz", (0.8, 0.7, 0.6), strict=True)) + " from pts")
def wrap(spark, sf_dir):
    return _xyz(modify.wrap(points(spark, sf_dir), ORTHO))


@query(f"{POINTS_SQL}{_FIRST} select atom_idx, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z from u")
def unwrap_simple(spark, sf_dir):
    return _xyz(modify.unwrap_simple(points(spark, sf_dir), ORTHO, ["grp"]))


@query(f"{POINTS_SQL}, n as (select count(*) as total from pts) select cast((i * 2 + j) * total + atom_idx as bigint) as atom_idx, round(x + i * 0.8, 6) as x, round(y + j * 0.7, 6) as y, round(z, 6) as z from pts, n, range(3) r(i), range(2) s(j)")
def replicate(spark, sf_dir):
    return _xyz(modify.replicate(points(spark, sf_dir), ORTHO, (3, 2, 1))[0])


@query(f"{POINTS_SQL}, b as (select 0 as part, atom_idx, x from pts where grp < 3 union all select 1, atom_idx, x from pts where grp = 7) select cast(row_number() over (order by part, atom_idx) - 1 as bigint) as atom_idx, round(x, 6) as x from b")
def append(spark, sf_dir):
    p = points(spark, sf_dir)
    return modify.append(p.where("grp < 3"), p.where("grp = 7")).select("atom_idx", r6("x"))


@query(f"{POINTS_SQL} select cast(row_number() over (order by atom_idx) - 1 as bigint) as atom_idx, round(x, 6) as x from pts where grp <> 4")
def remove_reindex(spark, sf_dir):
    p = points(spark, sf_dir)
    return modify.remove(p, p.where("grp = 4"))[0].select("atom_idx", r6("x"))


@query(f"{POINTS_SQL} select atom_idx, case when grp = 2 then 99.0 else mass end as mass from pts")
def set_same(spark, sf_dir):
    p = points(spark, sf_dir)
    return modify.set_same(p, p.where("grp = 2"), mass=99.0).select("atom_idx", "mass")


# -- boxes ------------------------------------------------------------------------------------------------------


@query("select 1 as id, round(a, 6) as a, round(b, 6) as b, round(c, 6) as c, round(alpha, 4) as alpha, round(beta, 4) as beta, round(gamma, 4) as gamma from (values (3.0, 4.0, 5.0, 75.0, 80.0, 95.0)) t(a, b, c, alpha, beta, gamma)")
def box_lengths_angles(spark, sf_dir):
    m = g.box(g.from_lengths_angles(3.0, 4.0, 5.0, 75.0, 80.0, 95.0))
    return spark.range(1).select(F.lit(1).alias("id"), *[F.round(v, 6 if len(k) == 1 else 4).alias(k) for k, v in g.lengths_angles(m).items()])


@query(f"{POINTS_SQL} select a.atom_idx as i, round({_P}, 6) as dist from pts a, pts b where b.atom_idx = 0")
def min_image(spark, sf_dir):
    p = points(spark, sf_dir)
    q = p.where("atom_idx = 0").select(*[F.col(c).alias(f"q{c}") for c in "xyz"])
    d = g.distance(g.point(), g.point("q"), ORTHO)
    return p.crossJoin(F.broadcast(q)).select(F.col("atom_idx").alias("i"), r6(d, "dist"))


@query(f"{POINTS_SQL} select atom_idx, round(x / 0.8, 6) as fx, round(y / 0.7, 6) as fy, round(z / 0.6, 6) as fz, x >= 0 and x < 0.8 and y >= 0 and y < 0.7 and z >= 0 and z < 0.6 as inside from pts")
def box_coords(spark, sf_dir):
    m = g.box(ORTHO)
    f = g.to_box(g.point(), m)
    return points(spark, sf_dir).select("atom_idx", *[r6(v, f"f{c}") for v, c in zip(f, "xyz", strict=True)], g.is_inside(g.point(), m).alias("inside"))


# -- frames -----------------------------------------------------------------------------------------------------


@query(f"{FRAMES_SQL} select frame_idx, grp, round(x, 6) as x from frames where frame_idx >= 100 and frame_idx < 700 and (frame_idx - 100) % 7 = 0")
def frames_begin_end_skip(spark, sf_dir):
    w = task.FrameWindow("100", "700fr", 7)
    return w.apply(frames(spark, sf_dir)).select("frame_idx", "grp", r6("x"))


@query(f"{FRAMES_SQL} select frame_idx, grp, round(x, 6) as x from frames where frame_idx = (select max(frame_idx) from frames)")
def frames_last(spark, sf_dir):
    return task.last_frame(frames(spark, sf_dir)).select("frame_idx", "grp", r6("x"))


@query(f"{FRAMES_SQL}, a as (select * from frames where frame_idx < 50) select frame_idx, round(x, 6) as x from a union all select frame_idx + 50, round(x, 6) from frames")
def frames_concat(spark, sf_dir):
    f = frames(spark, sf_dir)
    return task.concatenate([f.where("frame_idx < 50"), f]).select("frame_idx", r6("x"))


@query(f"{FRAMES_SQL} select frame_idx, grp from frames where frame_idx = (select min(frame_idx) from frames where time >= (select min(time) + 1000000 from frames))")
def frames_seek_time(spark, sf_dir):
    f = frames(spark, sf_dir)
    start = f.agg((F.min("time") + 1000000).alias("t")).first()["t"]
    return task.seek_time(f, start).select("frame_idx", "grp")


@query(f"{FRAMES_SQL} select cast(frame_idx // 100 as bigint) as block, count(*) as n, round(avg(x), 6) as mean from frames group by 1")
def frames_average(spark, sf_dir):
    class Average(task.FrameTask):
        def per_frame(self, coords: DataFrame) -> DataFrame:
            return coords.groupBy("frame_idx").agg(F.avg("x").alias("x"))

        def finish(self, results: DataFrame) -> DataFrame:
            return results.groupBy(F.floor(F.col("frame_idx") / 100).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"))

    return Average().run(frames(spark, sf_dir)).select("block", "n", r6("mean"))


# -- elements ---------------------------------------------------------------------------------------------------


@query("select name, resname, cast(z as smallint) as z from (values ('CA', 'ALA', 6), ('CA', 'CA', 20), ('SOD', 'SOD', 11), ('1HB2', 'ALA', 1), ('FE', 'HEM', 26), ('OXT', 'ALA', 8), ('', 'X', 0), ('CL', 'CL', 17), ('SG', 'CYS', 106), ('zn', 'ZN', 30)) t(name, resname, z)")
def guess_elements(spark, sf_dir):
    rows = [("CA", "ALA"), ("CA", "CA"), ("SOD", "SOD"), ("1HB2", "ALA"), ("FE", "HEM"), ("OXT", "ALA"), ("", "X"), ("CL", "CL"), ("SG", "CYS"), ("zn", "ZN")]
    return spark.createDataFrame(rows, "name string, resname string").withColumn("z", el.guess(F.col("name"), F.col("resname")))


# -- bond graphs ------------------------------------------------------------------------------------------------

#: Benzene without hydrogens (id 1), protonated methylamine's heavy atoms (2) and pyrrole's ring (3).
_MOLECULES = [(1, i, 6, 0) for i in range(6)] + [(2, 0, 6, 0), (2, 1, 7, 1)] + [(3, i, 7 if i == 0 else 6, 0) for i in range(5)]
_BONDS = [(1, i, i, (i + 1) % 6, 1 + i % 2) for i in range(6)] + [(2, 0, 0, 1, 1)] + [(3, i, i, (i + 1) % 5, (1, 2, 1, 2, 1)[i]) for i in range(5)]
_GRAPH_SQL = f"with atoms(mol_id, atom_idx, z, q) as (values {', '.join(map(str, _MOLECULES))}), bonds(mol_id, bond_idx, i1, i2, o) as (values {', '.join(map(str, _BONDS))}), ends as (select mol_id, i1 as atom_idx, o from bonds union all select mol_id, i2, o from bonds)"


def _molecules(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    a = spark.createDataFrame(_MOLECULES, "mol_id int, atom_idx long, atomic_number int, formal_charge int")
    return a, spark.createDataFrame(_BONDS, "mol_id int, bond_idx long, i1 long, i2 long, order int")


@query(f"{_GRAPH_SQL} select a.mol_id, cast(a.atom_idx as bigint) as atom_idx, count(e.o) as degree, count(*) filter (e.o = 2) as n_double from atoms a left join ends e on a.mol_id = e.mol_id and a.atom_idx = e.atom_idx group by all")
def degree_count(spark, sf_dir):
    return perception.degrees(*_molecules(spark), ["mol_id"]).select("mol_id", "atom_idx", "degree", "n_double")


@query(f"{_GRAPH_SQL} select mol_id, cast(sum(q) as double) as total_charge from atoms group by mol_id")
def total_charge(spark, sf_dir):
    return measure.total_charge(_molecules(spark)[0], ["mol_id"])


@query(f"{_GRAPH_SQL}, v as (select mol_id, atom_idx, sum(o) as used from ends group by all) select a.mol_id, cast(a.atom_idx as bigint) as atom_idx, cast((case z when 6 then 4 else 3 end) + q - used as integer) as implicit_h from atoms a join v on a.mol_id = v.mol_id and a.atom_idx = v.atom_idx")
def implicit_h(spark, sf_dir):
    return perception.perceive(*_molecules(spark)).select("mol_id", "atom_idx", "implicit_h")


@query("select * from (values (1, 6, true), (3, 5, true)) t(mol_id, size, aromatic)")
def rings(spark, sf_dir):
    return perception.rings(*_molecules(spark)).select("mol_id", "size", "aromatic")


@query(f"{POINTS_SQL}, e as (select a.atom_idx as i, b.x as x from pts a, pts b where a.atom_idx <> b.atom_idx and {_D} <= 0.1) select i, count(*) as n, round(avg(x), 6) as mean_x from e group by i")
def neighbour_avg(spark, sf_dir):
    p = points(spark, sf_dir)
    return spatial.neighbour_mean(p, spatial.self_pairs(p, 0.1), ["x"]).select("i", "n", r6("x", "mean_x"))
