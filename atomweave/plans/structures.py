"""Queries of chemistry, formats, systems, commands, secondary structure and membranes, with the SQL that must agree."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..facade import System
from ..functions import elements as el
from ..functions import geometry as g
from ..operators import alignment, commands, measure, membrane, modify, perception, secondary, sequence
from ..operators.selection import BACKBONE, POLAR, PROTEIN, WATER, SelectionSyntaxError, parse, select
from ..sources import files, lines
from ..sources import frames as by_frame
from ..streaming import task
from .catalogue import _D, _PXY, ORACLE_SQL, ORTHO, QUERIES, _xyz, query, r6
from .views import ATOMS_SQL, POINTS_SQL, atoms, points

# -- chemistry: lineitem's atoms with names and residues of proteins, water and others ------------------------------

_NAMES = ("N", "CA", "C", "O", "HA", "OW", "HW1")
_RESIDUES = ("ALA", "GLY", "SOL", "LIG", "TIP3", "SER", "VAL")
_NUMBERS = (7, 6, 6, 8, 1, 8, 1)


def chemical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The atoms view with names by line number, residues by part and atomic numbers by name."""
    a = atoms(spark, sf_dir)
    line = (F.substring("name", 2, 9).cast("int") - 1) % len(_NAMES)
    kind = F.substring("resname", 2, 9).cast("int")
    at = lambda values, k: F.get(F.array(*map(F.lit, values)), k)
    return a.withColumns({"atomic_number": at(_NUMBERS, line).cast("int"), "name": at(_NAMES, line), "resname": at(_RESIDUES, kind)})


def bonded(a: DataFrame) -> DataFrame:
    """Bonds between neighbours in a chain of equal resid."""
    after = a.select((F.col("atom_idx") - 1).alias("i1"), F.col("atom_idx").alias("i2"), F.col("resid").alias("_r"))
    met = a.select(F.col("atom_idx").alias("i1"), "resid").join(after, "i1").where("resid = _r")
    return met.select(F.col("i1").alias("bond_idx"), "i1", "i2", F.lit(1).alias("order"))


def _listed(values) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in sorted(values))


CHEM_SQL = f"""{ATOMS_SQL},
chem as (select * replace ([{", ".join(f"'{n}'" for n in _NAMES)}][(cast(name[2:] as integer) - 1) % 7 + 1] as name, [{", ".join(f"'{n}'" for n in _RESIDUES)}][cast(resname[2:] as integer) + 1] as resname),
  [{", ".join(map(str, _NUMBERS))}][(cast(name[2:] as integer) - 1) % 7 + 1] as atomic_number from atoms),
bonds as (select a.atom_idx as i1, b.atom_idx as i2 from chem a join chem b on b.atom_idx = a.atom_idx + 1 and a.resid = b.resid),
ends as (select i1 as atom_idx, i2 as other from bonds union all select i2, i1 from bonds)
"""
_P, _W, _BB = f"resname in ({_listed(PROTEIN)})", f"resname in ({_listed(WATER)})", f"name in ({_listed(BACKBONE)})"
_TOUCHES = "atomic_number = 1 and exists (select 1 from ends e join chem o on o.atom_idx = e.other where e.atom_idx = a.atom_idx and o.atomic_number {})"

#: Key: selection, SQL condition over chem (aliased a).
_CHEMICAL = {
    "sel_protein": ("protein", _P),
    "sel_backbone": ("backbone", f"{_P} and {_BB}"),
    "sel_sidechain": ("sidechain", f"{_P} and not {_BB}"),
    "sel_water": ("water", _W),
    "sel_now": ("now", f"not {_W}"),
    "sel_hydrogen": ("hydrogen", "name[1] = 'H'"),
    "sel_noh": ("noh", "name[1] <> 'H'"),
    "sel_polh": ("polh", _TOUCHES.format(f"in ({_listed(POLAR)})")),
    "sel_apolh": ("apolh", _TOUCHES.format(f"not in (1, {_listed(POLAR)})")),
    "sel_lexical": ("  ( chain A )or\tresid  5:7  9 and\nname CA   N ", "(chain = 'A' or resid between 5 and 7 or resid = 9) and name in ('CA', 'N')"),
}


def _chosen(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = chemical(spark, sf_dir)
        return select(a, text, bonds=bonded(a)).select("atom_idx", "name", "resname", "chain")

    return run


for _key, (_text, _where) in _CHEMICAL.items():
    QUERIES[_key] = _chosen(_text)
    ORACLE_SQL[_key] = f"{CHEM_SQL} select atom_idx, name, resname, chain from chem a where {_where}"


@query(f"{CHEM_SQL} select distinct name, resname, cast(atomic_number as integer) as z from chem")
def element_numbers(spark, sf_dir):
    a = chemical(spark, sf_dir).select("name", "resname").distinct()
    return a.select("name", "resname", el.guess(F.col("name"), F.col("resname")).cast("int").alias("z"))


_SYMBOLS = [("H", 1), ("he", 2), ("C", 6), ("n", 7), ("O", 8), ("Na", 11), ("CL", 17), ("Fe", 26), ("ZN", 30), ("u", 92), ("Xx", 0), ("", 0)]


@query(f"select symbol, cast(z as integer) as z from (values {', '.join(map(str, _SYMBOLS))}) t(symbol, z)")
def element_symbols(spark, sf_dir):
    return spark.createDataFrame([(s,) for s, _ in _SYMBOLS], "symbol string").select("symbol", el.from_symbol(F.col("symbol")).cast("int").alias("z"))


# -- definitions of selections ------------------------------------------------------------------------------------


@query(f"{ATOMS_SQL} select atom_idx, name from atoms where atom_idx between 100 and 4999")
def select_range(spark, sf_dir):
    return select(atoms(spark, sf_dir), range(100, 5000)).select("atom_idx", "name")


@query(f"{ATOMS_SQL} select atom_idx, name from atoms where atom_idx in (7, 3, 900, 41)")
def select_index_list(spark, sf_dir):
    return select(atoms(spark, sf_dir), [900, 7, 3, 41, 7, 3]).select("atom_idx", "name")


@query(f"{ATOMS_SQL} select atom_idx, name from atoms where atom_idx % 10 = 3")
def select_index_table(spark, sf_dir):
    a = atoms(spark, sf_dir)
    return select(a, a.where("atom_idx % 10 = 3").select("atom_idx")).select("atom_idx", "name")


@query(f"{ATOMS_SQL} select atom_idx, name from atoms where mass > 25 and chain = 'N'")
def select_condition(spark, sf_dir):
    return select(atoms(spark, sf_dir), (F.col("mass") > 25) & (F.col("chain") == "N")).select("atom_idx", "name")


@query(f"{ATOMS_SQL} select chain, cast(resid % 50 as bigint) as part, count(*) as n, round(sum(mass), 4) as mass from atoms group by all")
def split_parallel(spark, sf_dir):
    a = atoms(spark, sf_dir).withColumn("part", F.pmod("resid", F.lit(50)))

    def each(p):
        return p.groupby(["chain", "part"], as_index=False).agg(n=("mass", "size"), mass=("mass", "sum"))

    parts = sequence.apply_groups(a.select("chain", "part", "mass"), each, "chain string, part long, n long, mass double", ["chain", "part"])
    return parts.select("chain", "part", "n", F.round("mass", 4).alias("mass"))


_BAD = [("backboneand x<4", "backboneand"), ("proteinor water", "proteinor"), ("notprotein", "notprotein"), ("chain A an resid 5", "an")]


@query(f"select * from (values {', '.join(map(str, _BAD))}) t(text, token)")
def selection_errors(spark, sf_dir):
    rows = []
    for text, _ in _BAD:
        try:
            parse(text)
        except SelectionSyntaxError as e:
            rows.append((text, e.token))
    return spark.createDataFrame(rows, "text string, token string")


_NEAR3 = "exists (select 1 from pts b where b.grp = 3 and {} <= 0.06)"


def _near(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return select(points(spark, sf_dir).withColumn("resid", F.col("grp")), text, box=ORTHO).select("atom_idx", "grp")

    return run


for _key, (_text, _where) in {
    "sel_within_self": ("resid 1:2 and within 0.06 self of resid 3", f"grp = 3 or (grp in (1, 2) and {_NEAR3.format(_D)})"),
    "sel_within_pbc_dims": ("within 0.06 pbc 1 1 0 of resid 3", _NEAR3.format(_PXY)),
}.items():
    QUERIES[_key] = _near(_text)
    ORACLE_SQL[_key] = f"{POINTS_SQL} select atom_idx, grp from pts a where {_where}"


@query(f"{POINTS_SQL} select atom_idx, grp from pts where atom_idx * 0.5 > 40 and -atom_idx < -100")
def sel_velocity_attribute(spark, sf_dir):
    p = points(spark, sf_dir).withColumns({"vx": F.col("atom_idx") * 0.5, "fz": -F.col("atom_idx").cast("double")})
    return select(p, "vx > 40 and fz < -100").select("atom_idx", "grp")


# -- files ----------------------------------------------------------------------------------------------------------

#: embeddings as a trajectory of ten frames of equal size.
_FRAMES = 10
TRAJECTORY_SQL = f"{POINTS_SQL}, traj as (select cast(atom_idx % {_FRAMES} as bigint) as frame_idx, cast(atom_idx // {_FRAMES} as bigint) as atom_idx, x, y, z from pts)"


def trajectory(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """atoms, coords and frames of ten frames of points."""
    coords = points(spark, sf_dir).select(F.pmod("atom_idx", F.lit(_FRAMES)).alias("frame_idx"), F.floor(F.col("atom_idx") / _FRAMES).alias("atom_idx"), "x", "y", "z")
    own = coords.where("frame_idx = 0").select("atom_idx", F.lit("CA").alias("name"), F.lit("ALA").alias("resname"), (F.col("atom_idx") % 1000).cast("int").alias("resid"), F.lit("A").alias("chain"), F.lit(6).cast("short").alias("atomic_number"), F.lit(12.0).alias("mass"))
    frames = spark.range(_FRAMES).select(F.col("id").alias("frame_idx"), (F.col("id") * 2.0).alias("time"), F.array(*[F.lit(float(v)) for v in ORTHO]).alias("box"))
    return own, coords, frames


def folder(spark: SparkSession) -> str:
    """A new local folder below the shared one; where none is set, a session of one machine gets one of that machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ""
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "atomweave-files")
    path = os.path.join(base.removeprefix("file://").removeprefix("file:"), f"files-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def _round_trip(kind: str, unit: float = 1.0):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own, coords, frames = trajectory(spark, sf_dir)
        path = f"{folder(spark)}/t.{kind}"
        files.write(path, own, coords, frames)
        return files.read(spark, path, "coords").select("frame_idx", "atom_idx", *[F.round(F.col(c) * unit, 6).alias(c) for c in "xyz"])

    return run


_FLOAT = "round(cast(cast({0} as float) as double), 6) + 0.0 as {0}"
_PACKED = "round(round_even({0} * 1000, 0) / 1000, 6) + 0.0 as {0}"
_ANGSTROM = "round(cast(cast({0} * 10 as float) as double) * 0.1, 6) + 0.0 as {0}"
for _kind, _as in {
    "trr": _FLOAT, "dcd": _ANGSTROM, "nc": _ANGSTROM, "xtc": _PACKED, "gro": "round(round({0}, 3), 6) + 0.0 as {0}",
    "pdb": "round(round({0} * 10, 3) * 0.1, 6) + 0.0 as {0}", "xyz": "round({0} * 10, 6) + 0.0 as {0}",
}.items():
    QUERIES[f"file_{_kind}"] = _round_trip(_kind, 10.0 if _kind == "xyz" else 1.0)
    ORACLE_SQL[f"file_{_kind}"] = f"{TRAJECTORY_SQL} select frame_idx, atom_idx, {', '.join(_as.format(c) for c in 'xyz')} from traj"


def _written(spark: SparkSession, sf_dir: str, kind: str) -> str:
    own, coords, frames = trajectory(spark, sf_dir)
    path = f"{folder(spark)}/t.{kind}"
    files.write(path, own, coords, frames)
    return path


#: What is taken of a file's index of frames, and the same over the table.
_TAKEN = {
    "window": ("xtc", lambda i: task.FrameWindow("2", "14ps", 2).apply(i, ["path"]), "frame_idx >= 2 and frame_idx * 2.0 <= 14 and (frame_idx - 2) % 2 = 0"),
    "seek": ("dcd", lambda i: task.seek_time(i, 5.0), "frame_idx = 3"),
    "last": ("nc", task.last_frame, "frame_idx = 9"),
    "ranges": ("trr", None, "true"),
}


def _frames_of_file(name: str):
    kind, chosen, _ = _TAKEN[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = by_frame.read_frames(spark, _written(spark, sf_dir, kind), ("frame_idx", "time", "atom_idx", "x", "z"), chosen)
        return got.select("frame_idx", "time", "atom_idx", F.round("x", 6).alias("x"), F.round("z", 6).alias("z"))

    return run


for _name, (_kind, _, _where) in _TAKEN.items():
    _as = {"xtc": _PACKED, "trr": _FLOAT}.get(_kind, _ANGSTROM)
    QUERIES[f"file_frames_{_name}"] = _frames_of_file(_name)
    ORACLE_SQL[f"file_frames_{_name}"] = f"{TRAJECTORY_SQL} select frame_idx, frame_idx * 2.0::double as time, atom_idx, {_as.format('x')}, {_as.format('z')} from traj where {_where}"


@query(f"{TRAJECTORY_SQL} select count(*) as frames, max(frame_idx) * 2.0::double as last_time, sum(n * 12 + 120)::bigint as bytes from (select frame_idx, count(*) as n from traj group by frame_idx)")
def file_statistics(spark, sf_dir):
    return by_frame.statistics(by_frame.frame_index(spark, _written(spark, sf_dir, "trr"))).drop("path")


@query(f"{TRAJECTORY_SQL} select frame_idx, frame_idx * 2.0::double as time, round(cast(0.8 as float)::double, 6) as a from traj where atom_idx = 0")
def file_frames(spark, sf_dir):
    own, coords, frames = trajectory(spark, sf_dir)
    path = f"{folder(spark)}/t.trr"
    files.write(path, own, coords, frames)
    return files.read(spark, path, "frames").select("frame_idx", "time", F.round(F.col("box")[0], 6).alias("a"))


@query(f"{TRAJECTORY_SQL} select atom_idx, 'CA' as name, 'ALA' as resname, cast(atom_idx % 1000 as integer) as resid, cast(6 as smallint) as atomic_number, dense_rank() over (order by atom_idx) - 1 as resindex from traj where frame_idx = 0")
def file_topology(spark, sf_dir):
    own, coords, frames = trajectory(spark, sf_dir)
    path = f"{folder(spark)}/t.gro"
    files.write(path, own, coords.where("frame_idx = 0"), frames)
    return files.read(spark, path, "atoms").select("atom_idx", "name", "resname", "resid", "atomic_number", "resindex")


@query("select cast(i as bigint) as bond_idx, cast(i as bigint) as i1, cast((i + 1) % 20 as bigint) as i2, cast(1 + i % 2 as tinyint) as \"order\" from range(20) t(i)")
def file_sdf_bonds(spark, sf_dir):
    ring = spark.range(20).select(F.col("id").alias("atom_idx"), F.lit("C").alias("name"), F.lit("MOL").alias("resname"), F.lit(1).alias("resid"), F.lit(6).cast("short").alias("atomic_number"))
    coords = spark.range(20).select(F.lit(0).cast("long").alias("frame_idx"), F.col("id").alias("atom_idx"), *[F.cos(F.col("id") + k).alias(c) for k, c in enumerate("xyz")])
    bonds = spark.range(20).select(F.col("id").alias("bond_idx"), F.col("id").alias("i1"), ((F.col("id") + 1) % 20).alias("i2"), (1 + F.col("id") % 2).cast("int").alias("order"))
    path = f"{folder(spark)}/t.sdf"
    files.write(path, ring, coords, bonds=bonds)
    return files.read(spark, path, "bonds").select("bond_idx", "i1", "i2", "order")


@query(f"{CHEM_SQL} select atom_idx, name, resname, resid, round(mass, 4) as mass, round(charge, 4) as charge from chem")
def file_itp(spark, sf_dir):
    a = chemical(spark, sf_dir)
    path = f"{folder(spark)}/m.itp"
    four = lambda c: F.when(F.abs(F.col(c)) < 1e18, F.col(c).cast("decimal(38,4)").cast("string")).otherwise(F.format_string("%.4f", F.col(c)))
    fields = [(F.col("atom_idx") + 1).cast("string"), F.concat(F.lit("T"), F.col("atomic_number").cast("string")), F.col("resid").cast("string"), F.col("resname"), F.col("name"), F.lit("1"), four("charge"), four("mass")]
    line = F.concat(fields[0], *[x for f in fields[1:] for x in (F.lit(" "), f)])
    lines.write_lines(path, a, "atom_idx", line, "[ moleculetype ]\nM 3\n[ atoms ]\n", "[ bonds ]\n1 2\n")
    return files.read(spark, path, "atoms").select("atom_idx", "name", "resname", F.col("resid").cast("long").alias("resid"), F.round("mass", 4).alias("mass"), F.round("charge", 4).alias("charge"))


@query(f"{ATOMS_SQL} select chain as name, atom_idx from atoms")
def file_ndx(spark, sf_dir):
    a = atoms(spark, sf_dir)
    path = f"{folder(spark)}/g.ndx"
    with open(path, "w") as f:
        for chain in ("A", "N", "R"):
            for r in sequence.ndx_text(select(a, f"chain {chain}"), chain).orderBy("line_no").toLocalIterator():
                f.write(r.line + "\n")
    return files.read_groups(spark, path).select("name", "atom_idx")


def _system(spark: SparkSession, sf_dir: str) -> System:
    own, coords, frames = trajectory(spark, sf_dir)
    base = folder(spark)
    files.write(f"{base}/t.gro", own, coords.where("frame_idx = 0"), frames)
    files.write(f"{base}/t.trr", own, coords, frames)
    return System.open(spark, f"{base}/t.gro", f"{base}/t.trr")


@query(f"{TRAJECTORY_SQL} select frame_idx, round(avg(x), 5) as x, round(avg(y), 5) as y, round(avg(z), 5) as z from traj where atom_idx % 1000 between 10 and 30 group by frame_idx")
def system_com(spark, sf_dir):
    return _system(spark, sf_dir)("resid 10:30").com().select("frame_idx", *[F.round(c, 5).alias(c) for c in "xyz"])


@query(f"{TRAJECTORY_SQL} select a.frame_idx, a.atom_idx as i, b.atom_idx as j from traj a, traj b where a.frame_idx = b.frame_idx and a.atom_idx < b.atom_idx and {_D} <= 0.1")
def system_neighbours(spark, sf_dir):
    return _system(spark, sf_dir)().neighbours(None, 0.1).select("frame_idx", "i", "j")


@query(f"{TRAJECTORY_SQL} select frame_idx, atom_idx from traj where (atom_idx < 20 or atom_idx % 1000 between 40 and 45) and atom_idx <> 3")
def system_sets(spark, sf_dir):
    s = _system(spark, sf_dir)
    return ((s((0, 20)) | s("resid 40:45")) - s([3])).rows.select("frame_idx", "atom_idx")


@query("select true as same")
def system_sizes(spark, sf_dir):
    return spark.createDataFrame([(_system(spark, sf_dir).check_sizes(),)], "same boolean")


@query(f"{TRAJECTORY_SQL} select frame_idx + 1 as frame_idx, atom_idx, round(x, 5) as x from traj union all select 0, atom_idx, round(x, 5) from traj where frame_idx = 0")
def frames_structure_first(spark, sf_dir):
    _, coords, _ = trajectory(spark, sf_dir)
    return task.concatenate([coords], coords.where("frame_idx = 0")).select("frame_idx", "atom_idx", F.round("x", 5).alias("x"))


@query(f"{TRAJECTORY_SQL} select frame_idx, round(avg(x), 6) as x from traj where frame_idx >= 1 and frame_idx < 9 and (frame_idx - 1) % 3 = 0 group by frame_idx")
def frames_stream(spark, sf_dir):
    """The windowed task as a stream over a folder of coordinates."""

    class Mean(task.FrameTask):
        def per_frame(self, coords: DataFrame) -> DataFrame:
            return coords.groupBy("frame_idx").agg(F.avg("x").alias("x"))

    _, coords, frames = trajectory(spark, sf_dir)
    base = folder(spark)
    coords.join(frames.select("frame_idx", "time"), "frame_idx").write.parquet(f"file://{base}/in")
    source = task.frame_stream(spark, f"file://{base}/in", spark.read.parquet(f"file://{base}/in").schema)
    Mean(task.FrameWindow("1", "9", 3)).stream(source, lambda df, k: df.write.mode("overwrite").parquet(f"file://{base}/out/batch={k}"), f"file://{base}/check").awaitTermination()
    return spark.read.parquet(f"file://{base}/out").select("frame_idx", r6("x"))


# -- boxes and vectors ------------------------------------------------------------------------------------------------


@query(f"{POINTS_SQL} select atom_idx, " + ", ".join(f"round(0.1 + (({c}-0.1) - {w} * round_even(({c}-0.1) / {w}, 0)), 6) as {c}" for c, w in zip("xyz", (0.8, 0.7, 0.6), strict=True)) + " from pts")
def closest_image(spark, sf_dir):
    p = points(spark, sf_dir)
    q = g.closest_image(g.point(), g.vec((0.1, 0.1, 0.1)), ORTHO)
    return p.select("atom_idx", *[r6(v, c) for v, c in zip(q, "xyz", strict=True)])


@query("select 1 as id, 0.8::double as ex, round(sqrt(0.04 + 0.49), 6) as ey, round(sqrt(0.01 + 0.0225 + 0.36), 6) as ez, 0.9::double as lx, 0.85::double as ly, 0.6::double as lz, round(0.8::double * 0.7 * 0.6, 6) as volume, 1.6::double as sx, round(0.7::double * 3, 6) as sy")
def box_extents(spark, sf_dir):
    m = g.box([0.8, 0, 0, 0.2, 0.7, 0, -0.1, 0.15, 0.6])
    e, lab, s = g.extents(m), g.lab_extents(m), g.scale_vectors(m, (2, 3, 4))
    out = {"ex": e[0], "ey": e[1], "ez": e[2], "lx": lab[0], "ly": lab[1], "lz": lab[2], "volume": g.volume(m), "sx": s[0], "sy": s[4]}
    return spark.range(1).select(F.lit(1).alias("id"), *[r6(v, k) for k, v in out.items()])


_BOXES = [("zero vector", [1, 0, 0, 0, 0, 0, 0, 0, 1], False), ("flat", [1, 0, 0, 2, 0, 0, 0, 0, 1], False), ("good", [1, 0, 0, 0, 2, 0, 0, 0, 3], True), ("short", [1, 2, 3], False)]


@query("select * from (values " + ", ".join(f"('{n}', {str(ok).lower()})" for n, _, ok in _BOXES) + ") t(name, ok)")
def box_checks(spark, sf_dir):
    rows = []
    for name, values, _ in _BOXES:
        try:
            g.check_box(values)
            rows.append((name, True))
        except (ValueError, IndexError):
            rows.append((name, False))
    return spark.createDataFrame(rows, "name string, ok boolean")


# -- changes and commands -----------------------------------------------------------------------------------------------


@query(f"{ATOMS_SQL}, o as (select *, case when chain = 'R' then 0 when chain = 'A' and x > 30 then 2 else 1 end as part from atoms) select cast(row_number() over (order by part, atom_idx) - 1 as bigint) as atom_idx, resid, chain from o")
def rearrange(spark, sf_dir):
    return commands.rearrange(atoms(spark, sf_dir), ["chain R"], ["chain A and x > 30"]).select("atom_idx", "resid", "chain")


_WATERS = f"{POINTS_SQL}, w as (select atom_idx as r, x * 100 as x, y * 100 as y, z * 100 as z from pts)"


def _waters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A three-point water at each of the points (100 times farther apart)."""
    p = points(spark, sf_dir)
    sites = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("name"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (n, dx, dy) in enumerate((("OW", 0.0, 0.0), ("HW1", 0.08, 0.06), ("HW2", 0.08, -0.06)))]))
    s = p.select("atom_idx", "x", "y", "z", sites.alias("s"))
    return s.select(
        (F.col("atom_idx") * 3 + F.col("s.k")).alias("atom_idx"), F.col("s.name").alias("name"), F.lit("TIP3").alias("resname"), F.col("atom_idx").cast("int").alias("resid"), F.col("atom_idx").alias("resindex"), F.lit("W").alias("chain"),
        (F.col("x") * 100 + F.col("s.dx")).alias("x"), (F.col("y") * 100 + F.col("s.dy")).alias("y"), (F.col("z") * 100).alias("z"), F.lit(1.0).alias("mass"),
    )


@query(f"{_WATERS} select r * 4 + k as atom_idx, name, 'TIP4' as resname, round(x + dx, 5) as x, round(y + dy, 5) as y, round(z, 5) as z from w, (values (0, 'OW', 0.0, 0.0), (1, 'HW1', 0.08, 0.06), (2, 'HW2', 0.08, -0.06), (3, 'M', 0.01546, 0.0)) t(k, name, dx, dy)")
def tip3_to_tip4(spark, sf_dir):
    return commands.tip3_to_tip4(_waters(spark, sf_dir)).select("atom_idx", "name", "resname", *[F.round(c, 5).alias(c) for c in "xyz"])


@query(f"{ATOMS_SQL} select chain, round(sum(mass), 4) as mass, min(x) + 5 as min_x from atoms group by chain")
def modify_attributes(spark, sf_dir):
    a = modify.translate(atoms(spark, sf_dir), (5.0, 0.0, 0.0))
    return a.groupBy("chain").agg(F.round(F.sum("mass"), 4).alias("mass"), F.min("x").alias("min_x"))


@query(f"{POINTS_SQL} select atom_idx, round(0.5 * x - 1, 6) as x, round(2 * y, 6) as y, round(x + z, 6) as z from pts")
def transform_matrix(spark, sf_dir):
    p = points(spark, sf_dir)
    t = spark.createDataFrame([([0.5, 0.0, 0.0, 0.0, 2.0, 0.0, 1.0, 0.0, 1.0], [-1.0, 0.0, 0.0])], "rotation array<double>, shift array<double>")
    return _xyz(modify.transform(p, t))


@query(f"{POINTS_SQL} select distinct grp, cast(0 as double) as rmsd from pts")
def fit_matching(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("name", F.concat(F.lit("N"), (F.col("atom_idx") % 7).cast("string")))
    moved = modify.translate(modify.rotate(p, (1, 0, 1), 70.0), (0.3, 0.1, -0.4))
    fitted = modify.transform(p, alignment.fit_matching(p, moved, ["grp"]), ["grp"])
    return measure.rmsd(fitted, moved, ["grp"]).select("grp", F.round("rmsd", 5).alias("rmsd"))


@query(f"{POINTS_SQL} select grp, atom_idx as i, atom_idx as j from pts")
def alignment_matches(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("name", F.concat(F.lit("N"), (F.col("atom_idx") % 7).cast("string")))
    return alignment.matches(p, p, ["grp"]).select("grp", "i", "j")


@query(f"{POINTS_SQL} select atom_idx, round(4 * pi() * (vdw + 0.14) * (vdw + 0.14), 6) as area from pts")
def sasa_apart(spark, sf_dir):
    p = points(spark, sf_dir).withColumns({"x": F.col("atom_idx") * 10.0, "y": F.col("y") * 0, "z": F.col("z") * 0})
    return measure.sasa(p).select("atom_idx", r6("area"))


_ZIGZAG = "select l, c, case when c % 2 = 0 then 0.0 else 0.1 end as x, 0.13 * c as z from range(20) r(l), range(8) s(c)"


@query(f"with t as ({_ZIGZAG}) select cast(l as bigint) as lipid, cast(c as bigint) as carbon, cast(1 as double) as \"order\" from t where c between 1 and 6")
def tail_order_sz(spark, sf_dir):
    t = spark.range(20).select(F.col("id").alias("lipid"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("carbon"))
    t = t.withColumns({"x": (F.col("carbon") % 2) * 0.1, "y": F.lit(0.0), "z": F.col("carbon") * 0.13, "nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0), "bond_order": F.lit(1)})
    return measure.tail_order(t, ["lipid"], kind="Sz").select("lipid", "carbon", r6("order"))


# -- secondary structure --------------------------------------------------------------------------------------------

#: A straight backbone: a residue's N, CA, C and O a step of 0.36 nm after the one before.
_STEP = 0.36
_BACKBONE = (("N", 0.0, 0.0), ("CA", 0.1, 0.1), ("C", 0.25, 0.1), ("O", 0.3, 0.2))


def backbone(spark: SparkSession, sf_dir: str, strands: bool = False) -> DataFrame:
    """One residue for each point, in order of vec_id; strands: every other one 0.5 nm below."""
    sites = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("name"), F.lit(x).alias("x"), F.lit(y).alias("y")) for k, (n, x, y) in enumerate(_BACKBONE)]))
    k = F.col("atom_idx")
    x, y = (_STEP * (F.floor(k / 2) + k % 2), -0.5 * (k % 2)) if strands else (_STEP * k, F.lit(0.0))
    p = points(spark, sf_dir).select("atom_idx", x.alias("x0"), y.alias("y0"), sites.alias("s"))
    return p.select((k * 4 + F.col("s.k")).alias("atom_idx"), F.col("s.name").alias("name"), F.when(k % 10 == 9, "PRO").otherwise("ALA").alias("resname"), k.alias("resindex"), (F.col("x0") + F.col("s.x")).alias("x"), (F.col("y0") + F.col("s.y")).alias("y"), F.lit(0.0).alias("z"))


@query(f"{POINTS_SQL} select atom_idx as resindex, atom_idx % 10 <> 9 and atom_idx > 0 as has_h, case when atom_idx % 10 <> 9 and atom_idx > 0 then round({_STEP} * atom_idx - 0.1 * 0.05 / sqrt(0.0125), 5) end as hx from pts")
def backbone_hydrogens(spark, sf_dir):
    r = secondary.backbones(backbone(spark, sf_dir))
    return r.select("resindex", F.col("h").isNotNull().alias("has_h"), F.round(F.col("h.x"), 5).alias("hx"))


_BONDED = f""", sites as (select atom_idx as k, {_STEP} * (atom_idx // 2 + atom_idx % 2) as x, -0.5 * (atom_idx % 2) as y from pts),
r as (select k, [x, y] as n, [x + 0.1, y + 0.1] as ca, [x + 0.25, y + 0.1] as c, [x + 0.3, y + 0.2] as o, k % 10 <> 9 and k > 0 as has, [x - 0.1 * 0.05 / sqrt(0.0125), y - 0.1 * 0.1 / sqrt(0.0125)] as h from sites),
e as (select a.k as donor, b.k as acceptor, 0.084 * 33.2 * (1 / list_distance(b.o, a.n) + 1 / list_distance(b.c, a.h) - 1 / list_distance(b.o, a.h) - 1 / list_distance(b.c, a.n)) as energy
  from r a, r b where a.has and abs(a.k - b.k) >= 2 and list_distance(a.ca, b.ca) <= 0.9)"""


@query(f"{POINTS_SQL}{_BONDED} select donor, acceptor, round(energy, 5) as energy from e where energy < -0.5")
def hydrogen_bonds(spark, sf_dir):
    found = secondary.hydrogen_bonds(secondary.backbones(backbone(spark, sf_dir, strands=True)))
    return found.select("donor", "acceptor", F.round("energy", 5).alias("energy"))


@query(f"{POINTS_SQL} select repeat('~', count(*)::integer) as ss from pts")
def secondary_coil(spark, sf_dir):
    return secondary.ss_string(secondary.assign(backbone(spark, sf_dir))).select("ss")


# -- bond graphs --------------------------------------------------------------------------------------------------------


@query(f"{CHEM_SQL}, u as (select a.atom_idx, count(e.other) as degree, count(*) filter (o.atomic_number = 1) as n_hydrogen from chem a left join ends e on a.atom_idx = e.atom_idx left join chem o on o.atom_idx = e.other group by a.atom_idx) select * from u")
def degree_of_atoms(spark, sf_dir):
    a = chemical(spark, sf_dir)
    return perception.degrees(a, bonded(a)).select("atom_idx", "degree", "n_hydrogen")


@query(f"{CHEM_SQL} select cast(count(*) as bigint) as missing from bonds where i1 % 3 = 0")
def missing_bond_orders(spark, sf_dir):
    b = bonded(chemical(spark, sf_dir)).withColumn("order", F.when(F.col("i1") % 3 == 0, 0).otherwise(1))
    return perception.missing_orders(b).agg(F.count(F.lit(1)).alias("missing"))


# -- membranes ------------------------------------------------------------------------------------------------------------

_SIDE, _SPACING = 12, 0.8
_CONFIG = 'cutoff = 1.3\n[lipids.LIP]\nwhole = "resname LIP"\nhead = "name P"\nmid = "name C1"\ntails = ["C1-C2"]\n'


def bilayer(spark: SparkSession) -> tuple[DataFrame, list[float]]:
    """One flat leaflet of 144 upright lipids of three beads on a square lattice."""
    n = _SIDE * _SIDE
    beads = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(b).alias("name"), F.lit(z).alias("z")) for k, (b, z) in enumerate((("P", 2.0), ("C1", 1.6), ("C2", 1.0)))]))
    s = spark.range(n).select("id", beads.alias("s"))
    a = s.select((F.col("id") * 3 + F.col("s.k")).alias("atom_idx"), F.col("s.name").alias("name"), F.lit("LIP").alias("resname"), F.col("id").cast("int").alias("resid"), F.col("id").alias("resindex"), (F.floor(F.col("id") / _SIDE) * _SPACING).alias("x"), (F.col("id") % _SIDE * _SPACING).alias("y"), F.col("s.z").alias("z"), F.lit(1.0).alias("mass"))
    return a, [_SIDE * _SPACING, 0, 0, 0, _SIDE * _SPACING, 0, 0, 0, 9]


_LIPIDS = f"with l as (select cast(i as bigint) as lipid_id, cast({_SPACING} as double) * (i // {_SIDE}) as x, cast({_SPACING} as double) * (i % {_SIDE}) as y from range({_SIDE * _SIDE}) t(i))"


def _lipids(spark: SparkSession) -> tuple[DataFrame, DataFrame, list[float]]:
    a, box = bilayer(spark)
    lipids = membrane.markers(a, list(membrane.read_config(_CONFIG).lipids.values()), box)
    return lipids, membrane.patches(lipids, 1.3, box), box


@query(f"{_LIPIDS} select lipid_id, 'LIP' as species, round(x, 6) as x, round(y, 6) as y, cast(2 as double) as head_z, cast(1.6 as double) as mid_z, cast(1 as double) as tail_z from l")
def lipid_markers(spark, sf_dir):
    lipids, _, _ = _lipids(spark)
    return lipids.select("lipid_id", "species", r6(F.col("head.x"), "x"), r6(F.col("head.y"), "y"), r6(F.col("head.z"), "head_z"), r6(F.col("mid.z"), "mid_z"), r6(F.col("tail.z"), "tail_z"))


_LATTICE = f"(({{0}} // {_SIDE}) - ({{1}} // {_SIDE}) + {_SIDE * 3 // 2}) % {_SIDE} - {_SIDE // 2}"
_LATTICE_Y = f"(({{0}} % {_SIDE}) - ({{1}} % {_SIDE}) + {_SIDE * 3 // 2}) % {_SIDE} - {_SIDE // 2}"


@query(f"{_LIPIDS} select a.lipid_id as i, b.lipid_id as j, round(cast({_SPACING} as double) * ({_LATTICE.format('b.lipid_id', 'a.lipid_id')}), 6) as dx, round(cast({_SPACING} as double) * ({_LATTICE_Y.format('b.lipid_id', 'a.lipid_id')}), 6) as dy from l a, l b where a.lipid_id <> b.lipid_id and abs({_LATTICE.format('b.lipid_id', 'a.lipid_id')}) <= 1 and abs({_LATTICE_Y.format('b.lipid_id', 'a.lipid_id')}) <= 1")
def lipid_patches(spark, sf_dir):
    _, near, _ = _lipids(spark)
    return near.select("i", "j", (F.round("d.x", 6) + F.lit(0.0)).alias("dx"), (F.round("d.y", 6) + F.lit(0.0)).alias("dy"))


@query(f"{_LIPIDS} select lipid_id, cast(0 as double) as nx, cast(0 as double) as ny, cast(1 as double) as nz from l")
def lipid_normals(spark, sf_dir):
    lipids, near, _ = _lipids(spark)
    return membrane.normals(lipids, near).select("lipid_id", *[(F.round(F.col(f"normal.{c}"), 5) + F.lit(0.0)).alias(f"n{c}") for c in "xyz"])


@query(f"{_LIPIDS} select lipid_id, true as valid, round(cast({_SPACING} as double) * cast({_SPACING} as double), 5) as area, cast(0 as double) as mean_curvature, cast(0 as double) as gaussian_curvature from l")
def lipid_surface(spark, sf_dir):
    a, box = bilayer(spark)
    _, surface = membrane.analyse(a, membrane.read_config(_CONFIG), box)
    return surface.select("lipid_id", "valid", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("area", "mean_curvature", "gaussian_curvature")])


@query(f"{_LIPIDS} select 'LIP' as species, count(*) as n, round(cast({_SPACING} as double) * cast({_SPACING} as double), 5) as area_mean, cast(0 as double) as tilt_mean from l")
def lipid_stats(spark, sf_dir):
    a, box = bilayer(spark)
    lipids, surface = membrane.analyse(a, membrane.read_config(_CONFIG), box)
    return membrane.group_stats(lipids, surface).select("species", "n", F.round("area_mean", 5).alias("area_mean"), (F.round("tilt_mean", 3) + F.lit(0.0)).alias("tilt_mean"))
