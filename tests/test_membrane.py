import numpy as np
import pytest
from pyspark.sql import functions as F

from atomweave import __main__ as command
from atomweave.operators import measure, membrane
from atomweave.sources import files, reports

BOX = [4.8, 0, 0, 0, 4.8, 0, 0, 0, 9]
CONFIG = 'cutoff = 1.3\n[lipids.LIP]\nwhole = "resname LIP"\nhead = "name P"\nmid = "name C1"\ntails = ["C1-C2"]\n[lipids.POP]\nwhole = "resname POP"\nhead = "name P"\nmid = "name C1"\ntails = ["C1-C2"]\n'


def bumpy(spark, frames=2):
    """36 lipids of two species on a grid, heads raised at random; every third frame_idx is missing one species' last lipid."""
    rng, rows = np.random.default_rng(3), []
    for f in range(frames):
        n = 0
        for a in range(6):
            for b in range(6):
                up = rng.uniform(-0.1, 0.1)
                for name, z in (("P", 2.0 + up), ("C1", 1.6 + up), ("C2", 1.0 + up)):
                    rows.append((f, n, name, "LIP" if (a + b) % 3 else "POP", a * 6 + b, a * 6 + b, 0.8 * a, 0.8 * b, z, 1.0))
                    n += 1
    return spark.createDataFrame(rows, "frame_idx long, atom_idx long, name string, resname string, resid int, resindex long, x double, y double, z double, mass double")


def test_smoothing(spark):
    """One round of smoothing against the same by hand, from the fits of each lipid."""
    config = membrane.read_config(CONFIG)
    keys = ["frame_idx"]
    atoms = bumpy(spark, 1).cache()
    lipids = membrane.markers(atoms, list(config.lipids.values()), BOX, keys).cache()
    near = membrane.patches(lipids, config.cutoff, BOX, keys).cache()
    lipids = membrane.normals(lipids, near, keys).cache()
    before = membrane.fits(lipids, near, keys).cache()
    first = membrane.smooth_markers(lipids, before, keys).cache()
    head = {r.lipid_id: np.array(r.head) for r in lipids.collect()}
    normal = {r.lipid_id: np.array(r.normal) for r in lipids.collect()}
    patch = {i: [] for i in head}
    for r in near.collect():
        patch[r.i].append((r.j, np.array(r.d)))
    points = {i: [] for i in head}
    for i, met in patch.items():
        axes = membrane.frame_of(normal[i])
        local = np.array([d for _, d in met]) @ axes.T
        q = membrane.fit_quadric(np.vstack((local, np.zeros(3))))
        height = lambda x, y: q @ np.array([x * x, y * y, x * y, x, y, 1.0])
        for (j, _), (x, y, z) in [*zip(met, local, strict=True), ((i, None), (0.0, 0.0, 0.0))]:
            points[j].append((height(x, y) - z) * axes[2])
    for r in first.collect():
        assert np.allclose(r.head, head[r.lipid_id] + np.mean(points[r.lipid_id], axis=0)) and not r.lost
    config.n_shells_patch = 2  # a round more, whose heads are those of first
    got, _ = membrane.fitted(atoms, config, BOX, keys)
    heads = {r.lipid_id: r.head for r in first.collect()}
    assert all(np.allclose(r.head, heads[r.lipid_id]) for r in got.collect())


def test_groups(spark, tmp_path):
    keys = ["frame_idx"]
    lipids, fit = (t.cache() for t in membrane.fitted(bumpy(spark), membrane.read_config(CONFIG), BOX, keys))
    groups = membrane.groups_of(lipids, {"all": F.lit(True), "left": F.col("head.x") < 1.2, "late": F.col("frame_idx") == 1}, keys)
    stats = {(r.group, r.species): r for r in membrane.species_stats(lipids, fit, groups, keys).collect()}
    near = {(r.group, r.species, r.neighbour): r for r in membrane.neighbour_stats(lipids, fit, groups, keys).collect()}
    rows = {(r.frame_idx, r.lipid_id): r for r in lipids.collect()}
    surface = {(r.frame_idx, r.lipid_id): r for r in fit.collect() if r.valid}
    inside = {"all": lambda k: True, "left": lambda k: rows[k].head.x < 1.2, "late": lambda k: k[0] == 1}
    for group, test in inside.items():
        for species in ("LIP", "POP"):
            own = [k for k in surface if test(k) and rows[k].species == species]
            per = [sum(k[0] == f for k in own) for f in (0, 1)]
            r = stats[group, species]
            assert np.isclose(r.num, np.mean(per)) and np.isclose(r.num_std, np.std(per))
            assert np.isclose(r.area, np.mean([surface[k].area for k in own])) and np.isclose(r.area_std, np.std([surface[k].area for k in own]), atol=1e-6)
            assert np.isclose(r.neighbours, np.mean([len(surface[k].neighbours) for k in own]))
            tilt = [np.degrees(np.arccos(np.clip(np.dot(rows[k].normal, (0, 0, 1)), -1, 1))) for k in own]
            assert np.isclose(r.tilt, np.mean(tilt), atol=1e-5)
            for other in ("LIP", "POP"):
                share = [sum(rows[f, j].species == other for k in own if k[0] == f for j in surface[k].neighbours) / per[f] for f in (0, 1) if per[f]]
                assert np.isclose(near[group, species, other].mean, np.mean(share)) and np.isclose(near[group, species, other].std, np.std(share), atol=1e-6)
    text = [r.line for r in reports.stats_lines(membrane.species_stats(lipids, fit, groups, keys), "all").orderBy("line_no").collect()]
    assert text[0].startswith("#species\tnum\tnum_std\tarea") and [t.split("\t")[0] for t in text[1:]] == ["LIP", "POP"] and text[1].split("\t")[1] == "  24.000"
    out = tmp_path / "n.dat"
    assert reports.save(reports.neighbour_lines(membrane.species_stats(lipids, fit, groups, keys), membrane.neighbour_stats(lipids, fit, groups, keys), "all"), str(out)) == 8
    assert [line[:5] for line in out.read_text().split("\n")[:4]] == ["LIP:\t", "\tLIP\t", "\tPOP\t", ""]
    drawn = [r.line for r in reports.membrane_drawing(lipids, fit, keys).orderBy("line_no").limit(1).collect()][0].split("\n")
    assert drawn[0] == "draw color white" and drawn[1].startswith('draw sphere "') and sum(d.startswith("draw cylinder") for d in drawn) == 1 + len(surface[0, 0].cell)
    none = membrane.species_stats(lipids.limit(0), fit, groups, keys)
    assert none.count() == 0


def test_text_reports(spark):
    order = spark.createDataFrame([(0, 2, 0.2), (0, 2, 0.4), (0, 3, 0.5), (1, 2, 0.1)], "tail int, carbon long, order double")
    assert [r.line for r in reports.order_lines(order).orderBy("line_no").collect()] == ["# time\taver\ttail1\ttail2", "2.000\t0.200\t0.300\t0.100", "3.000\t0.500\t0.500\t--"]
    found = measure.histogram(spark.createDataFrame([(0.1,), (0.1,), (0.9,)], "v double"), "v", 0.0, 1.0, 4)
    assert [r.line for r in reports.histogram_lines(found, 0.0, 1.0, 4).orderBy("line_no").collect()] == ["0.125 2.0", "0.375 0.0", "0.625 0.0", "0.875 1.0"]
    assert reports.polygon_lines([(0.0, 1.5), (2.0, 3.0)]) == "0.0 1.5\n2.0 3.0\n"
    line = spark.range(1).select(reports.arrow((F.lit(0.0), F.lit(0.0), F.lit(1.0)), (F.lit(0.0), F.lit(0.0), F.lit(1.0)), "red")).first()[0].split("\n")
    assert line == ["draw color red", 'draw cylinder "0.0 0.0 10.0" "0.0 0.0 12.5" radius 0.2 resolution 12', 'draw cone "0.0 0.0 12.5" "0.0 0.0 13.5" radius 0.4 resolution 12']


def water(n, resname="TIP3"):
    out = []
    for k in range(n):
        for name, dx, dy in (("OW", 0.0, 0.0), ("HW1", 0.08, 0.06), ("HW2", 0.08, -0.06)):
            out.append((len(out), name, resname, k + 1, k, (8 if name == "OW" else 1), 0.3 + 0.6 * (k % 3) + dx, 0.3 + 0.6 * (k // 3) + dy, 0.3))
    return out


def test_commands(spark, tmp_path):
    atoms = spark.createDataFrame(water(6), "atom_idx long, name string, resname string, resid int, resindex long, atomic_number short, x double, y double, z double")
    coords = spark.range(4).select(F.col("id").alias("frame_idx")).crossJoin(atoms.select("atom_idx", "x", "y", "z")).withColumn("x", F.col("x") + 0.1 * F.col("frame_idx"))
    boxes = spark.range(4).select(F.col("id").alias("frame_idx"), (F.col("id") * 2.0).alias("time"), F.array(*[F.lit(float(v)) for v in (2.4, 0, 0, 0, 1.8, 0, 0, 0, 1.2)]).alias("box"))
    top = atoms.drop("x", "y", "z")
    one, traj = str(tmp_path / "a.gro"), str(tmp_path / "t.xtc")
    files.write(one, top, coords.where("frame_idx = 0"), boxes)
    files.write(traj, top, coords, boxes)
    names = lambda p: [(r.resname, r.name) for r in files.read(spark, p, "atoms").orderBy("atom_idx").collect()]
    x0 = lambda p: files.read(spark, p, "coords").where("atom_idx = 0").first().x
    for k, pair in enumerate(((one, traj), (traj, one))):
        out = str(tmp_path / f"last{k}.gro")
        assert command.run(spark, ["last", "-f", *pair, "-o", out]) == 1 and abs(x0(out) - 0.6) < 1e-3
    assert command.run(spark, ["last", "-f", one, "-o", str(tmp_path / "l.pdb")]) == 1
    with pytest.raises(ValueError, match="atoms"):
        command.run(spark, ["last", "-f", traj])
    out = str(tmp_path / "r.gro")
    assert command.run(spark, ["rearrange", "-f", one, "-o", out, "-b", "name HW2", "-e", "name OW"]) == 1
    assert [n for _, n in names(out)] == ["HW2"] * 6 + ["HW1"] * 6 + ["OW"] * 6 and files.read(spark, out, "frames").first().box[0] == 2.4
    out = str(tmp_path / "w.gro")
    assert command.run(spark, ["tip3to4", "-f", one, "-o", out]) == 1 and names(out)[:4] == [("TIP4", n) for n in ("OW", "HW1", "HW2", "M")]
    big, out = str(tmp_path / "s.gro"), str(tmp_path / "solved.gro")
    files.write(big, top.where("resindex = 0").withColumn("resname", F.lit("SOL")), coords.where("frame_idx = 0 and atom_idx < 3"), boxes.withColumn("box", F.array(*[F.lit(float(v)) for v in (0.6, 0, 0, 0, 0.6, 0, 0, 0, 0.6)])))
    assert command.run(spark, ["solvate", "-f", one, "-s", big, "-o", out]) == 1
    got = names(out)
    assert got[:18] == [("TIP3", n) for _ in range(6) for n in ("OW", "HW1", "HW2")] and 18 < len(got) <= 18 + 4 * 3 * 2 * 3 and len(got) % 3 == 0
