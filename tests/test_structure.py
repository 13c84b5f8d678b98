import os
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from atomweave.operators import membrane, perception, secondary
from atomweave.sources import binary, files, text
from atomweave.sources import frames as trajectories
from atomweave.sources.model import FormatError, Frame, Structure
from atomweave.streaming.task import FrameWindow, concatenate, last_frame, parse_suffix, seek_time

def frames(n=3, atoms=5):
    rng = np.random.default_rng(1)
    return [Frame(2.0 * k, [3.0, 0, 0, 0.5, 2.5, 0, 0.2, -0.3, 2.0], rng.uniform(-1, 1, (atoms, 3)), rng.uniform(-1, 1, (atoms, 3)), None) for k in range(n)]


@pytest.mark.parametrize(("write", "read", "tolerance"), [(binary.write_trr, binary.read_trr, 1e-6), (binary.write_xtc, binary.read_xtc, 1e-6), (binary.write_dcd, binary.read_dcd, 1e-5), (binary.write_netcdf, binary.read_netcdf, 1e-5)])
def test_binary_round_trip(write, read, tolerance):
    f = frames()
    got = read(write(f)).frames
    assert len(got) == 3
    for a, b in zip(f, got, strict=True):
        assert np.abs(a.xyz - b.xyz).max() < tolerance and np.abs(np.array(a.box) - b.box).max() < tolerance and abs(a.time - b.time) < 1e-6
    if read is binary.read_trr:
        assert np.abs(got[1].velocity - f[1].velocity).max() < 1e-6


def test_xtc_packed():
    rng = np.random.default_rng(5)
    for scale in (0.01, 3.0, 50.0, 30000.0):
        x = rng.uniform(-scale, scale, (300, 3))
        got = binary.read_xtc(binary.write_xtc([Frame(1.0, None, x), Frame(2.0, None, x[::-1])])).frames
        assert np.abs(got[0].xyz - x).max() <= 0.000501 and np.abs(got[1].xyz - x[::-1]).max() <= 0.000501 and got[1].time == 2.0


def test_xtc_runs():
    """A frame packed by hand: a run of two differences behind a whole triple, then a triple alone, then a run that goes on without being named."""
    sizes, small = (101, 101, 101), 15
    out: list[tuple[int, int]] = []

    def triple(values, sizes, width):
        value = (values[0] * sizes[1] + values[1]) * sizes[2] + values[2]
        for _ in range(width // 8):
            out.append((value & 255, 8))
            value >>= 8
        if width % 8:
            out.append((value, width % 8))

    joint, w = (101**3).bit_length(), binary._RANGES[small]
    triple((50, 50, 50), sizes, joint)
    out += [(1, 1), (7, 5)]  # run 6, range as before
    triple((w // 2 + 1, w // 2, w // 2 - 2), (w, w, w), small)
    triple((w // 2, w // 2 + 3, w // 2), (w, w, w), small)
    triple((10, 20, 30), sizes, joint)
    out += [(1, 1), (1, 5)]  # run 0
    triple((1, 2, 3), sizes, joint)
    out += [(1, 1), (4, 5)]  # run 3
    triple((w // 2, w // 2, w // 2 + 5), (w, w, w), small)
    for v in ((5, 5, 5), (6, 6, 6)):
        triple(v, sizes, joint)
        out.append((0, 1))
        triple((w // 2 - 1, w // 2, w // 2), (w, w, w), small)
    bits = "".join(f"{v:0{n}b}" for v, n in out)
    body = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    want = [(51, 50, 48), (50, 50, 50), (51, 53, 48), (10, 20, 30), (1, 2, 8), (1, 2, 3), (4, 5, 5), (5, 5, 5), (5, 6, 6), (6, 6, 6)]
    got = binary._unpacked(binary._Bits(body), 10, (0, 0, 0), (100, 100, 100), small)
    assert [tuple(map(int, r)) for r in got] == want


def test_damaged_files():
    for read, data in ((binary.read_dcd, b"junk" * 30), (binary.read_trr, b"junk" * 30), (binary.read_xtc, b"junk" * 30), (binary.read_netcdf, b"junk")):
        with pytest.raises((FormatError, ValueError)):
            read(data)
    with pytest.raises(FormatError):
        text.read_pdb("END\n")
    with pytest.raises(FormatError):
        text.read_gro("t\n3\n")


def molecule():
    s = Structure([{"name": n, "resname": "MOL", "resid": 7, "atomic_number": z, "chain": "A"} for n, z in (("C1", 6), ("C2", 6), ("H1", 1))], [(0, 1, 2), (1, 2, 1)], [Frame(0.0, [3.0, 0, 0, 0, 3, 0, 0, 0, 3], np.array([[0.1, 0.2, 0.3], [0.4, 0.5, 0.6], [-0.7, 0.8, 0.9]]))])
    return s.number_residues()


@pytest.mark.parametrize(("write", "read"), [(text.write_pdb, text.read_pdb), (text.write_gro, text.read_gro), (text.write_xyz, text.read_xyz), (text.write_sdf, lambda t: text.read_sdf(t)[0])])
def test_text_round_trip(write, read):
    s = molecule()
    got = read(write(s))
    assert np.abs(got.frames[0].xyz - s.frames[0].xyz).max() < 1e-3 and [a["atomic_number"] for a in got.atoms] == [6, 6, 1]
    if write is text.write_sdf:
        assert got.bonds == s.bonds


def test_pdb_details():
    t = "ATOM      1  CA  ALA A   5      10.000  20.000  30.000  1.00  2.00           C\nTER\nHETATM    3 SG   CYS B   6       1.000   2.000   3.000                       S\nCONECT    1    3\nEND\n"
    s = text.read_pdb(t)
    assert [a["atomic_number"] for a in s.atoms] == [6, 16] and s.bonds == [(0, 1, 0)] and np.allclose(s.frames[0].xyz[0], [1, 2, 3])


def test_files(spark, tmp_path):
    path = str(tmp_path / "m.gro")
    with open(path, "w") as f:
        f.write(text.write_gro(molecule()))
    atoms, coords, boxes = (files.read(spark, path, t) for t in ("atoms", "coords", "frames"))
    assert [r.name for r in atoms.orderBy("atom_idx").collect()] == ["C1", "C2", "H1"] and coords.count() == 3 and boxes.first().box[0] == 3
    for kind in ("pdb", "trr", "xtc", "dcd", "nc", "xyz"):
        out = str(tmp_path / f"out.{kind}")
        assert files.write(out, atoms, coords, boxes) == 1
        back = files.read(spark, out, "coords").orderBy("atom_idx").collect()
        assert np.allclose([r.x for r in back], [0.1, 0.4, -0.7], atol=1e-3)
    bad = tmp_path / "bad.pdb"
    bad.write_text("nothing")
    assert files.read(spark, str(bad), mode="PERMISSIVE").count() == 0
    with pytest.raises(Exception, match="no atoms"):
        files.read(spark, str(bad)).collect()
    ndx = tmp_path / "g.ndx"
    ndx.write_text("[ a ]\n1 2\n3\n[ empty ]\n[ a ]\n5\n")
    assert [(r.name, r.atom_idx) for r in files.read_groups(spark, str(ndx)).collect()] == [("a", 4)]


def test_itp():
    s = text.read_itp("[ moleculetype ]\nX 3\n[ atoms ]\n; comment\n1 CT 1 ALA CA 1 -0.25 12.0\n2 H 1 ALA HA 1 0.1 1.0\n[ bonds ]\n1 2\n")
    assert [(a["name"], a["charge"], a["mass"]) for a in s.atoms] == [("CA", -0.25, 12.0), ("HA", 0.1, 1.0)]


def chain(n):
    """Residues on a line, 1 nm apart, as the assembly of letters takes them."""
    p = lambda k, y: {"x": float(k), "y": y, "z": 0.0}
    return pd.DataFrame({"resindex": range(n), "valid": True, "n": [p(k, 0.0) for k in range(n)], "ca": [p(k, 0.1) for k in range(n)], "c": [p(k, 0.2) for k in range(n)], "o": [p(k, 0.3) for k in range(n)]})


def test_letters():
    helix = {(i + 4, i) for i in range(2, 8)}
    code = secondary.Assembly(chain(14), helix).run()
    assert set(code[3:11]) == {"H"} and set(code[:3]) <= {"~", "T"}
    code = secondary.Assembly(chain(12), {(i + 3, i) for i in (3, 4)}).run()
    assert code[4:7] == "GGG"
    pairs = {(2, 9), (9, 2), (4, 7), (7, 4)}
    code = secondary.Assembly(chain(13), pairs).run()
    assert code[2:5] == "EEE" and code[7:10] == "EEE"
    broken = chain(8)
    broken.loc[3, "valid"] = False
    assert secondary.Assembly(broken, set()).run() == "~~~=~~~~"


def test_assign(spark):
    """Through the plans: two residues whose N-H and C=O meet."""
    at = {0: ((0, 0, 0), (0.1, 0.1, 0), (0.25, 0.1, 0), (0.3, 0.2, 0))}
    rows = []
    for r in range(4):
        for k, (name, p) in enumerate(zip(("N", "CA", "C", "O"), at[0], strict=True)):
            rows.append((r * 4 + k, name, "ALA", r, 0.36 * r + p[0], float(p[1]), float(p[2])))
    df = spark.createDataFrame(rows, "atom_idx long, name string, resname string, resindex long, x double, y double, z double")
    res = secondary.backbones(df)
    h = res.where("resindex = 1").first().h
    co = np.array((0.25 - 0.3, 0.1 - 0.2, 0.0))
    assert np.allclose((h.x, h.y, h.z), np.array((0.36, 0, 0)) + 0.1 * co / np.linalg.norm(co)) and res.where("resindex = 0").first().h is None
    assert secondary.ss_string(secondary.assign(df)).first().ss == "~~~~"


def ring(n, orders, z=6):
    return perception.Molecule([z] * n, [(i, (i + 1) % n, o) for i, o in zip(range(n), orders, strict=True)])


def test_rings():
    assert ring(6, [1, 2] * 3).perceive()[1] == [True] and ring(6, [1] * 6).perceive()[1] == [False] and ring(6, [4] * 6).perceive()[1] == [True]
    pyrrole = perception.Molecule([7, 6, 6, 6, 6], [(0, 1, 1), (1, 2, 2), (2, 3, 1), (3, 4, 2), (4, 0, 1)])
    assert pyrrole.perceive()[1] == [True] and pyrrole.implicit_hydrogens([0] * 5) == [1, 1, 1, 1, 1]
    ketone = perception.Molecule([6] * 6 + [8], [(i, (i + 1) % 6, 1) for i in range(6)] + [(0, 6, 2)])
    assert ketone.perceive()[1] == [False]
    naphthalene = perception.Molecule([6] * 10, [(0, 1, 2), (1, 2, 1), (2, 3, 2), (3, 4, 1), (4, 5, 2), (5, 0, 1), (4, 6, 1), (6, 7, 2), (7, 8, 1), (8, 9, 2), (9, 5, 1)])
    assert sorted(map(len, naphthalene.rings())) == [6, 6] and naphthalene.perceive()[1] == [True, True]
    cubane = perception.Molecule([6] * 8, [(i, i ^ b, 1) for i in range(8) for b in (1, 2, 4) if i < i ^ b])
    assert [len(r) for r in cubane.rings()] == [4] * 5
    assert perception.Molecule([7, 6], [(0, 1, 1)]).implicit_hydrogens([1, 0]) == [3, 3]


def test_perception_tables(spark):
    atoms = spark.createDataFrame([("b", i, 6, 0) for i in range(6)] + [("e", i, z, 0) for i, z in enumerate((6, 8))], "mol_id string, atom_idx long, atomic_number int, formal_charge int")
    bonds = spark.createDataFrame([("b", i, i, (i + 1) % 6, 1 + i % 2) for i in range(6)] + [("e", 0, 0, 1, 1)], "mol_id string, bond_idx long, i1 long, i2 long, order int")
    r = perception.rings(atoms, bonds)
    assert [(x.mol_id, x.size, x.aromatic) for x in r.collect()] == [("b", 6, True)]
    seen = {(x.mol_id, x.atom_idx): x for x in perception.perceive(atoms, bonds).collect()}
    assert seen["b", 0].aromatic and seen["e", 0].implicit_h == 3 and seen["e", 1].implicit_h == 1
    assert {x.order for x in perception.aromatized(bonds, r).where("mol_id = 'b'").collect()} == {4}
    assert {x.degree for x in perception.degrees(atoms, bonds, ["mol_id"]).collect()} == {1, 2}


def test_membrane(spark):
    assert membrane.parse_tail("C1-C2=C3") == (["C1", "C2", "C3"], [1, 2])
    cell, edge = membrane.voronoi(np.array([[1, 0], [-1, 0], [0, 1], [0, -1], [3, 3.0]]))
    assert np.isclose(membrane.polygon_area(cell), 1) and sorted(edge) == [0, 1, 2, 3]
    p = np.random.default_rng(0).uniform(-0.5, 0.5, (40, 2))
    k = membrane.curvatures(membrane.fit_quadric(np.column_stack((p, 5 - np.sqrt(25 - (p**2).sum(axis=1))))))
    assert np.allclose(k, (0.2, 0.04, 0.2, 0.2), rtol=0.02)
    rows = []
    for a in range(6):
        for b in range(6):
            for name, z in (("P", 2.0), ("C1", 1.6), ("C2", 1.0)):
                rows.append((len(rows), name, "LIP", a * 6 + b, a * 6 + b, 0.8 * a, 0.8 * b, z, 1.0))
    atoms = spark.createDataFrame(rows, "atom_idx long, name string, resname string, resid int, resindex long, x double, y double, z double, mass double")
    config = membrane.read_config('cutoff = 1.3\n[lipids.LIP]\nwhole = "resname LIP"\nhead = "name P"\nmid = "name C1"\ntails = ["C1-C2"]\n')
    lipids, surface = membrane.analyse(atoms, config, [4.8, 0, 0, 0, 4.8, 0, 0, 0, 9])
    got = surface.collect()
    assert len(got) == 36 and all(r.valid and abs(r.area - 0.64) < 1e-6 and abs(r.mean_curvature) < 1e-9 for r in got)
    stats = membrane.group_stats(lipids, surface).first()
    assert stats.n == 36 and abs(stats.tilt_mean) < 1e-5


def test_windows(spark):
    assert parse_suffix("") == (None, None) and parse_suffix("42") == (42, None) and parse_suffix("5fr") == (5, None)
    assert parse_suffix("2ns") == (None, 2000.0) and parse_suffix("1.5ns") == (None, 1500.0) and parse_suffix("1us") == (None, 1e6)
    for bad in ("5km", "fr", "1.5"):
        with pytest.raises(ValueError):
            parse_suffix(bad)
    f = spark.range(10).selectExpr("id as frame_idx", "id * 10.0D as time")
    ids = lambda d: sorted(r.frame_idx for r in d.collect())
    assert ids(FrameWindow("2", "7").apply(f)) == [2, 3, 4, 5, 6] and ids(FrameWindow("20ps", "70ps", 2).apply(f)) == [2, 4, 6]
    assert ids(concatenate([f.where("frame_idx < 2"), f.where("frame_idx < 3")], f.where("frame_idx = 0"))) == [0, 1, 2, 3, 4, 5]


def test_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from atomweave.streaming.task import FrameTask, frame_stream

    class Centre(FrameTask):
        def per_frame(self, coords):
            return coords.groupBy("frame_idx").agg(F.avg("x").alias("x"))

    source = str(tmp_path / "in")
    spark.range(40).selectExpr("id div 4 as frame_idx", "cast(id div 4 as double) as time", "id % 4 as atom_idx", "cast(id as double) as x").write.parquet(source)
    seen = {}
    task = Centre(FrameWindow("2", "8"))
    task.stream(frame_stream(spark, source, spark.read.parquet(source).schema), lambda df, _: seen.update({r.frame_idx: r.x for r in df.collect()}), str(tmp_path / "check")).awaitTermination()
    assert sorted(seen) == [2, 3, 4, 5, 6, 7] and seen[2] == 9.5
    assert {r.frame_idx: r.x for r in task.run(spark.read.parquet(source)).collect()} == seen


def test_frames_by_range(spark, tmp_path):
    f = frames(150, 12)
    for kind, write in files.BINARY_WRITERS.items():
        path = str(tmp_path / f"t.{kind}")
        with open(path, "wb") as out:
            out.write(write(f))
        whole = files.parse(open(path, "rb").read(), kind)[0].frames
        rows = trajectories.read_frames(spark, path, ("frame_idx", "time", "atom_idx", "x", "vz", "fx"), task_bytes=2000).orderBy("frame_idx", "atom_idx").collect()
        assert len(rows) == 150 * 12 and all(r.fx is None for r in rows)
        assert [r.x for r in rows] == [v for w in whole for v in w.xyz[:, 0]] and [r.time for r in rows[::12]] == [w.time for w in whole]
        assert (rows[5].vz is not None) == (kind == "trr")
        boxes = trajectories.read_frames(spark, path, ("frame_idx", "box"), lambda i: FrameWindow("10", "16", 2).apply(i, ["path"])).orderBy("frame_idx").collect()
        assert [(r.frame_idx, r.box) for r in boxes] == [(k, whole[k].box) for k in (10, 12, 14)]
        assert trajectories.read_frames(spark, path, ("frame_idx",), last_frame).first().frame_idx == 149
        assert trajectories.read_frames(spark, path, ("frame_idx",), lambda i: seek_time(i, 7.0)).first().frame_idx == 4
        assert trajectories.read_frames(spark, path, ("frame_idx", "atom_idx"), F.col("frame_idx") > 148).count() == 12
        stats = trajectories.statistics(trajectories.frame_index(spark, path)).first()
        assert (stats.frames, round(stats.last_time, 3)) == (150, 298.0)
        with open(path, "r+b") as cut:
            cut.truncate(os.path.getsize(path) - 5)
        assert trajectories.frame_index(spark, path, "PERMISSIVE").count() == 149
        with pytest.raises(Exception, match="cut short"):
            trajectories.frame_index(spark, path).collect()
        with open(path, "wb") as out:
            out.write(b"junk" * 30)
        assert trajectories.read_frames(spark, path, mode="PERMISSIVE").count() == 0


def test_frames_with_fixed_atoms(spark, tmp_path):
    """A DCD whose later frames hold free atoms only."""
    record = lambda b: struct.pack("<i", len(bytes(b))) + bytes(b) + struct.pack("<i", len(bytes(b)))
    head = b"CORD" + struct.pack("<9i", 3, 4, 2, 0, 0, 0, 0, 0, 3) + struct.pack("<f", 0.5) + struct.pack("<10i", 0, 0, 0, 0, 0, 0, 0, 0, 0, 24)
    body = [record(head), record(bytes(84)), record(struct.pack("<i", 5)), record(struct.pack("<2i", 2, 4))]
    body += [record(np.arange(5, dtype="<f4") + k) for k in range(3)]
    body += [record(np.array([v, v + 1], "<f4")) for v in (10, 20, 30, 40, 50, 60)]
    (tmp_path / "t.dcd").write_bytes(b"".join(body))
    want = {(0, i): i for i in range(5)} | {(k, i): i for k in (1, 2) for i in (0, 2, 4)} | {(1, 1): 10, (1, 3): 11, (2, 1): 40, (2, 3): 41}
    got = trajectories.read_frames(spark, str(tmp_path), ("frame_idx", "time", "atom_idx", "x")).collect()
    assert {(r.frame_idx, r.atom_idx): round(r.x * 10, 5) for r in got} == want and {r.time for r in got} == {2.0, 3.0, 4.0}
    late = trajectories.read_frames(spark, str(tmp_path), ("frame_idx", "atom_idx", "x"), F.col("frame_idx") == 2).collect()
    assert {(r.frame_idx, r.atom_idx): round(r.x * 10, 5) for r in late} == {k: v for k, v in want.items() if k[0] == 2}


def test_streamed_writers(spark, tmp_path):
    """Heads that count frames are right, with and without boxes, and without frames."""
    for boxes in ((True, True), (True, False)):
        f = [Frame(2.0 * k, [3.0, 0, 0, 0, 2.5, 0, 0, 0, 2.0] if b else None, np.full((4, 3), k + 1.0)) for k, b in enumerate(boxes)]
        for write, read in ((binary.write_dcd, binary.read_dcd), (binary.write_netcdf, binary.read_netcdf)):
            got = read(write(f)).frames
            assert [len(g.xyz) for g in got] == [4, 4] and [g.time for g in got] == [0.0, 2.0]
            if all(boxes):
                assert all(np.allclose(g.box, f[0].box) for g in got)
    assert binary.read_dcd(binary.write_dcd([])).frames == [] and binary.read_netcdf(binary.write_netcdf([])).frames == []


@pytest.mark.parametrize("kind", ["dcd", "nc"])
def test_frames_that_lack_atoms(spark, tmp_path, kind):
    lacks = {0: {2}, 1: set(), 2: {0, 4}}
    rows = [(k, i, k + 0.1 * i, float("nan") if i == 1 else 1.0, 2.0) for k in lacks for i in range(5) if i not in lacks[k]]
    coords = spark.createDataFrame(rows, "frame_idx long, atom_idx long, x double, y double, z double")
    atoms = spark.createDataFrame([(i, "CA") for i in range(5)], "atom_idx long, name string")
    heads = spark.createDataFrame([(k, 2.0 * k, [3.0, 0.0, 0.0, 0.0, 3.0, 0.0, 0.0, 0.0, 3.0]) for k in lacks], "frame_idx long, time double, box array<double>")
    path = str(tmp_path / f"t.{kind}")
    assert files.write(path, atoms, coords, heads) == 3
    want = [(k, i, round(x, 4), np.isnan(y)) for k, i, x, y, _ in rows]
    plain = lambda df: sorted((r.frame_idx, r.atom_idx, round(r.x, 4), r.y is None or np.isnan(r.y)) for r in df.collect())
    assert plain(files.read(spark, path, "coords")) == want
    for chosen, kept in ((None, (0, 1, 2)), (last_frame, (2,)), (lambda i: seek_time(i, 1.0), (1,))):
        assert plain(trajectories.read_frames(spark, path, ("frame_idx", "atom_idx", "x", "y"), chosen)) == [r for r in want if r[0] in kept]
    with pytest.raises(FormatError):
        (binary.write_dcd if kind == "dcd" else binary.write_netcdf)([Frame(0.0, None, np.zeros((n, 3))) for n in (2, 3)])
    with pytest.raises(FormatError):
        files.write(path, atoms, coords.union(coords.limit(1)), heads)
