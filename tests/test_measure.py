import numpy as np
import pytest

from atomweave.operators import alignment, commands, measure, modify, sequence

RNG = np.random.default_rng(2)
P = RNG.uniform(-1, 1, (25, 3))
M = RNG.uniform(1, 3, 25)


@pytest.fixture(scope="module")
def atoms(spark):
    return spark.createDataFrame([(i, f"A{i % 4}", *map(float, p), float(m), 0.1) for i, (p, m) in enumerate(zip(P, M, strict=True))], "atom_idx long, name string, x double, y double, z double, mass double, vdw double")


def test_moments(atoms):
    c = (M[:, None] * P).sum(axis=0) / M.sum()
    assert np.allclose(list(measure.center(atoms, weighted=True).first()), c)
    d2 = ((P - c) ** 2).sum(axis=1)
    assert np.isclose(measure.gyration(atoms).first()[0], np.sqrt((M * d2).sum() / M.sum()))
    t = sum(m * (np.eye(3) * (r @ r) - np.outer(r, r)) for m, r in zip(M, P - c, strict=True))
    row = measure.inertia(atoms).first()
    assert np.allclose(row.moments, np.linalg.eigvalsh(t))
    axes = np.array(row.axes).reshape(3, 3)
    assert np.allclose(axes @ axes.T, np.eye(3)) and np.linalg.det(axes) > 0


def test_fit(atoms):
    moved = modify.translate(modify.rotate(atoms, (1, -2, 0.5), 77), (3, 4, -5))
    assert measure.rmsd(atoms, moved).first()[0] > 1
    fitted = modify.transform(atoms, measure.fit_transform(atoms, moved))
    assert measure.rmsd(fitted, moved).first()[0] < 1e-9
    about = modify.rotate(atoms, (0, 1, 0), 20)
    assert measure.rmsd(modify.transform(atoms, measure.fit_transform(atoms, about, centred=False)), about, weighted=True).first()[0] < 1e-9
    with pytest.raises(Exception, match="differ in size"):
        measure.rmsd(atoms, moved.where("atom_idx > 3")).collect()


def test_matching(atoms):
    moved = modify.translate(modify.rotate(atoms, (1, 1, 0.5), 30), (1, 0, 0)).where("atom_idx not in (4, 11, 12)")
    pairs = {(r.i, r.j) for r in alignment.matches(atoms, moved).collect()}
    assert all((i % 4) == (j % 4) for i, j in pairs) and len(pairs) >= 12
    assert alignment.align("ABCDE", "ABDE", open_=-1) == [(0, 0), (1, 1), (3, 2), (4, 3)]


def test_sasa(spark):
    one = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.16), (1, 5.0, 0.0, 0.0, 0.16), (2, 5.2, 0.0, 0.0, 0.16)], "atom_idx long, x double, y double, z double, vdw double")
    got = {r.atom_idx: r for r in measure.sasa(one).collect()}
    r = 0.3
    assert np.isclose(got[0].area, 4 * np.pi * r * r) and np.isclose(got[0].volume, 4 / 3 * np.pi * r**3, rtol=1e-6)
    cap = 2 * np.pi * r * (r - 0.1)
    assert abs(got[1].area - (4 * np.pi * r * r - cap)) < 0.02 * cap + 0.01


def test_tail_order(spark):
    rows = [(0, k, 0.1 * (k % 2), 0.0, 0.13 * k, 1, 0.0, 0.0, 1.0) for k in range(6)]
    df = spark.createDataFrame(rows, "tail int, carbon int, x double, y double, z double, bond_order int, nx double, ny double, nz double")
    sz = [r.order for r in measure.tail_order(df, ["tail"], kind="Sz").orderBy("carbon").collect()]
    assert len(sz) == 4 and np.allclose(sz, 1)
    scd = [r.order for r in measure.tail_order(df, ["tail"], kind="Scd").collect()]
    assert np.allclose(scd, 0.5)


def test_runs(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["a", "a", None, "a", "b", "a"])], "atom_idx long, v string")
    got = [(r.atom_idx, r.group_id) for r in sequence.split(df, "v").orderBy("atom_idx").collect()]
    assert got == [(0, 0), (1, 0), (3, 0), (4, 1), (5, 2)]
    lines = [r.line for r in sequence.ndx_text(df, "g", 4).orderBy("line_no").collect()]
    assert lines == ["[ g ]", "1 2 3 4", "5 6"]


def test_remove_and_append(spark, atoms):
    bonds = spark.createDataFrame([(0, 0, 1, 1), (1, 1, 2, 1), (2, 5, 6, 1)], "bond_idx long, i1 long, i2 long, order int")
    left, kept = modify.remove(atoms, atoms.where("atom_idx = 1"), bonds)
    assert left.count() == 24 and [(r.i1, r.i2) for r in kept.collect()] == [(4, 5)]
    both = modify.append(atoms.where("atom_idx > 99"), atoms)
    assert both.count() == 25 and both.agg({"atom_idx": "max"}).first()[0] == 24


def test_unwrap_connected(spark):
    df = spark.createDataFrame([(0, 0, 0.9, 0.0, 0.0), (0, 1, 0.05, 0.0, 0.0), (0, 2, 0.2, 0.0, 0.0), (0, 3, 0.55, 0.5, 0.5)], "group_id int, atom_idx long, x double, y double, z double")
    got = {r.atom_idx: r for r in modify.unwrap_connected(df, 0.2, [1.0, 0, 0, 0, 1, 0, 0, 0, 1]).collect()}
    assert np.allclose([got[i].x for i in range(4)], [0.9, 1.05, 1.2, 0.55]) and [got[i].component for i in range(4)] == [0, 0, 0, 3]


def test_commands(spark):
    water = spark.createDataFrame([(0, "OH2", "TIP3", 1, 0, "A", 0.0, 0.0, 0.0, 16.0), (1, "H1", "TIP3", 1, 0, "A", 0.1, 0.0, 0.0, 1.0), (2, "H2", "TIP3", 1, 0, "A", 0.0, 0.1, 0.0, 1.0)], "atom_idx long, name string, resname string, resid int, resindex long, chain string, x double, y double, z double, mass double")
    four = commands.tip3_to_tip4(water).orderBy("atom_idx").collect()
    assert [r.name for r in four] == ["OH2", "H1", "H2", "M"] and np.allclose((four[3].x, four[3].y), 0.01546 / 2**0.5)
    turned = commands.rearrange(water, begin=["name H2"], end=["name OH2"]).orderBy("atom_idx").collect()
    assert [r.name for r in turned] == ["H2", "H1", "OH2"]
    with pytest.raises(Exception, match="overlap"):
        commands.rearrange(water, begin=["name H2"], end=["name H2"]).collect()
    from pyspark.sql import functions as F

    w = water.withColumn("vdw", F.lit(0.15))
    filled = commands.solvate(w, [2.0, 0, 0, 0, 2, 0, 0, 0, 2], w, [0.5, 0, 0, 0, 0.5, 0, 0, 0, 0.5])
    assert filled.count() == 3 * 64
