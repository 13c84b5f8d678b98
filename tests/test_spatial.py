import itertools

import numpy as np
import pytest

from atomweave.functions import geometry as g
from atomweave.operators import spatial

BOXES = {"orthogonal": [2.0, 0, 0, 0, 1.5, 0, 0, 0, 1.0], "skewed": [2.0, 0, 0, 0.5, 1.6, 0, -0.4, 0.3, 1.2], "tight": [0.6, 0, 0, 0, 2.0, 0, 0.1, 0, 1.0]}


def brute(p, cutoff, box=None, dims=(1, 1, 1)):
    images = np.zeros((1, 3))
    if box is not None:
        images = np.array(list(itertools.product(*[range(-8, 9) if d else (0,) for d in dims]))) @ np.array(box).reshape(3, 3)
    out = {}
    for i, j in itertools.combinations(range(len(p)), 2):
        d = np.sqrt((((p[i] - p[j]) + images) ** 2).sum(axis=1)).min()
        if d <= cutoff:
            out[i, j] = d
    return out


@pytest.mark.parametrize(("name", "dims"), [(None, (1, 1, 1)), ("orthogonal", (1, 1, 1)), ("orthogonal", (1, 0, 1)), ("skewed", (1, 1, 1)), ("tight", (1, 1, 1))])
def test_self_pairs(spark, name, dims):
    p = np.random.default_rng(3).uniform(-1.5, 2.5, (60, 3))
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "atom_idx long, x double, y double, z double")
    box = BOXES.get(name)
    got = {(r.i, r.j): r.dist for r in spatial.self_pairs(df, 0.45, box, dims).collect()}
    want = brute(p, 0.45, box, dims)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_two_sets_and_keys(spark):
    rng = np.random.default_rng(5)
    rows = [(f, i, *map(float, rng.uniform(0, 1, 3)), float(rng.uniform(0.05, 0.15))) for f in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "frame_idx int, atom_idx long, x double, y double, z double, vdw double")
    a, b = df.where("atom_idx < 20"), df.where("atom_idx >= 20")
    got = {(r.frame_idx, r.i, r.j) for r in spatial.pairs(a, b, 0.3, keys=["frame_idx"]).collect()}
    at = {(f, i): np.array(p) for f, i, *p, _ in rows}
    radius = {(f, i): v for f, i, *_, v in rows}
    every = [(f, i, j, np.linalg.norm(at[f, i] - at[f, j])) for f in range(3) for i in range(20) for j in range(20, 40)]
    assert got == {(f, i, j) for f, i, j, d in every if d <= 0.3}
    touching = {(r.frame_idx, r.i, r.j) for r in spatial.vdw_pairs(a, b, 0.3, keys=["frame_idx"]).collect()}
    assert touching == {(f, i, j) for f, i, j, d in every if d <= radius[f, i] + radius[f, j]}
    near = {(r.frame_idx, r.atom_idx) for r in spatial.within(a, b, 0.3, keys=["frame_idx"]).collect()}
    assert near == {(f, i) for f, i, _, d in every if d <= 0.3}


def test_minimum_image(spark):
    def dist(d, box):
        return spark.range(1).select(g.distance(g.vec(d), g.vec(0, 0, 0), box)).first()[0]

    skew = [6.0, 0, 0, 0, 6, 0, 3, 3, 6]
    m = np.array(skew).reshape(3, 3)
    want = min(np.linalg.norm(np.array((2.9, 2.9, 2.9)) + np.array(k) @ m) for k in itertools.product(range(-2, 3), repeat=3))
    assert abs(dist((2.9, 2.9, 2.9), skew) - want) < 1e-9
    assert dist((60.0, -120.0, 180.0), [10.0, 0, 0, 0, 20, 0, 0, 0, 30]) < 1e-9


def test_boxes(spark):
    m = g.from_lengths_angles(3, 4, 5, 75, 80, 95)
    got = spark.range(1).select(*[v.alias(k) for k, v in g.lengths_angles(g.box(m)).items()]).first()
    assert np.allclose(list(got), [3, 4, 5, 75, 80, 95])
    for bad in (lambda: g.from_lengths_angles(1, 1, 1, 50, 90, 90), lambda: g.check_box([0] * 9), lambda: g.check_box([1, 0, 0, 2, 0, 0, 0, 0, 1])):
        with pytest.raises(ValueError):
            bad()
    p = g.wrap(g.vec(-0.3, 5.2, -7.0), g.box(BOXES["skewed"]))
    inside = spark.range(1).select(g.is_inside(p, g.box(BOXES["skewed"]))).first()[0]
    assert inside


def test_within_adds_inner_atoms(spark):
    schema = "frame_idx int, atom_idx int, name string, x double, y double, z double"
    atoms = spark.createDataFrame([(0, 1, "a", 0.0, 0.0, 0.0), (0, 2, "b", 5.0, 0.0, 0.0), (1, 3, "c", 0.0, 0.0, 0.0)], schema)
    inner = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0), (0, 9, 0.1, 0.0, 0.0), (0, 9, 0.1, 0.0, 0.0)], "frame_idx int, atom_idx int, x double, y double, z double")
    got = spatial.within(atoms, inner, 0.3, keys=["frame_idx"], include_self=True)
    assert got.columns == atoms.columns and sorted((r.frame_idx, r.atom_idx, r.name) for r in got.collect()) == [(0, 1, "a"), (0, 9, None)]
    assert [r.atom_idx for r in spatial.within(atoms, inner, 0.3, keys=["frame_idx"]).collect()] == [1]


@pytest.mark.parametrize(("box", "dims"), [(None, (1, 1, 1)), ("orthogonal", (1, 1, 1)), ("orthogonal", (0, 1, 1)), ("skewed", (1, 1, 1))])
def test_points_on_a_lattice(spark, box, dims):
    """Neighbours exactly at the cutoff, points on cell borders and faces and some boxes away; ids that occur twice."""
    p = np.array([(0.1 * i, 0.1 * j, 0.1 * k) for i in range(4) for j in range(3) for k in range(3)] + [(2.0, 1.5, 1.0), (-4.0, 3.0, -2.0), (1.95, 1.45, 0.95), (-1e-18, 0.0, 0.0), (6.1, -3.0, 5.0)])
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "atom_idx long, x double, y double, z double")
    cutoff = 0.1 + 1e-12
    want = set(brute(p, cutoff, BOXES.get(box), dims))
    assert {(r.i, r.j) for r in spatial.self_pairs(df, cutoff, BOXES.get(box), dims).collect()} == want
    both = {(i, j) for i, j in want if i < 18 <= j}
    assert {(r.i, r.j) for r in spatial.pairs(df.where("atom_idx < 18"), df.where("atom_idx >= 18"), cutoff, BOXES.get(box), dims).collect()} == both
    assert {r.atom_idx for r in spatial.within(df.where("atom_idx < 18"), df.where("atom_idx >= 18"), cutoff, BOXES.get(box), dims).collect()} == {i for i, _ in both}
    twice = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 0.09, 0.0, 0.0), (2, 0.05, 0.0, 0.0)], df.schema)
    assert [(r.i, r.j) for r in spatial.self_pairs(twice, cutoff, BOXES.get(box), dims).collect()] == [(1, 2), (1, 2)]
