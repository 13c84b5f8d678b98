"""Queries over small made tables that don't divide evenly, against their SQL."""

import glob
import os

import duckdb
import numpy as np
import pytest

from atomweave.plans.structures import ORACLE_SQL, QUERIES


def same(spark, folder, name):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = QUERIES[name](spark, str(folder))
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    plain = lambda rows: sorted((tuple(0.0 if v == 0 else v for v in r) for r in rows), key=repr)
    got, want = plain(tuple(r[c] for c in names) for r in df.collect()), plain(found.fetchall())
    assert got == want and want


@pytest.fixture(scope="module")
def embeddings(tmp_path_factory):
    """23 vectors: frames of three and of two atoms."""
    folder = tmp_path_factory.mktemp("uneven")
    rng = np.random.default_rng(2)
    rows = ", ".join(f"({i}, [{', '.join(map(str, rng.normal(0, 0.125, 4)))}]::float[], {i % 10})" for i in range(23))
    duckdb.connect().execute(f"copy (select * from (values {rows}) t(vec_id, embedding, label)) to '{folder}/embeddings.parquet'")
    return folder


@pytest.mark.parametrize("name", ["file_dcd", "file_frames_seek", "file_nc", "file_frames_last"])
def test_trajectories_of_uneven_frames(spark, embeddings, name):
    same(spark, embeddings, name)


@pytest.mark.parametrize("name", ["dist_single_pbc_dims", "dist_single_triclinic", "dist_double_pbc", "dist_single_pbc"])
def test_cells_tell_the_image(spark, embeddings, name):
    plan = QUERIES[name](spark, str(embeddings))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "lambda" not in plan and "rint" not in plan  # no search for images pair by pair
    same(spark, embeddings, name)
