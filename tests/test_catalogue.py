import glob
import os

import duckdb
import pytest

import __spark_entry__
from atomweave.plans.structures import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(rows):
    return sorted((tuple(0.0 if v == 0 else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["sel_chain", "sel_within_open", "sel_com_of", "set_union", "split_runs", "dist_single", "dist_single_pbc", "dist_vdw", "com", "com_pbc", "inertia_tensor", "histogram", "replicate", "frames_begin_end_skip", "guess_elements", "sel_polh", "sel_within_self", "file_xtc", "file_dcd", "file_ndx", "file_frames_window", "file_frames_seek", "file_frames_last", "file_frames_ranges", "file_statistics", "system_sets", "frames_stream", "rearrange", "tip3_to_tip4", "hydrogen_bonds", "lipid_patches", "fit_matching"])
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert columns == sorted(names)
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
