"""Times the headline queries and prints one JSON line. BENCH_SF_DIR: tables; BENCH_CPUS: cores."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = HERE + os.pathsep + os.environ.get("PYTHONPATH", "")

#: Fit, neighbourhood, extraction and cutoff workloads, selections, measures and frame windows.
HEADLINE = "sel_chain sel_within_open sel_same_residue sel_com_of dist_single dist_single_pbc dist_double_pbc dist_vdw within_pbc com cog bbox gyration inertia_tensor rmsd kabsch_fit histogram split_runs whole_residues unwrap_simple replicate frames_begin_end_skip frames_average".split()


def main() -> None:
    from pyspark.sql import SparkSession

    from atomweave.plans.catalogue import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="aw-bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["com"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
