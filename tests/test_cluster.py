"""Queries on executors that are processes of their own."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pyspark

ROOT = Path(__file__).resolve().parent.parent

RUN = """
import json, sys
from orrery.queries import load
from orrery.session import session
spark = session("local-cluster[2,1,1024]", "cluster", **{"spark.executor.memory": "900m", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": sys.argv[2]})
found, _ = load()
print("ROWS", json.dumps({q: sorted(map(list, found[q](spark, sys.argv[1]).collect())) for q in sys.argv[3:]}))
"""


def rows(sf_dir, tmp_path, *names):
    env = os.environ | {"PYTHONPATH": str(ROOT), "SPARK_HOME": str(Path(pyspark.__file__).parent)}
    done = subprocess.run([sys.executable, "-c", RUN, sf_dir, f"file://{tmp_path}/shared", *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    lines = [x for x in done.stdout.splitlines() if x.startswith("ROWS ")]
    assert lines, done.stderr[-2000:]
    return json.loads(lines[0][5:])


def test_foreign_tables_are_read_by_executors(spark, sf_dir, tmp_path):
    found = rows(sf_dir, tmp_path, "foreign_scan", "foreign_join", "foreign_parallel")
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("nation", "region"))
    assert found["foreign_scan"] == sorted([n.n_nationkey, n.n_name] for n in nation if n.n_regionkey == 1 and n.n_nationkey > 3)
    assert found["foreign_join"] == sorted([r.r_name, sum(n.n_regionkey == r.r_regionkey for n in nation)] for r in region)
    assert found["foreign_parallel"] == sorted([n.n_nationkey] for n in nation)
