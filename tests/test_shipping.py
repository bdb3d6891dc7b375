"""Queries with Python workers in a session of another folder, without the package on the workers' path."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
JOB = """
import importlib.util, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
for name in sys.argv[3:]:
    print(name, entry.queries()[name](spark, sys.argv[2]).count())
"""


def test_workers_find_the_package(tmp_path, sf_dir):
    (tmp_path / "job.py").write_text(JOB)
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS")}
    names = ["pca_compress", "procrustes_rotate"]
    run = subprocess.run([sys.executable, "job.py", REPO, sf_dir, *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-3000:]
    assert all(f"{n} " in run.stdout for n in names)
