import os
import subprocess
import sys

from test_shipping import JOB, REPO


def test_workers_find_the_package(tmp_path, sf_dir):
    (tmp_path / "job.py").write_text(JOB)
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS")}
    run = subprocess.run([sys.executable, "job.py", REPO, sf_dir, "op1_spot_signatures"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0 and "op1_spot_signatures " in run.stdout, run.stderr[-3000:]
