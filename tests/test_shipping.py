"""Tasks need nothing of the package on the executors."""

import os
import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, {repo!r})
from __spark_entry__ import queries
from tablescout.session import get_session
spark = get_session("elsewhere", "local[2]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false")
for name in ("vector_top_k", "vector_top_k_approx"):
    print("rows", name, queries()[name](spark, {data!r}).count())
"""


def test_queries_run_from_another_folder(tmp_path, sf_dir):
    repo = str(Path(__file__).parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = CODE.format(repo=repo, data=sf_dir)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows vector_top_k 50" in done.stdout and "rows vector_top_k_approx 50" in done.stdout, done.stderr[-2000:]
