"""Task-side Python (mapInPandas / applyInPandas) must not need this package on the executors."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})  # driver only: executors start elsewhere and do not get this path
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
import __spark_entry__ as e
q = e.queries()
for name in ["multi_output_poly2", "knn_classify", "spending_regression"]:
    assert q[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("ok")
"""


def test_task_code_runs_without_package_on_workers():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    res = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tempfile.gettempdir(), env=env,
                         capture_output=True, text=True, timeout=900)
    assert res.returncode == 0 and "ok" in res.stdout, res.stderr[-3000:]
