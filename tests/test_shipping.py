import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec); spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", entry.entry(spark).count())
"""


def test_queries_run_from_an_empty_folder():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    with tempfile.TemporaryDirectory(dir="/tmp") as folder:
        done = subprocess.run(
            [sys.executable, "-c", SCRIPT, ROOT], cwd=folder, env=env, capture_output=True, text=True, timeout=300
        )
    assert "ROWS 25" in done.stdout, done.stderr[-2000:]
