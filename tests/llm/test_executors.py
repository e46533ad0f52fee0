"""Task functions and broadcasts travel by value: workers that can't import this package still run."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"
PROGRAM = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
sys.path.insert(0, {REPO!r})  # the driver's path only
from tremorlake.llm import registry
for name in sys.argv[1:]:
    print(name, registry.QUERIES[name](spark, {SF!r}).count())
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_workers_without_the_package(tmp_path):
    names = ["op1_compression", "op4_language_model", "op8_license", "op9_toxicity", "op11_vector_codes", "op12_sharding", "op13_whitening"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", PROGRAM, *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert out.returncode == 0, out.stderr[-2000:]
    assert [line.split()[0] for line in out.stdout.splitlines() if line.startswith("op")] == names
