"""Scratch and checkpoint paths come from the cluster's spark.checkpoint.dir when set."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {shared!r}).getOrCreate())
from tillroll.session import checkpoint_dir
from tillroll.sources.io import scratch_path
assert checkpoint_dir(spark) == {shared!r}, checkpoint_dir(spark)
assert scratch_path(spark, "x").startswith({shared!r} + "/tillroll/x-")
print("ok")
spark.stop()
"""


def test_configured_checkpoint_dir_is_used():
    shared = tempfile.mkdtemp(prefix="tillroll-shared-")
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, shared=shared)],
                         capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("ok"), out.stderr[-2000:]
