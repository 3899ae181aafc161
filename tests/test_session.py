"""Behaviour of the checkpoint root when the session names no checkpoint folder."""

import os
import subprocess
import sys
import tempfile

SCRIPT = r"""
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
from staylens.plans.materialize import checkpoint_root, materialize
assert spark.conf.get("spark.checkpoint.dir", None) is None
root = checkpoint_root(spark)
df, m = materialize(spark.range(10), "t", {"n": __import__("pyspark.sql.functions", fromlist=["x"]).count("*")})
print("RESULT", root, m["n"], df.count())
"""


def test_local_session_without_checkpoint_dir_gets_a_private_root():
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, SPARK_CONF_DIR=tempfile.mkdtemp(prefix="staylens-noconf-"))
    out = subprocess.run([sys.executable, "-c", SCRIPT, repo], env=env, capture_output=True, text=True,
                         timeout=300)
    line = [x for x in out.stdout.splitlines() if x.startswith("RESULT")]
    assert line, out.stderr[-2000:]
    _, root, n, count = line[0].split()
    assert "staylens-ckpt-" in root and n == "10" and count == "10"
