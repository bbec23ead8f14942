"""Executor-side Python must work when the driver runs outside the repo
(the package is pickled by value, nothing is installed on workers)."""

import os
import subprocess
import sys
import tempfile

SCRIPT = r'''
import importlib.util
spec = importlib.util.spec_from_file_location("entry_mod", "{entry}")
m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
q = m.queries()
print("ROWS", q["iforest_score"](spark, "/root/testdata/sf0.001").count(),
      q["src_packets"](spark, "/root/testdata/sf0.001").count())
'''


def test_udfs_run_from_foreign_working_dir():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    cwd = tempfile.mkdtemp(prefix="flowlens-foreign-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(entry=os.path.join(root, "__spark_entry__.py"))],
                         cwd=cwd, env=env, capture_output=True, text=True, timeout=600)
    line = [ln for ln in out.stdout.splitlines() if ln.startswith("ROWS")]
    assert line, out.stderr[-2000:]
    assert line[0].split()[1] == "6000"


CKPT_SCRIPT = r'''
import sys
sys.path.insert(0, "{root}")
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", "{ckpt}").getOrCreate())
from flowlens.session import checkpoint_dir
from flowlens.operators.common import materialize
d = checkpoint_dir(spark)
t = materialize(spark.range(10), "probe")
print("CKPT", d, t.inputFiles()[0])
'''


def test_checkpoint_dir_is_read_from_the_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    ckpt = tempfile.mkdtemp(prefix="flowlens-shared-")
    out = subprocess.run([sys.executable, "-c", CKPT_SCRIPT.format(root=root, ckpt=ckpt)],
                         cwd=tempfile.mkdtemp(), capture_output=True, text=True, timeout=300)
    line = [ln for ln in out.stdout.splitlines() if ln.startswith("CKPT")]
    assert line, out.stderr[-2000:]
    _, used, first_file = line[0].split()
    assert ckpt in used and ckpt in first_file
