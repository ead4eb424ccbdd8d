"""A local session that sets no spark.checkpoint.dir, and no other defaults either."""

import os
import subprocess
import sys
from pathlib import Path

RUN = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.local.dir", sys.argv[1]).getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
from veilspark.llm._common import shared_dir
from veilspark.llm.queries import QUERIES
from veilspark.plans.queries import QUERIES as CORE
assert shared_dir(spark) == shared_dir(spark)
for name in ("op4_token_store", "op8_top_k", "op9_substring_dedup", "op12_importance_resampling"):
    print(name, QUERIES[name](spark, "/root/testdata/sf0.001").count())
print("tags", CORE["tag_dictionary"](spark, "/root/testdata/sf0.001").count() > 0)
"""


def test_queries_run_without_settings(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": f"{Path(__file__).parents[2]}:{os.environ.get('PYTHONPATH', '')}", "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", RUN, str(tmp_path)], env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.split() == ["op4_token_store", "200", "op8_top_k", "50", "op9_substring_dedup", "200", "op12_importance_resampling", "200", "tags", "True"]
