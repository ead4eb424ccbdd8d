"""Seconds of the headline queries over the tables in $BENCH_SF_DIR, on local[$BENCH_CPUS]: one JSON line.

Each query is written to Spark's noop sink, so that every column of every row is computed; the first one runs once more
before, so that the JVM is warm.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from veilspark.plans.queries import QUERIES

HEADLINE = ("mask_text", "merged_spans", "detect_pages", "conversation_masking", "mask_restore_roundtrip", "file_risk_report", "classify_values", "known_dictionary", "column_vote_customer", "sensitive_upsert", "score_overlap", "greedy_match", "word_boxes", "page_boxes", "box_overlap", "stream_sessions")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    conf = {
        "spark.sql.shuffle.partitions": cpus, "spark.veilspark.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1",
        "spark.sql.session.timeZone": "UTC", "spark.local.dir": scratch, "spark.sql.warehouse.dir": f"{scratch}/warehouse", "spark.checkpoint.dir": f"{scratch}/checkpoints", "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.setCheckpointDir(f"{scratch}/checkpoints")
    seconds = {}
    for name in (HEADLINE[0], *HEADLINE):
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 2)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 2), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
