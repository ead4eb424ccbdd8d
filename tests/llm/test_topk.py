"""op8: every query against all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import topk
from veilspark.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, score int, block int"


def expected(rows, is_query, k, scale=256.0):
    good = [(i, np.floor(np.array(v, np.float32).astype(float) * scale).astype(object)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in good:
        if is_query(i):
            scored = sorted((-int(sum(int(a) * int(b) for a, b in zip(v, w))), j) for j, w in good if j != i)
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def hostile(n, d, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(size=d) * rng.choice([0.1, 1, 5])]) for i in range(n)]
    rows += [(n + i, rows[i][1]) for i in range(0, 40)]  # ties
    rows += [(n + 100, None), (n + 101, [1.0, None] + [0.0] * (d - 2)), (n + 102, [float("nan")] * d), (n + 103, [float("inf")] + [0.0] * (d - 1)), (None, rows[0][1]), (n + 104, []), (n + 105, [0.0] * d), (n + 106, [1.0])]
    return rows


def run(spark, rows, folder):
    spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], SCHEMA).repartition(4).write.parquet(f"{folder}/embeddings.parquet")
    return sorted(tuple(r) for r in QUERIES["op8_top_k"](spark, folder).select("query_id", "rank", "vec_id", "score").collect())


def test_hostile_rows(spark, tmp_path):
    rows = hostile(900, 16, 1)
    assert run(spark, rows, str(tmp_path)) == expected(rows, lambda i: i % 50 == 0, 5)


@pytest.mark.parametrize("block,query_block", [(32, 8), (7, 100)])
def test_small_blocks_of_equal_lengths(spark, block, query_block):
    """Many blocks: thresholds come from the blocks before, and lengths alone rule nothing out."""
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(rng.normal(size=(600, 12)))]
    frame = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>")
    got = topk.top_k(frame, F.col("vec_id") % 7 == 0, k=3, scale=1024.0, block=block, query_block=query_block).collect()
    assert sorted(map(tuple, got)) == expected(rows, lambda i: i % 7 == 0, 3, 1024.0)


def test_few_and_no_rows(spark, tmp_path, empty_dir):
    rows = [(0, [1.0, 2.0]), (1, [3.0, -1.0]), (50, [0.5, 0.5])]
    assert run(spark, rows, str(tmp_path)) == expected(rows, lambda i: i % 50 == 0, 5)
    assert QUERIES["op8_top_k"](spark, empty_dir).collect() == []
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(one, F.col("vec_id") == 0).collect() == []
