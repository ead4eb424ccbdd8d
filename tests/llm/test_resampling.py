"""op12: buckets, weights, scores and the draw against plain Python."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from veilspark.llm.queries import QUERIES
from veilspark.llm.resampling import crc_over, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
NAMES = ("doc_id", "n_words", "n_features", "weight", "score", "rank")


def features(text, n, buckets):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def expected(rows, target, n=1, buckets=10_000, percent=10, least=20, seed="2024"):
    own = [features(t, n, buckets) for _, t in rows]
    s, t = Counter(b for _, f in own for b in f), Counter(b for x in target for b in features(x, n, buckets)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1.0) * all_s) / ((s[b] + 1.0) * all_t)))
    out = []
    for (d, _), (n_words, f) in zip(rows, own):
        h = int(sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([d, n_words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], -(1 << 63) if r[0] is None else r[0]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=str)


def test_hostile_rows(spark, rows, sf_dir):
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = QUERIES["op12_importance_resampling"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and [t for _, t in got.dtypes] == ["bigint"] * 5
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((d, f, w, s, r) for d, _, f, w, s, r in expected([r[:2] for r in rows], items)), key=str)


@pytest.mark.parametrize(("n", "chunk"), [(1, 40), (2, 64), (3, 1000), (3, 1)])
def test_chunks_of_any_length(spark, rows, n, chunk):
    """Features over the ends of chunks count once; a word longer than a chunk stays whole."""
    mine = [r for r in rows if len(r[1] or "") < 20_000] if chunk == 1 else rows
    docs = spark.createDataFrame([(*r[:2], 1, 2) for r in mine], "doc_id long, text string, weight int, rank int").repartition(3)
    target = ["Some words of a target", None, rows[4][1]]
    found = resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), n, 97, 50, 3, "other", chunk, per_range=40)
    assert sorted((tuple(r[k] for k in NAMES) for r in found.collect()), key=str) == expected([r[:2] for r in mine], target, n, 97, 50, 3, "other")


def test_crc_of_ranges():
    rng = np.random.default_rng(5)
    raw = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 4000, 500)
    end = start + rng.integers(0, 120, 500)
    assert crc_over(np.zeros(500, np.uint32), raw, start, end).tolist() == [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(start, end)]


def test_empty_tables(spark, empty_dir, sf_dir):
    assert QUERIES["op12_importance_resampling"](spark, empty_dir).collect() == []
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    got = resample(docs, spark.read.parquet(f"{empty_dir}/benchmark.parquet"), percent=100, least_words=0).collect()
    assert sorted(tuple(r[k] for k in NAMES) for r in got) == sorted(expected([(1, "a b c"), (2, None)], [], percent=100, least=0))
