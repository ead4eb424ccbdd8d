"""Sums over earlier places, by groups of places."""

import random

from veilspark.llm._common import before


def test_before(spark):
    rng = random.Random(1)
    rows = [(k, at, rng.randrange(100)) for k in "ab" for at in rng.sample(range(200), 90)]
    got = before(spark.createDataFrame(rows, "k string, at int, n int"), ["k"], "at", "n", "base", width=4).collect()
    assert sorted((r["k"], r["at"], r["base"]) for r in got) == sorted((k, a, sum(n for q, b, n in rows if q == k and b < a)) for k, a, _ in rows)
    got = before(spark.createDataFrame([(a, 1) for a in range(50)], "at int, n int"), [], "at", "n", "base", width=3).collect()
    assert sorted((r["at"], r["base"]) for r in got) == [(a, a) for a in range(50)]
