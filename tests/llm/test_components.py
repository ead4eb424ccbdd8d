"""Components against union-find."""

import random

import pytest

from veilspark.llm.components import components


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(a, a + 1) for a in range(100, 160)] + [(500, n) for n in range(501, 560)] + [(7, 7)]
    edges += [tuple(rng.sample(range(1000, 1000 + 60 * (seed + 1)), 2)) for _ in range(80)]
    edges += [(-a, -b) for a, b in edges[:70]]
    rng.shuffle(edges)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = components(spark.createDataFrame(edges + edges[:20], "a long, b long").repartition(3)).collect()
    assert len(got) == len(root) and {r["node"]: r["root"] for r in got} == {x: find(x) for x in root}


def test_no_edges(spark):
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []
