"""op6: components of links against all pairs."""

import random
import re

import numpy as np
import pytest

from veilspark.llm import jaccard
from veilspark.llm.queries import QUERIES

SPACE = re.compile(r"[^ \t-\r]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k):
    words = SPACE.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or frozenset([tuple(words)])


def components(rows, percent, k):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and min(len(a), len(sets[j])) * 100 >= max(len(a), len(sets[j])) * percent and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    key = lambda d: (d is not None, d or 0)
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, d), d, key=key)
    return sorted(((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


@pytest.mark.parametrize("percent,k", [(90, 3), (80, 5)])
def test_hostile_rows(spark, rows, sf_dir, percent, k):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = jaccard.jaccard_components(docs, percent, k) if k == 5 else QUERIES["op6_jaccard_join"](spark, sf_dir)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=str) == components([r[:2] for r in rows], percent, k)


def chains(rng):
    """Near copies that link only through others, and templates that share lists without being linked."""
    out = []
    for c in range(4):
        words = [f"c{c}w{rng.randrange(400)}" for _ in range(120)]
        for _ in range(70):
            words = list(words)
            words[rng.randrange(120)] = f"x{rng.randrange(50)}"
            out.append(" ".join(words))
    line = " ".join(f"license{i}" for i in range(60))
    out += [f"{line} " + " ".join(f"t{rng.randrange(12)}" for _ in range(14)) for _ in range(150)]
    rng.shuffle(out)
    return out


def test_chains_and_templates(spark):
    rows = list(enumerate(chains(random.Random(3))))
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 90, 3)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=str)
    assert got == components(rows, 90, 3) and len({c for *_, c in got}) > 20


def test_few_askers_a_round(spark, monkeypatch):
    """With parts of 2 members a list goes through all rounds."""
    monkeypatch.setattr(jaccard, "ROUNDS", (2, 8, None))
    rows = list(enumerate(chains(random.Random(5))))
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 90, 3)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=str) == components(rows, 90, 3)


def test_t_occurrence():
    rng = random.Random(2)
    for _ in range(200):
        lists = [np.array(sorted(rng.sample(range(40), rng.randrange(0, 30)))) for _ in range(rng.randrange(1, 25))]
        goal = [rng.randrange(3, 9) for _ in range(40)]
        count = [sum(c in x for x in lists) for c in range(40)]
        got = jaccard.t_occurrence(lists, min(goal), goal.__getitem__)
        assert sorted(got) == [(c, count[c]) for c in range(40) if count[c] >= goal[c]]


def test_empty_table(spark, empty_dir):
    assert QUERIES["op6_jaccard_join"](spark, empty_dir).collect() == []
