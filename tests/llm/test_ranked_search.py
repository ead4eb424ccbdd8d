"""op13: ranks and scores against all scores in plain Python."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from veilspark.llm.queries import QUERIES
from veilspark.llm.ranked_search import Slice, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return Counter(t.translate(LOWER) for t in TERM.findall(text or ""))


def expected(docs, items, k):
    own = [(d, c) for d, t in docs if (c := terms(t))]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = defaultdict(Counter)
    for item, t in items:
        asked[item].update(terms(t))
    out = []
    for item, q in asked.items():
        found = []
        for d, c in own:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, n in q.items() if t in c)
            if score > 0:
                found.append((-score, -(1 << 63) if d is None else d, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(found, key=lambda x: x[:2])[:k])]
    return sorted(out, key=str)


def test_hostile_rows(spark, rows, sf_dir):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = QUERIES["op13_ranked_search"](spark, sf_dir)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == expected([r[:2] for r in rows], items, 10)


@pytest.mark.parametrize("most", [1, 30_000])
def test_small_slices_and_blocks(spark, rows, sf_dir, most):
    """Many slices, groups and blocks; items of names; k over the number of documents that match."""
    mine = [r[:2] for r in rows if len(r[1] or "") < 20_000]
    items = [(f"i{r['item_id']}" if r["item_id"] else None, r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = spark.createDataFrame([(*r, 1, "x") for r in mine], "doc_id long, text string, slice int, term string").repartition(3)
    got = ranked_search(docs, spark.createDataFrame(items, "item_id string, text string"), 30, most=most, per_group=3, per_block=7)
    assert sorted(map(tuple, got.collect()), key=str) == expected(mine, items, 30)


def test_the_threshold_stops_early():
    """One document has all the terms: after it no list is read to its end, yet ties are seen."""
    n, m = 5000, 4
    doc, term = np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
    impact = np.where(doc == 77, 900, np.where(doc == 4000, 900, 100))
    by = np.lexsort((doc, -impact, term))
    part = Slice(np.arange(n) * 3, np.arange(m).astype(np.uint64), np.arange(m + 1) * n, doc[by], impact[by], doc * m + term, impact)
    asked = []
    whole = part.scores
    part.scores = lambda d, t, w: asked.append(len(d)) or whole(d, t, w)
    ids, scores = part.search(np.arange(m).astype(np.uint64), np.ones(m, np.int64), 2, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert ids.tolist() == [231, 12_000] and scores.tolist() == [3600, 3600] and sum(asked) < 100


def test_empty_tables(spark, sf_dir, empty_dir):
    assert QUERIES["op13_ranked_search"](spark, empty_dir).collect() == []
    for docs, items in ((sf_dir, empty_dir), (empty_dir, sf_dir)):
        assert ranked_search(spark.read.parquet(f"{docs}/documents.parquet"), spark.read.parquet(f"{items}/benchmark.parquet")).collect() == []
