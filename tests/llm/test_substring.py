"""op9: removed words against a dictionary of all windows."""

import re
from hashlib import sha256

import pytest

from veilspark.llm.queries import QUERIES
from veilspark.llm.substring_dedup import substring_dedup

SPACE = re.compile(r"[^ \t-\r]+")


def expected(rows, window):
    """(doc_id, n_words, n_removed, sha256) of each row."""
    key = lambda d: -(1 << 63) if d is None else d
    words = [SPACE.findall(t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - window + 1):
            p, at = tuple(w[i : i + window]), (key(d), i)
            first[p] = min(first.get(p, at), at)
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (key(d), i):
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_hostile_rows(spark, rows, sf_dir):
    got = [tuple(r) for r in QUERIES["op9_substring_dedup"](spark, sf_dir).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == expected([r[:2] for r in rows], 20)


@pytest.mark.parametrize("per_key", [4.0, 0.001])
def test_small_sketches_lose_nothing(spark, rows, sf_dir, per_key):
    """Other columns are kept, clashing ones replaced; kept_text holds the kept words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = substring_dedup(docs, 5, per_key).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found), key=str)
    assert got == expected([r[:2] for r in rows], 5) and sum(n for _, _, n, _ in got) > 1000
    for r in found:
        kept = SPACE.findall(r["kept_text"] or "")
        assert len(kept) == r["n_words"] - r["n_removed"] and sha256(" ".join(kept).encode()).hexdigest() == r["kept_sha256"]
        assert r["score"] == "9" and (r["n_removed"] or r["kept_text"] == r["text"])


def test_many_slices(spark, rows, monkeypatch):
    """Slices of a few texts: repeats are found between them."""
    from veilspark.llm import substring_dedup as module

    plain = module.sliced
    monkeypatch.setattr(module, "sliced", lambda docs, name: plain(docs, name, 20_000))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in module.substring_dedup(docs, 20).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == expected([r[:2] for r in rows], 20)


def test_empty_table(spark, empty_dir):
    assert QUERIES["op9_substring_dedup"](spark, empty_dir).collect() == []
