"""op11: removed bytes against a dictionary of all windows; the run-length index against sorted suffixes."""

import random
from hashlib import sha256

import numpy as np
import pytest

from veilspark.llm.queries import QUERIES
from veilspark.llm.run_index import RunIndex
from veilspark.llm.suffix_dedup import suffix_dedup


def expected(rows, window):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of each row."""
    key = lambda d: -(1 << 63) if d is None else d
    texts = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, t in texts:
        for i in range(len(t) - window + 1):
            p, at = hash(t[i : i + window]), (key(d), i)
            if at < first.get(p, (1 << 63, 0)):
                first[p] = at
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - window + 1):
            if first[hash(t[i : i + window])] != (key(d), i):
                gone[i] += 1
                gone[i + window] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((d, len(t), int(gone.sum()), spans, sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def whole(rows):
    return expected([r[:2] for r in rows], 100)


def test_hostile_rows(spark, sf_dir, whole):
    got = QUERIES["op11_suffix_dedup"](spark, sf_dir)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == whole and sum(r[2] for r in got) > 100_000 and sum(r[3] > 1 for r in got) > 5


def test_many_slices(spark, rows, whole, monkeypatch):
    from veilspark.llm import suffix_dedup as module

    plain = module.sliced
    monkeypatch.setattr(module, "sliced", lambda docs, name: plain(docs, name, 20_000))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in module.suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=str) == whole


@pytest.mark.parametrize(("window", "per_key", "bucket"), [(7, 4.0, 20_000), (30, 0.001, 16_000_000), (1, 4.0, 16_000_000)])
def test_other_windows(spark, rows, window, per_key, bucket):
    """Sketches that let all through lose nothing; other columns are kept, clashing ones replaced."""
    mine = [(*r[:2], "x", 7) for r in rows if len(r[1] or "") < 20_000]
    docs = spark.createDataFrame(mine, "doc_id long, text string, kept string, slice int").repartition(2)
    found = suffix_dedup(docs, window, per_key, bucket).collect()
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found), key=str)
    assert got == expected([r[:2] for r in mine], window)
    assert all(sha256(r["kept"]).hexdigest() == r["kept_sha256"] and r["slice"] == 7 for r in found)


def test_one_long_text(spark):
    """A text of more than a part: pieces of it meet as if it were whole."""
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(250))
    text = "".join("".join(rng.choice("abcdefghijklmnop ") for _ in range(90_000)) + passage for _ in range(60))
    rows = [(5, text), (3, text[1_000_050:1_000_300]), (4, None)]
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows, 100)


@pytest.mark.parametrize("narrow", [((1, 1),), ((1, 8),), ((3, 1), (1, 5)), ((4, 7),)])
def test_common_anchors_are_parted(spark, rows, narrow):
    """However snippets are parted, the same bytes go."""
    rng = random.Random(6)
    line = "a line of eighty characters or so that is common " + "x y z " * 6
    mine = [r[:2] for r in rows if len(r[1] or "") < 5_000] + [(50_000 + i, "".join(rng.choice("abcdef ") for _ in range(60)) + line + "".join(rng.choice("abcdef ") for _ in range(60))) for i in range(40)]
    got = suffix_dedup(spark.createDataFrame(mine, "doc_id long, text string"), narrow=narrow).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == expected(mine, 100)


def test_empty_table(spark, empty_dir):
    assert QUERIES["op11_suffix_dedup"](spark, empty_dir).collect() == []


@pytest.mark.parametrize("letters", [1, 2, 5, 300])
def test_run_index(letters):
    rng = random.Random(letters)
    for _ in range(60):
        codes = [rng.randrange(1, 1 + letters) for _ in range(rng.randrange(1, 150))]
        n, order = len(codes), sorted(range(len(codes)), key=lambda i: codes[i:])
        index = RunIndex(np.array(codes, np.int16))
        transform = [codes[i - 1] if i else 0 for i in order]
        assert np.repeat(index.characters, index.lengths).tolist() == transform
        length, other = index.matches(np.arange(n))
        for x, y in zip(order[1:], order):
            shared = next((k for k in range(n) if codes[x : x + k + 1] != codes[y : y + k + 1] or max(x, y) + k >= n), n)
            assert (length[x], other[x]) == (shared, y)


def test_runs_are_few_in_repetitive_texts():
    rng = random.Random(9)
    passage = [rng.randrange(2, 250) for _ in range(300)]
    index = RunIndex(np.array((passage + [1]) * 200, np.int16))
    assert len(index.lengths) < 2 * len(passage) and index.lengths.sum() == 301 * 200
