"""op2: hits of benchmark windows against a search for every window."""

import re
from hashlib import sha256

from veilspark.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def expected(rows, items, size):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        found -= {None}
        ids = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_hostile_rows(spark, rows, sf_dir):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = QUERIES["op2_decontamination"](spark, sf_dir).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    want = expected([r[:2] for r in rows], items, 10)
    assert sorted(map(tuple, found), key=str) == want and sum(r[5] for r in want) > 10


def test_empty_table(spark, empty_dir, sf_dir, tmp_path):
    assert QUERIES["op2_decontamination"](spark, empty_dir).collect() == []
    spark.read.parquet(f"{sf_dir}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{empty_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {(r["n_hit"], r["contaminated"]) for r in QUERIES["op2_decontamination"](spark, str(tmp_path)).collect()} == {(0, False)}
