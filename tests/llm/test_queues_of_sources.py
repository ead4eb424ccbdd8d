"""op1_packing and the pipeline's last stage: one queue a source at every size."""

import pytest

from veilspark.llm.packing import pack
from veilspark.llm.queries import _path


def _packed(spark, sources, **args):
    docs = spark.createDataFrame([(i, f"some words of document {i}", s) for i, s in enumerate(sources)], "doc_id long, text string, source string")
    return pack(docs, _path("byte_bpe_50k.json"), window=64, least=8, per_task=4096, **args).collect()


def test_more_than_4096_sources_keep_their_names(spark):
    sources = [f"site{i % 4200}" for i in range(4300)] + ["", None]
    pieces = _packed(spark, sources)
    tokens, need = {}, {}
    for r in pieces:
        assert r["source"] == sources[r["doc_id"]]
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
        need[r["doc_id"]] = r["doc_tokens"]
    assert tokens == need and len(need) == len(sources)
    fill = {}
    for r in pieces:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for of in fill.values():
        assert [o for o, _ in sorted(of)] == [sum(n for _, n in sorted(of)[:k]) for k in range(len(of))] and sum(n for _, n in of) <= 64


def test_null_and_empty_sources_are_two_queues(spark):
    sources = ["", None, "a"] * 20
    assert {r["source"] for r in _packed(spark, sources)} == {"", None, "a"}
    assert {r["source"] for r in _packed(spark, sources, weights={"": 1, None: 2, "a": 3})} == {"", None, "a"}
    with pytest.raises(ValueError):
        _packed(spark, sources, weights={"": 1, "a": 3})
