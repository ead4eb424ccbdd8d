"""op4: what is read back from the format is what the library encodes."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from veilspark.llm.queries import QUERIES, _path
from veilspark.llm.token_store import crc_joined, from_planes, read_documents, read_range, to_planes, write_store


def expected(rows):
    library, out, at = Tokenizer.from_file(_path("word_bpe_49k.json")), [], 0
    key = lambda r: (r[0] is not None, r[0] or 0)
    for d, t, *_ in sorted(rows, key=key):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, at, len(ids), ids))
        at += len(ids)
    return out


def test_hostile_rows(spark, rows, sf_dir):
    """Rows that share a doc_id come in any order; all others at their exact places."""
    got = QUERIES["op4_token_store"](spark, sf_dir).collect()
    want = expected(rows)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((d is not None, d or 0, n, crc(i)) for d, _, n, i in want)
    single = {d for d, *_ in want if d is not None and sum(x[0] == d for x in want) == 1}
    assert {(r["doc_id"], r["start"]) for r in got if r["doc_id"] in single} == {(d, at) for d, at, *_ in want if d in single}
    ends = sorted((r["start"], r["n_tokens"]) for r in got)
    assert [s for s, _ in ends] == [sum(n for _, n in ends[:k]) for k in range(len(ends))]


@pytest.mark.parametrize("bits", [False, True])
def test_small_blocks_and_ranges(spark, rows, bits):
    docs = [(i, t) for i, (_, t, *_) in enumerate(rows)]
    blocks, index = write_store(spark.createDataFrame(docs, "doc_id long, text string"), _path("word_bpe_49k.json"), 2, False, block=1000, bits=bits, per_shard=30_000)
    flat = [i for *_, ids in expected(docs) for i in ids]
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in read_documents(blocks, index).collect()}
    assert got == {d: (at, n, zlib.crc32(np.array(ids, "<u4").tobytes())) for d, at, n, ids in expected(docs)}
    for begin, end in ((0, 10), (995, 1005), (25_000, 64_321), (len(flat) - 3, len(flat) + 9)):
        found = sorted(map(tuple, read_range(blocks, index, begin, end).collect()))
        assert found == list(enumerate(flat))[begin:end]


def test_planes():
    rng = np.random.default_rng(1)
    for width in (2, 4):
        for n in (0, 1, 7, 8, 1000):
            ids = rng.integers(0, 1 << (8 * width - 1), n).astype(f"u{width}")
            for bits in (False, True):
                assert from_planes(to_planes(ids, bits), n, width, bits).tolist() == ids.tolist()


def test_crc_of_parts():
    a, b = b"some bytes", bytes(range(200))
    assert crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_empty_table(spark, empty_dir):
    assert QUERIES["op4_token_store"](spark, empty_dir).collect() == []
