"""op1: every id in one piece, sequences without gaps, mixtures close to their targets."""

import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from veilspark.llm.packing import Progress, pack
from veilspark.llm.queries import QUERIES, _path


def ids_of(rows):
    library = Tokenizer.from_file(_path("byte_bpe_50k.json"))
    return [[*library.encode(t or "", add_special_tokens=False).ids, 0] for _, t, *_ in rows]


def check(pieces, rows, window):
    """Pieces of each (doc_id, doc_tokens) cover the ids of as many documents; sequences are full but for few."""
    ids, of = ids_of(rows), defaultdict(list)
    for (d, *_), x in zip(rows, ids):
        of[d, len(x)].append(x)
    got = defaultdict(list)
    for r in pieces:
        got[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    assert set(got) == set(of)
    for key, docs in of.items():
        starts = sorted(got[key])
        assert sum(n for _, n, _ in starts) == len(docs) * key[1]
        for start, n, crc in starts:
            assert n > 0 and any(zlib.crc32(np.array(x[start : start + n], "<u4").tobytes()) == crc for x in docs)
        if len(docs) == 1:
            assert [s for s, _, _ in starts] == [sum(n for _, n, _ in starts[:k]) for k in range(len(starts))]
    sequences = defaultdict(list)
    for r in pieces:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for of_sequence in sequences.values():
        of_sequence.sort()
        assert [o for o, _ in of_sequence] == [sum(n for _, n in of_sequence[:k]) for k in range(len(of_sequence))]
        assert sum(n for _, n in of_sequence) <= window
    return len(sequences), sum(map(len, ids))


def test_hostile_rows(spark, rows, sf_dir):
    sequences, total = check(QUERIES["op1_packing"](spark, sf_dir).collect(), rows, 1024)
    assert sequences <= total / 1024 + 2


def test_many_partitions(spark, rows, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = pack(docs, _path("byte_bpe_50k.json"), window=256, least=32, per_task=10_000).collect()
    sequences, total = check(pieces, rows, 256)
    assert sequences <= total / 256 * 1.05 + 2


def test_windows_hold_the_mixture(spark):
    docs = [(i, "some plain words " * 40, "abc"[i % 3]) for i in range(300)]
    weights = {"a": 1, "b": 2, "c": 5}
    pieces = pack(spark.createDataFrame(docs, "doc_id long, text string, source string"), _path("byte_bpe_50k.json"), window=256, least=16, per_task=4096, weights=weights).collect()
    tokens = defaultdict(lambda: defaultdict(int))
    for r in pieces:
        tokens[r["sequence_id"]][r["source"]] += r["length"]
    order, done = sorted(tokens), defaultdict(int)
    for k in order[: len(order) // 3]:  # while all queues last
        for s, n in tokens[k].items():
            done[s] += n
        total = sum(done.values())
        assert all(abs(done[s] - total * w / 8) <= 256 for s, w in weights.items())


def test_progress():
    p = Progress({"a": 100, "b": 1000}, {"a": 1, "b": 1})
    assert [p.served(s, 100) for s in "ab"] == [50, 50] and [p.served(s, 1100) for s in "ab"] == [100, 1000]
    assert all(sum(p.served(s, g) for s in "ab") in (g, g - 1) for g in range(1101))


def test_special_strings_by_choice(spark):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b", "s")], "doc_id long, text string, source string")
    n = [pack(docs, _path("byte_bpe_50k.json"), ordinary=o).agg({"length": "sum"}).first()[0] for o in (False, True)]
    library = Tokenizer.from_file(_path("byte_bpe_50k.json"))
    assert n[0] == len(library.encode("a <|endoftext|> b").ids) + 1 < n[1]


def test_empty_table(spark, empty_dir):
    assert QUERIES["op1_packing"](spark, empty_dir).collect() == []
