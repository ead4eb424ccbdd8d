"""The pipeline: each stage against brute force over its own input, and run() as a whole."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_decontamination import expected as contaminated
from test_jaccard import components
from test_packing import check
from test_substring import SPACE
from veilspark.llm import stages
from veilspark.llm.stages import COLUMNS
from veilspark.llm.toxicity import train


def rows_of(df):
    return [tuple(r) for r in df.select(COLUMNS).collect()]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS).persist()


def test_stages_in_their_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "packing"]


def test_toxic_documents_go(spark, docs, sf_dir, plain_toxicity):
    """By the noisy-or of the learnt weights, in plain Python."""
    kept = rows_of(stages.drop_toxic(spark, docs, sf_dir))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, ~stages.held_out(F.col("doc_id"), 4, 2))
    want = [tuple(r) for r in docs.collect() if plain_toxicity(model, r["text"])[0] < 0.3]
    assert sorted(kept, key=str) == sorted(want, key=str) and 0.7 * docs.count() < len(kept) < docs.count()


def test_one_of_near_copies_stays(spark, docs, sf_dir):
    kept = rows_of(stages.drop_near_copies(spark, docs, sf_dir))
    rows = [tuple(r) for r in docs.collect()]
    heads = {d for d, _, c in components([r[:2] for r in rows], 80, 5) if d == c}
    assert sorted(kept, key=str) == sorted({r for r in rows if r[0] in heads}, key=str) and len(kept) < len(rows)


def test_repeats_are_cut(spark, docs, sf_dir):
    kept = rows_of(stages.cut_repeats(spark, docs, sf_dir))
    rows = [tuple(r) for r in docs.collect()]
    key = lambda d: -(1 << 63) if d is None else d
    first, words = {}, [SPACE.findall(r[1] or "") for r in rows]
    for r, w in zip(rows, words):
        for i in range(len(w) - 19):
            p = tuple(w[i : i + 20])
            first[p] = min(first.get(p, (key(r[0]), i)), (key(r[0]), i))
    want = []
    for r, w in zip(rows, words):
        gone = {j for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] != (key(r[0]), i) for j in range(i, i + 20)}
        left = [x for i, x in enumerate(w) if i not in gone]
        want.append((r[0], " ".join(left) if gone else r[1], *r[2:4], None if gone else r[4]))
    got = [(d, " ".join(SPACE.findall(t)) if n != len0 else t, lang, s, None if n != len0 else n) for (d, t, lang, s, n), len0 in ((r, len(r[1]) if r[1] is not None and (r[0], r[1]) in {x[:2] for x in rows} else r[4] if r[1] is None else -1) for r in kept)]
    assert sorted(((d, (t or "").strip()) for d, t, *_ in got), key=str) == sorted(((d, (t or "").strip()) for d, t, *_ in want), key=str)
    assert all(n == (None if t is None else len(t)) for _, t, _, _, n in kept)


def test_contaminated_documents_go(spark, docs, sf_dir):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = rows_of(stages.drop_contaminated(spark, docs, sf_dir))
    rows = [tuple(r) for r in docs.collect()]
    bad = {r[0] for r in contaminated([r[:2] for r in rows], items, 10) if r[5]}
    assert sorted(kept, key=str) == sorted((r for r in rows if r[0] not in bad), key=str) and len(kept) < len(rows)


def test_the_last_stage_packs_all(spark, docs, sf_dir):
    check(stages.pack_windows(spark, docs, sf_dir).collect(), [tuple(r) for r in docs.collect()], 1024)


def test_whole_run(spark, sf_dir, empty_dir):
    """The same as its stages one after another: every document that is left is packed whole."""
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    tokens = defaultdict(int)
    for r in pieces:
        tokens[r["doc_id"], r["start"]] += r["length"]
    left = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, sf_dir)
    ids = [r["doc_id"] for r in left.select("doc_id").collect()]
    assert {r["doc_id"] for r in pieces} == set(ids) and 100 < len(ids) < 230
    check(pieces, [tuple(r) for r in left.select(COLUMNS).collect()], 1024)
    assert corpus_pipeline.run(spark, empty_dir).collect() == []
