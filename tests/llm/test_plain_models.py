"""op5, op7 and op10 against plain Python: noisy-or by sentences, Viterbi word by word, sizes text by text."""

import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from veilspark.llm import language, quality, toxicity


def test_noisy_or(spark, rows, plain_toxicity):
    """Scores and offending sentences of a model of random weights."""
    rng = np.random.default_rng(4)
    model = toxicity.Toxicity(rng.normal(0, 0.7, 1 << 10).astype(np.float32), -2.0)
    mine = [r[:2] for r in rows if len(r[1] or "") < 20_000] + [(77, "One. Two! three?four\nfive; six"), (78, ". . ."), (79, "é.ü 汉")]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(mine)], "doc_id long, text string")
    for r in toxicity.score(docs, model, 0.2).collect():
        score, offending = plain_toxicity(model, r["text"], 0.2)
        assert r["score"] == pytest.approx(score, abs=1e-9)
        assert [(x["sentence"], r["text"][x["start"] : x["end"]]) for x in r["offending"]] == [(n, s) for n, s, _ in offending]
        assert [x["score"] for x in r["offending"]] == pytest.approx([p for *_, p in offending], abs=1e-9)


def viterbi(scores, switch):
    """The best path, word by word."""
    k = scores.shape[1]
    total, came = scores[0].copy(), []
    for row in scores[1:]:
        top = int(total.argmax())
        moved = total[top] - switch > total
        came.append([top if moved[j] else j for j in range(k)])
        total = np.where(moved, total[top] - switch, total) + row
    path = [int(total.argmax())]
    for step in reversed(came):
        path.append(step[path[-1]])
    return path[::-1]


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_best_paths(k):
    """Texts of none to 40,000 words, at and beside the length of a stretch; scores that favour one language for a while."""
    rng = np.random.default_rng(k)
    sizes = [0, 1, 2, 127, 128, 129, 0, 255, 256, 257, 384, 1000, 40_000, 3, 0]
    first = np.append(0, np.cumsum(sizes))
    for switch in (0.0, 0.5, 3.0, 12.0):
        scores = rng.normal(0, 1, (first[-1], k))
        scores[np.arange(first[-1]), np.arange(first[-1]) // 97 % k] += 0.4
        got = language.best_paths(scores, first, switch)
        for a, z in zip(first, first[1:]):
            assert z == a or got[a:z].tolist() == viterbi(scores[a:z], switch)


def test_compressed_sizes(spark, rows):
    """Each block of a text by a compressor of its own."""
    rng = random.Random(2)
    good, bad = ([" ".join(rng.choice(w) for _ in range(80)) for _ in range(60)] for w in (["calm", "river", "garden", "study"], ["buy", "now", "click", "$$$"]))
    model = quality.fit([(t, 1) for t in good] + [(t, 0) for t in bad], 4096)
    texts = [r[1] for r in rows if len(r[1] or "") < 50_000] + [good[-1], bad[-1], good[0] * 30]

    def size(raw, content):
        dictionary = zstandard.ZstdCompressionDict(content)
        blocks = [raw[i : i + quality.BLOCK] for i in range(0, len(raw), quality.BLOCK)]
        return sum(len(zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=False, write_dict_id=False).compress(b)) for b in blocks)

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.score(docs, model).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        g, b = size(raw, model.good), size(raw, model.bad)
        x = (b - g) / max(b + g, 1)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(model.slope * x + model.bias, -30, 30))), abs=1e-9)
    [[a], [z]] = (quality.score(spark.createDataFrame([(1, t)], "doc_id long, text string"), model).select(F.col("score")).collect() for t in (good[-1], bad[-1]))
    assert a[0] > 0.9 and z[0] < 0.1
