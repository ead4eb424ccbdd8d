"""op3: counts of best segmentations against a search of each pre-token on its own."""

import math
import re

from veilspark.llm.queries import QUERIES, _path
from veilspark.llm.token_counts import Trie, token_counts, zipf_scores


def best(word, scores, longest):
    """(score, pieces): the highest score, with the fewest pieces."""
    to = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(to[b][0] + scores[word[b:end]], -to[b][1] - 1) for b in range(max(0, end - longest), end) if word[b:end] in scores]
        s, n = max(options)
        to.append((s, -n))
    return to[-1]


def expected(rows, scores):
    longest, known, out = max(map(len, scores)), {}, []
    for d, t, *_ in rows:
        words = [b" " + w.encode() for w in re.findall(r"[^ \t-\r]+", t or "")]
        for w in words:
            if w not in known:
                known[w] = best(w, scores, longest)
        out.append((d, len(words), sum(known[w][1] for w in words), math.fsum(known[w][0] for w in words)))
    return sorted(out, key=str)


def same(got, want):
    got = sorted(map(tuple, got), key=str)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(math.isclose(a[3], b[3], rel_tol=1e-12, abs_tol=1e-9) for a, b in zip(got, want))


def test_hostile_rows(spark, rows, sf_dir, empty_dir):
    scores = zipf_scores(_path("byte_bpe_50k.tiktoken"))
    same(QUERIES["op3_token_counts"](spark, sf_dir).collect(), expected(rows, scores))
    assert QUERIES["op3_token_counts"](spark, empty_dir).collect() == []


def test_scores_as_a_parameter(spark, rows):
    scores = {bytes([b]): -8.0 for b in range(256)} | {b" w": -3.0, b"ab": -9.0, b"word": -4.5, b" word": -5.0}
    docs = [r[:2] for r in rows if r[1] is None or len(r[1]) < 20_000]
    same(token_counts(spark.createDataFrame(docs, "doc_id long, text string"), scores).collect(), expected(docs, scores))


def test_a_small_trie_starts_anew():
    scores = {bytes([b]): -1.0 for b in range(256)} | {b"abc": -1.5}
    trie = Trie(scores, most=10)
    for words in ({b"abcabc", b"abcx"}, {b"q" * 20}, {b"abcabc"}):
        terminal = trie.insert(words)
        assert all(trie.pieces[terminal[w]] == best(w, scores, 3)[1] for w in words)
