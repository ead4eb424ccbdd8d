"""Token counts under a unigram model, by dynamic programming shared over a trie of pre-tokens.

A pre-token is a space and a run of bytes that are not white space. Its best segmentation is the one with the highest sum
of piece scores (ties: fewer pieces). The forward score of a prefix depends on the prefix only, so distinct pre-tokens
are inserted into a trie whose nodes hold the forward score and piece count of their prefix: a shared prefix is computed
once for as long as the worker lives, and the count at a pre-token's terminal is its token count. A document's count is
the sum over its pre-tokens. Each worker does this for the documents of its tasks, so nothing is shuffled.

The pieces and their scores are a parameter; every single byte must be a piece. zipf_scores() makes them from a public
vocabulary file, in which pieces stand by falling frequency. A null or empty text has no pre-tokens and 0 tokens; repeated
rows are counted each; texts of any length are whole; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import base64
import math
import uuid
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import slices, text_batches


def zipf_scores(path: str) -> dict[bytes, float]:
    """Piece to log-probability by Zipf's law, from a file of "base64 rank" lines."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {p: -math.log(r + 1) - total for p, r in ranks.items()}


class Trie:
    """Nodes are numbers; best and pieces are the forward score and piece count of a node's prefix. Over `most` nodes it starts anew."""

    def __init__(self, scores: dict[bytes, float], most: int = 1_000_000):
        self.scores, self.most, self.longest = scores, most, max(map(len, scores))
        self._clear()

    def _clear(self) -> None:
        self.edges: dict[int, int] = {}  # node * 256 + byte: child
        self.best, self.pieces, self.terminal = array("d", [0.0]), array("i", [0]), {}

    def _insert(self, word: bytes) -> int:
        node, path, edges, best, pieces = 0, [0], self.edges, self.best, self.pieces
        for end, byte in enumerate(word, 1):
            child = edges.get(node << 8 | byte)
            if child is None:
                top, n = -math.inf, 0
                for begin in range(max(0, end - self.longest), end):
                    s = self.scores.get(word[begin:end])
                    if s is not None:
                        s += best[path[begin]]
                        if s > top or s == top and pieces[path[begin]] + 1 < n:
                            top, n = s, pieces[path[begin]] + 1
                child = edges[node << 8 | byte] = len(best)
                best.append(top)
                pieces.append(n)
            node = child
            path.append(node)
        return node

    def insert(self, words: set[bytes]) -> dict[bytes, int]:
        """Terminal of each word."""
        if len(self.best) > self.most:
            self._clear()
        for w in words - self.terminal.keys():
            self.terminal[w] = self._insert(w)
        return self.terminal


_tries: dict[object, Trie] = {}


def token_counts(docs: DataFrame, scores: str | dict[bytes, float]) -> DataFrame:
    """doc_id, n_pre_tokens, n_tokens and log_prob of each document's best segmentation.

    scores: log-probability of each piece, or the path of a file for zipf_scores() that all executors have.
    """
    shared = None if isinstance(scores, str) else docs.sparkSession.sparkContext.broadcast(scores)  # of the vocabulary's size
    key = scores if shared is None else uuid.uuid4().hex

    def run(batches):
        if key not in _tries:
            _tries.clear()
            _tries[key] = Trie(zipf_scores(scores) if shared is None else shared.value)
        trie = _tries[key]
        for b in slices(batches, most=8_000_000):
            texts = [(" " + (t or "").translate(_SPACES)).encode().split(b" ") for t in b.column("text").to_pylist()]
            words = [[b" " + w for w in t if w] for t in texts]
            terminal = trie.insert({w for t in words for w in t})
            nodes = [[terminal[w] for w in t] for t in words]
            pieces, best = trie.pieces, trie.best
            counts = [len(t) for t in nodes], [sum(pieces[i] for i in t) for t in nodes], [math.fsum(best[i] for i in t) for t in nodes]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x) for x in counts)], names=["doc_id", "n_pre_tokens", "n_tokens", "log_prob"])

    return text_batches(docs).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_pre_tokens long, n_tokens long, log_prob double")


_SPACES = {c: " " for c in (9, 10, 11, 12, 13)}
