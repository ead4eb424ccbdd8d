"""Toxicity by multiple-instance learning: only documents have labels, sentences get scores.

A sentence's score is the logistic function of the summed weights of its words (each word counts as itself and by its
first letters, hashed); a document's is the noisy-or of its sentences', 1 - prod(1 - p). The weights come from document
labels alone, by gradient descent on the noisy-or's log-likelihood over a bounded sample of labelled rows; scoring is one
pass over whole texts, and names the sentences that gave rise to a high score.

A null or empty text has no sentence and gets the score of one empty sentence. Rows that repeat a doc_id are scored each, by
their own text; long texts are whole. An empty table gives an empty one. Other columns are kept as they are, but those
that bear the name of an added one are replaced. Without labels of both kinds all scores are near 0 or near 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import slices, text_batches, text_bytes, without
from ._sample import labelled_sample
from ._words import _BASES, _BYTES, ALNUM, LOWER, Words, _ranges, _sums, mix, words

PREFIXES = (4, 5, 6, 7)
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True


def features(raw: np.ndarray, w: Words, buckets: int) -> np.ndarray:
    """Buckets of each word: itself, then its first bytes."""
    sums = _sums(_BYTES[LOWER[raw]], _BASES[0])
    own = [w.hash, *(mix(_ranges(sums, w.start, np.minimum(w.end, w.start + n), _BASES[0])) + np.uint64(n) for n in PREFIXES)]
    return np.stack([(h & np.uint64(buckets - 1)).astype(np.int32) for h in own])


def sentences(raw: np.ndarray, offsets: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each sentence, first sentence of each text and the end): sentences end at . ! ? or a new line."""
    ends = np.concatenate([[0], np.cumsum(_END[raw])])[w.start] if len(w.start) else np.zeros(0, np.int64)
    new = np.ones(len(w.start), bool)
    new[1:] = ends[1:] != ends[:-1]
    new[w.first[:-1][w.first[:-1] < len(new)]] = True
    first = np.flatnonzero(new)
    return first, np.searchsorted(first, w.first)


@dataclass
class Toxicity:
    weights: np.ndarray
    bias: float

    def sentence_logits(self, raw, w: Words, first: np.ndarray) -> np.ndarray:
        if not len(first):
            return np.zeros(0)
        each = self.weights[features(raw, w, len(self.weights))].sum(0, dtype=np.float64)
        return np.add.reduceat(each, first) + self.bias


def fit(sample: list[tuple[str, int]], buckets: int = 1 << 18, rounds: int = 200, rate: float = 0.1, penalty: float = 1e-4, least_z: float = 4.0, start: float = -5.0) -> Toxicity:
    """Adam over the whole sample; log(1 - P) is minus the sum of softplus of the sentences' logits.

    Only buckets that lie in more toxic documents than chance explains (by least_z standard errors) get a weight: the
    rest would only be learnt by heart.
    """
    y = np.array([float(v > 0) for _, v in sample])
    weights, bias = np.zeros(buckets, np.float32), start
    if not len(y) or y.min() == y.max():
        return Toxicity(weights, start if not len(y) or y.max() == 0 else -start)
    n, n1 = len(y), y.sum()

    def parts():
        for begin in range(0, n, 250):  # the arrays over bytes are several times the texts
            raw, offsets = text_bytes(pa.array([t or "" for t, _ in sample[begin : begin + 250]], pa.large_string()))
            w = words(raw, offsets, ALNUM, True)
            first, at = sentences(raw, offsets, w)
            yield begin, w, first, at, features(raw, w, buckets)

    in_doc, in_toxic = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for begin, w, _, _, f in parts():
        of_doc = begin + w.text_of()
        for row in f:
            pairs = np.unique(of_doc * np.int64(buckets) + row)
            in_doc += np.bincount(pairs % buckets, minlength=buckets)
            in_toxic += np.bincount(pairs[y[pairs // buckets] > 0] % buckets, minlength=buckets)
    p = np.minimum(in_doc / n, 1.0)
    z = (in_toxic / n1 - (in_doc - in_toxic) / (n - n1)) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / (n - n1)))
    chosen = np.flatnonzero(z >= least_z)
    number = np.full(buckets, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    found, docs, n_sentences = [], [], 0
    for begin, w, first, at, f in parts():
        of_sentence = n_sentences + np.repeat(np.arange(len(first)), np.diff(np.append(first, len(w.start))))
        kind = number[f]
        has = kind >= 0
        found.append((np.broadcast_to(of_sentence, f.shape)[has].astype(np.int32), kind[has]))
        docs.append(begin + np.repeat(np.arange(len(at) - 1), np.diff(at)))
        n_sentences += len(first)
    sentence, kind = (np.concatenate(x) for x in zip(*found, strict=True))
    doc = np.concatenate(docs)
    v = np.append(np.zeros(len(chosen)), start)
    m, s = np.zeros(len(v)), np.zeros(len(v))
    for step in range(1, rounds + 1):
        logit = np.bincount(sentence, v[kind], n_sentences) + v[-1]
        a = np.bincount(doc, np.logaddexp(0, logit), n) + 1e-9
        slope = np.where(y > 0, -np.exp(-a) / -np.expm1(-a), 1.0) / n
        g = slope[doc] / (1 + np.exp(-np.clip(logit, -30, 30)))
        grad = np.append(np.bincount(kind, g[sentence], len(chosen)) + penalty * v[:-1], g.sum())
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    weights[chosen] = v[:-1]
    return Toxicity(weights, float(v[-1]))


def score(docs: DataFrame, model: Toxicity, sentence_threshold: float = 0.3) -> DataFrame:
    """docs with score and offending: the sentences of at least sentence_threshold, as (sentence, start, end, score) in characters."""
    docs = without(docs, ["score", "offending"])
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # of the fixed size `buckets`
    names = docs.columns
    offending = pa.list_(pa.struct([("sentence", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        model = shared.value
        for b in slices(batches):
            raw, offsets = text_bytes(b.column("text"))
            w = words(raw, offsets, ALNUM, True)
            first, at = sentences(raw, offsets, w)
            z = model.sentence_logits(raw, w, first)
            soft = np.concatenate([[0.0], np.cumsum(np.logaddexp(0, z))])
            a = soft[at[1:]] - soft[at[:-1]]
            a = np.where(at[1:] == at[:-1], np.logaddexp(0, model.bias), a)
            p = 1 / (1 + np.exp(-z))
            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            last = np.append(first[1:], len(w.start)) - 1
            found: list[list] = [[] for _ in range(b.num_rows)]
            for s in np.flatnonzero(p >= sentence_threshold):
                d = int(np.searchsorted(at, s, "right")) - 1
                found[d].append({"sentence": int(s - at[d]), "start": int(chars[w.start[first[s]]] - chars[offsets[d]]), "end": int(chars[w.end[last[s]]] - chars[offsets[d]]), "score": float(p[s])})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(-np.expm1(-a)), pa.array(found, offending)], names=[*names, "score", "offending"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return text_batches(docs).mapInArrow(run, schema + ", score double, offending array<struct<sentence:int,start:bigint,end:bigint,score:double>>")


def train(docs: DataFrame, labels: DataFrame, allowed: Column, sample: int = 5000, most_bytes: int = 16_384) -> Toxicity:
    """From labels.toxic of at most `sample` rows that `allowed` (over doc_id) lets in."""
    return fit(labelled_sample(docs, labels, "toxic", allowed, sample, most_bytes))


def toxicity(docs: DataFrame, labels: DataFrame, allowed: Column, threshold: float = 0.3) -> DataFrame:
    """docs with score, offending and predicted (1 if the score reaches the threshold)."""
    scored = score(docs, train(docs, labels, allowed))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
