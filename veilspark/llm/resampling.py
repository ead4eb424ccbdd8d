"""Importance resampling: of documents those are drawn whose words look most like a target's.

Features are runs of 1 to n words, hashed into buckets by crc32. A bucket's gain is the logarithm of how much commoner it
is in the target than in the documents (add-one smoothing), a document's weight the sum of its features' gains, and the
draw is by Gumbel top-k: each score is the weight plus noise that hangs on doc_id alone, and the highest scores are drawn.

Long texts are skew, so a text of more than `chunk` bytes is split at word boundaries into chunks that are dealt to all
tasks. A chunk owns the words that begin in it and carries the n - 1 words after them, so that each feature is counted
once, by the chunk that owns its first word. Chunks' counts and weights are summed by document. Shorter texts are counted
where they are read. Counts of buckets are summed in each task first; they are one row a bucket at most, which
is all that reaches the driver and is broadcast.

Ranks come from a range-partitioned sort by score: no task orders more than its range.

Words are runs of digits, a-z (A-Z are lower-cased, nothing else) and characters beyond ASCII. Null and empty texts have
no features and weight 0, and are drawn only if least_words is 0. A null doc_id draws the noise of an empty one and sorts
first. Rows that repeat a doc_id are judged each; equal rows get equal scores and take ranks side by side. Ties go to the
smaller doc_id. An empty table gives an empty one; without target texts only rarity in the documents counts. Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import before, counted, saved, slices, text_batches, text_bytes
from ._words import ALNUM, LOWER, bounds

_ALL = (1 << 32) - 1
_CHUNK = "doc_id long, print long, number int, text string, own int"
_WEIGHED = "doc_id long, print long, number int, n_words long, n_features long, weight long"


def _table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (c & np.uint32(1)))
    return c


_TABLE = _table()


def crc_over(state: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray, most: int = 48) -> np.ndarray:
    """crc32 values `state`, each carried on over its own range of raw, all ranges a byte at a time."""
    length = end - start
    out = state.copy()
    for i in np.flatnonzero(length > most).tolist():
        out[i] = zlib.crc32(raw[start[i] : end[i]].tobytes(), int(state[i]))
    short = np.flatnonzero(length <= most)
    order = short[np.argsort(-length[short], kind="stable")]
    s, at, lengths = ~state[order], start[order], length[order]
    longer = len(order) - np.cumsum(np.bincount(lengths, minlength=most + 1)) if len(order) else np.zeros(1, np.int64)
    for j, m in enumerate(longer.tolist()):
        if not m:
            break
        s[:m] = _TABLE[(s[:m] ^ raw[at[:m] + j]) & np.uint32(255)] ^ (s[:m] >> np.uint32(8))
    out[order] = ~s
    return out


def _features(batch: pa.RecordBatch, n: int, buckets: int) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """(words each row owns, and for each length of runs: the buckets of its features and where each row's begin, one more at the end)."""
    raw, offsets = text_bytes(batch.column("text"))
    raw = LOWER[raw]
    start, end, first = bounds(raw, offsets, ALNUM)
    owned = np.diff(first)
    if "own" in batch.schema.names:
        owned = np.minimum(owned, batch.column("own").to_numpy())

    def runs():
        number = np.arange(len(start))
        last = np.repeat(first[1:], np.diff(first))
        until = np.repeat(first[:-1] + owned, np.diff(first))
        at = number[number < until]
        state = np.zeros(len(at), np.uint32)
        for k in range(n):
            if k:
                fits = at + k < last[at]
                at, state = at[fits], state[fits]
                state = crc_over(state, np.full(1, 32, np.uint8), np.zeros(len(at), np.int64), np.ones(len(at), np.int64))
            state = crc_over(state, raw, start[at + k], end[at + k])
            yield (state % np.uint32(buckets)).astype(np.int64), np.searchsorted(at, first)

    return owned, runs()


def _cut(n: int, chunk: int):
    """Texts as chunks of about `chunk` bytes."""

    def run(batches):
        for b in slices(batches, most=chunk):  # a text each
            for doc, mark, text in zip(b.column("doc_id").to_pylist(), b.column("print").to_pylist(), b.column("text").to_pylist(), strict=True):
                data = text.encode()
                raw = np.frombuffer(data, np.uint8)
                start, end, _ = bounds(raw, np.array([0, len(raw)]), ALNUM)
                cuts = np.unique(np.append(np.searchsorted(start, np.arange(0, len(raw), chunk)), len(start)))
                if len(cuts) < 2:
                    cuts = np.array([0, 0])  # no word at all: one chunk that says so
                for i, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    carry = min(z + n - 1, len(start))
                    piece = data[start[a] : end[carry - 1]].decode() if z > a else ""
                    yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([mark], pa.int64()), pa.array([i], pa.int32()), pa.array([piece], pa.string()), pa.array([z - a], pa.int32())], names=[c.split()[0] for c in _CHUNK.split(", ")])

    return run


def _parts(texts: DataFrame, n: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(texts of at most `chunk` bytes, chunks of the others, dealt to all tasks)."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    long = text_batches(texts.where(size > chunk)).select("doc_id", F.xxhash64("text").alias("print"), "text")
    return texts.where(size <= chunk), long.mapInArrow(_cut(n, chunk), _CHUNK).repartition("doc_id", "print", "number")


def bucket_counts(texts: DataFrame, n: int = 1, buckets: int = 10_000, chunk: int = 1 << 16) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in slices(batches):
            for bucket, _ in _features(b, n, buckets)[1]:
                total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    short, long = _parts(texts, n, chunk)
    found = text_batches(short).select("text").mapInArrow(run, "bucket int, n long").unionAll(long.select("text", "own").mapInArrow(run, "bucket int, n long"))
    out = np.zeros(buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share in the target over that in the source, rounded down."""
    s, t = int(source.sum()) + len(source), int(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log(((b + 1.0) * s) / ((a + 1.0) * t))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(texts: DataFrame, gain: np.ndarray, n: int = 1, chunk: int = 1 << 16) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row of texts(doc_id, text)."""
    shared = texts.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def run(batches):
        gain = shared.value
        for b in slices(batches):
            owned, runs = _features(b, n, len(gain))
            total, weight = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for bucket, cuts in runs:
                sums = np.append(0, np.cumsum(gain[bucket]))
                total += np.diff(cuts)
                weight += sums[cuts[1:]] - sums[cuts[:-1]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("print"), b.column("number"), pa.array(owned), pa.array(total), pa.array(weight)], names=[c.split()[0] for c in _WEIGHED.split(", ")])

    short, long = _parts(texts, n, chunk)
    none = F.lit(0)
    whole = text_batches(short).select("doc_id", none.cast("long").alias("print"), none.alias("number"), "text").mapInArrow(run, _WEIGHED)
    parts = long.mapInArrow(run, _WEIGHED).groupBy("doc_id", "print")
    # rows equal in doc_id and text have equal chunks: their sums are shared out again
    summed = parts.agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")), F.count_if(F.col("number") == 0).alias("rows"))
    shares = summed.select("doc_id", *(F.expr(f"{c} div rows").alias(c) for c in ("n_words", "n_features", "weight")), F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return whole.select("doc_id", "n_words", "n_features", "weight").unionAll(shares.select("doc_id", "n_words", "n_features", "weight"))


def noise(doc_id: Column, seed: str = "2024") -> Column:
    """Thousandths of a Gumbel number that hangs on seed and doc_id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / float(_ALL + 1))))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024", chunk: int = 1 << 16, per_range: int = 500_000) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of each document; those with a rank are drawn: `percent` of the documents of at least least_words words."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gain = gains(bucket_counts(texts, n, buckets, chunk), bucket_counts(target.select(F.lit(0).cast("long").alias("doc_id"), "text"), n, buckets, chunk))
    scored = weights(texts, gain, n, chunk).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    enough = F.col("n_words") >= least_words
    scored, seen = counted(scored, "scored", able=F.count_if(enough))
    able = seen["able"] or 0
    drawn = percent * able // 100
    ordered = scored.where(enough).repartitionByRange(1 + able // per_range, F.desc("score"), "doc_id").sortWithinPartitions(F.desc("score"), "doc_id")
    placed = saved(ordered.withColumn("place", F.monotonically_increasing_id()), "ordered").withColumn("range", F.shiftright("place", 33))
    sizes = placed.groupBy("range").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    base = before(sizes, [], "range", "n", "base").select("range", "base", "first")
    rank = F.col("base") + F.col("place") - F.col("first") + 1
    ranked = placed.join(base, "range").withColumn("rank", F.when(rank <= drawn, rank))
    names = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(names).unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")).select(names))
