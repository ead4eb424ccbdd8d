"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of documents. A window of `window` tokens is filled by visiting the queues in turn: each visit
adds the queue's share of a window to its deficit and serves that many tokens, in pieces of `least` tokens or more; what
a queue was owed and did not get is carried to the next window. The corpus is cut into partitions of about `per_task`
tokens, each with the same stretch of every queue's progress, so any number of tasks can pack at once: how far the
mixture has got in each queue at the start of a partition is known in closed form, and the fraction of a token that a
queue is owed there is the deficit it begins with.

Steps: encode once, keeping ids in a table; sums by (source, block of documents) give every document its place in its
queue without sorting a queue in one task; chunks of ids go to the partitions they belong to; one pass packs each.

Nulls: a null text has no tokens but the end id, a null source is a queue of its own, and a null doc_id is kept as null.
Rows that repeat a doc_id are packed each. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections import deque
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import before, saved, slices, text_batches
from ._tokens import encoder

PIECES = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_CHUNKS = "doc_id long, no_id boolean, source string, no_source boolean, row long, doc_tokens long, start long, length long, ids binary"
_PACKED = PIECES.replace("source string", "no_id boolean, source string, no_source boolean")
_PACKED_NAMES = [c.split()[0] for c in _PACKED.split(", ")]
_QUEUE = ["no_source", "source"]


def encoded(docs: DataFrame, path: str, end_id: int, spaces_matter: bool = True, chunk: int = 16_384, ordinary: bool = False) -> DataFrame:
    """A row for each `chunk` ids of a document, compressed: so that the longest document is many rows."""

    def run(batches):
        enc, squeeze = encoder(path, spaces_matter, ordinary), zstandard.ZstdCompressor(level=1)
        end, width = enc.dtype(end_id).tobytes(), np.dtype(enc.dtype).itemsize
        for b in slices(batches):
            out = []
            for i, ids in enumerate(enc.ids(t or "" for t in b.column("text").to_pylist())):
                ids += end
                for s in range(0, len(ids), width * chunk):
                    part = ids[s : s + width * chunk]
                    out.append((i, len(ids) // width, s // width, len(part) // width, squeeze.compress(part)))
            at, *numbers, parts = zip(*out, strict=True)
            kept = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(k) for k in ("doc_id", "no_id", "source", "no_source", "row")), *(pa.array(x, pa.int64()) for x in numbers), pa.array(parts, pa.binary())], names=["doc_id", "no_id", "source", "no_source", "row", "doc_tokens", "start", "length", "ids"])

    columns = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("source").isNull().alias("no_source"), F.monotonically_increasing_id().alias("row"), "text")
    return saved(text_batches(columns).mapInArrow(run, _CHUNKS), "encoded")


class Progress:
    """How many tokens of each queue are served when the whole mixture has served g.

    Each queue is served in proportion to its weight; when one is empty the rest share its part. Without weights every
    queue weighs what it holds, so all end together. Between two ends of queues progress is linear.
    """

    def __init__(self, totals: dict[str, int], weights: dict[str, float] | None = None):
        w = {s: Fraction((weights or {}).get(s, 0) if weights else n) for s, n in totals.items() if n}
        if weights and any(v <= 0 for v in w.values()):
            raise ValueError("each source needs a weight above 0")
        self.totals, self.total = totals, sum(totals.values())
        self.phases, at, done = [], 0, dict.fromkeys(w, 0)
        while w:
            x = min((totals[s] - done[s]) / w[s] for s in w)
            ends = {s: totals[s] if totals[s] - done[s] == w[s] * x else done[s] + math.floor(w[s] * x) for s in w}
            until = at + sum(ends[s] - done[s] for s in w)
            for s in w:
                self.phases.append((s, at, until, done[s], ends[s]))
            done |= ends
            at, w = until, {s: v for s, v in w.items() if ends[s] < totals[s]}
        self.of = {s: [p[1:] for p in self.phases if p[0] == s] for s in totals}

    def exact(self, source: str, g: int) -> Fraction:
        """With the fraction of a token that is owed at g."""
        for begin, end, base, top in self.of[source]:
            if g < end:
                return base + Fraction(max(0, g - begin) * (top - base), end - begin)
        return Fraction(self.totals[source])

    def served(self, source: str, g: int) -> int:
        for begin, end, base, top in self.of[source]:
            if g < end:
                return base + max(0, g - begin) * (top - base) // (end - begin)
        return self.totals[source]


def _queue_places(chunks: DataFrame, blocks: int) -> DataFrame:
    """place: tokens before each document in its queue; held: tokens of the queue. Documents lie in a queue by block (a hash of doc_id) and row."""
    docs = chunks.where("start = 0").select(*_QUEUE, "row", "doc_tokens", F.pmod(F.xxhash64("doc_id", "row"), F.lit(blocks)).alias("block"))
    sums = docs.groupBy(*_QUEUE, "block").agg(F.sum("doc_tokens").alias("n"))
    held = sums.groupBy(*_QUEUE).agg(F.sum("n").alias("held"))
    base = before(sums, _QUEUE, "block", "n", "base").join(held, _QUEUE).select(*_QUEUE, "block", "base", "held")
    inside = Window.partitionBy(*_QUEUE, "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    own = docs.withColumn("own", F.coalesce(F.sum("doc_tokens").over(inside), F.lit(0)))
    return own.join(base, [*_QUEUE, "block"]).select("row", (F.col("base") + F.col("own")).alias("place"), "held")


def _fill(queues: dict[str | None, deque], owed: dict[str | None, Fraction], first_id: int, window: int, least: int) -> list[tuple]:
    """Deficit round-robin over one partition. queues: [document, place in it, ids as little-endian 32-bit bytes] to serve; owed: deficits to begin with.

    (document, start, length, crc32, sequence, offset) of each piece; a piece is cut from a row of a queue, never over two.
    """
    held = {s: sum(len(x[2]) for x in q) // 4 for s, q in queues.items()}
    left = sum(held.values())
    quantum = {s: window * n / left for s, n in held.items() if n} if left else {}
    deficit = {s: float(owed[s]) for s in quantum}
    turn, sequence, filled, out = deque(sorted(quantum, key=lambda s: (s is not None, s or ""))), first_id, 0, []
    while left:
        s = turn[0]
        q = queues[s]
        deficit[s] += quantum[s]
        give = min(int(deficit[s]), held[s]) if len(turn) > 1 else held[s]
        while give >= min(least, held[s]) and give:
            row = q[0]
            doc, start, ids = row
            n = min(give, window - filled, len(ids) // 4)
            out.append((doc, start, n, zlib.crc32(ids[: 4 * n]), sequence, filled))
            if 4 * n == len(ids):
                q.popleft()
            else:
                row[1], row[2] = start + n, ids[4 * n :]
            filled, give, left = filled + n, give - n, left - n
            held[s] -= n
            deficit[s] -= n
            if filled == window:
                sequence, filled = sequence + 1, 0
                break
        else:  # served what it was owed: the next queue's turn. A queue that a full window cut short goes on in the next.
            turn.popleft()
            if held[s]:
                turn.append(s)
            continue
        deficit[s] -= quantum[s] if held[s] else 0  # it keeps its turn and has had its quantum
        if not held[s]:
            turn.popleft()
    return out


def pack(docs: DataFrame, path: str, end_id: int = 0, window: int = 1024, least: int = 128, per_task: int = 4_000_000, per_block: int = 100_000, weights: dict[str | None, float] | None = None, ordinary: bool = False) -> DataFrame:
    """Pieces of the documents' ids (each followed by end_id) in sequences of at most `window` tokens; columns PIECES.

    Every source is one queue, however many there are: without weights a queue's progress follows from what it holds, which
    its chunks carry. weights must name every source (None for null). sequence_id rises with the order of packing and has
    gaps between partitions. ordinary: strings of special tokens in a text are ordinary text.
    """
    chunks = encoded(docs, path, end_id, ordinary=ordinary)
    spark = docs.sparkSession
    sums = chunks.where("start = 0").groupBy(*_QUEUE).agg(F.sum("doc_tokens").alias("n"))
    count, total = sums.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not count:
        return spark.createDataFrame([], PIECES)
    mix = None
    if weights:
        rows = sums.limit(len(weights) + 1).collect()
        mix = Progress({None if r["no_source"] else r["source"]: r["n"] for r in rows}, weights)  # fails where a source has no weight
    size = max(1, per_task // window) * window
    tasks = max(1, math.ceil(total / size))
    stride = size // window + count + 2

    def bound(source: str | None, held: int, p: int) -> int:
        """Tokens of a queue before partition p."""
        if p >= tasks:
            return held
        return mix.served(source, p * size) if mix else p * size * held // total

    def owes(source: str | None, held: int, p: int) -> Fraction:
        return mix.exact(source, p * size) - mix.served(source, p * size) if mix else Fraction(p * size * held % total, total)

    taken = ["source", "no_source", "held", "doc_id", "no_id", "doc_tokens"]

    def deal(batches):
        """Each chunk to the partition, or partitions, that its place in the queue belongs to."""
        for b in batches:
            at, out = [], []
            columns = (b.column(k).to_pylist() for k in ("source", "no_source", "held", "place", "start", "length"))
            for i, (source, none, held, place, start, length) in enumerate(zip(*columns, strict=True)):
                source, end = None if none else source, place + length
                p = bisect_right(range(1, tasks), place, key=lambda k: bound(source, held, k))  # noqa: B023
                while p < tasks:
                    low, high = max(place, bound(source, held, p)), min(end, bound(source, held, p + 1))
                    if low < high:
                        at.append(i)
                        out.append((p, low, start + low - place, low - place, high - low))
                    if high >= end:
                        break
                    p += 1
            if not out:
                continue
            p, place, start, skip, length = (pa.array(x, pa.int64()) for x in zip(*out, strict=True))
            rows = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([p, place, start, skip, length, *(rows.column(k) for k in (*taken, "ids"))], names=["p", "place", "start", "skip", "length", *taken, "ids"])

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        p, queues, owed, unpack = table.column("p")[0].as_py(), {}, {}, zstandard.ZstdDecompressor()
        columns = (table.column(k).to_pylist() for k in ("source", "no_source", "held", "start", "skip", "length"))
        for i, (source, none, held, start, skip, length, ids) in enumerate(zip(*columns, table.column("ids"), strict=True)):
            source = None if none else source
            if source not in queues:
                queues[source], owed[source] = deque(), owes(source, held, p)
            raw = np.frombuffer(unpack.decompress(ids.as_buffer()), kind)[skip : skip + length].astype("<u4")
            queues[source].append([i, start, memoryview(raw.view(np.uint8))])
        doc, *rest = zip(*_fill(queues, owed, p * stride, window, least), strict=True)
        own = table.select(["doc_id", "no_id", "source", "no_source", "doc_tokens"]).take(pa.array(doc, pa.int64()))
        start, length, crc, sequence, offset = (pa.array(x, pa.int64()) for x in rest)
        own = dict(zip(own.column_names, own.columns, strict=True)) | {"start": start, "length": length, "ids_crc32": crc, "sequence_id": sequence, "offset": offset}
        return pa.table({c: own[c] for c in _PACKED_NAMES})

    kind = np.uint16 if _vocabulary(path) <= 1 << 16 else np.uint32
    blocks = max(1, total // per_block)
    placed = chunks.join(_queue_places(chunks, blocks), "row").select(*taken, "start", "length", "ids", (F.col("place") + F.col("start")).alias("place"))
    dealt = placed.mapInArrow(deal, "p long, place long, start long, skip long, length long, source string, no_source boolean, held long, doc_id long, no_id boolean, doc_tokens long, ids binary")
    packed = dealt.groupBy("p").applyInArrow(fill, _PACKED)
    named = packed.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).withColumn("source", F.when(~F.col("no_source"), F.col("source")))
    return named.drop("no_id", "no_source")


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
