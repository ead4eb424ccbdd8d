"""Exact top-k search by inner product.

Candidates are sorted by descending length and cut into blocks; queries are blocks of their own. The product of a query
with a candidate is at most the product of their lengths (Cauchy-Schwarz), so a query whose k-th best score is known to
be t at least needs only the blocks whose longest vector reaches t / |query|. t first comes from the block of the longest
candidates; how many blocks a query may need is read off a histogram of their lengths, of a fixed number of levels.
Inside a block vectors are rotated by the right singular vectors of all candidates, so that the first components hold
most of every product: partial sums over them, plus the product of the residual lengths, bound the score from above, and
only what may still reach t is scored exactly, in integers.

Tiles of query blocks meet spans of candidate blocks, a group each: no pair of vectors is ever a row, and a group's size
is fixed. A group takes its blocks by descending length and raises t from block to block, so that later ones are pruned
harder or left out whole.

Components become floor(scale * x). A vector that is null, or holds a null or non-finite component, or has no vec_id,
takes no part; shorter vectors count as padded with zeros. vec_id names a row: rows that share a query's vec_id are no
candidates of it. Ties go to the smaller vec_id. Absolute scores must stay below 2**53. An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import before, saved

FOUND = "query_id long, vec_id long, score long"
_BLOCK = "block long, n int, longest double, ids binary, vectors binary"


def vectors(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, v array<long>, square double: the vectors that take part."""
    e = F.col("embedding")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform(e, lambda x: F.floor(x.cast("double") * scale))
    kept = embeddings.where(F.col("vec_id").isNotNull() & e.isNotNull() & good).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return kept.withColumn("square", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))


def _rotation(v: DataFrame, d: int) -> np.ndarray:
    """Right singular vectors of all candidates as columns, the strongest first, from their d x d matrix of products."""

    def gram(frames):
        total = np.zeros((d, d))
        for f in frames:
            x = _matrix(f["v"], d).astype(float)
            total += x.T @ x
        yield pd.DataFrame({"cell": np.arange(d * d), "product": total.ravel()})

    cells = v.select("v").mapInPandas(gram, "cell int, product double").groupBy("cell").agg(F.sum("product").alias("product")).collect()  # d * d rows
    total = np.zeros(d * d)
    for r in cells:
        total[r["cell"]] = r["product"]
    return np.ascontiguousarray(np.linalg.eigh(total.reshape(d, d))[1][:, ::-1])


def _matrix(lists, d: int) -> np.ndarray:
    out = np.zeros((len(lists), d), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _blocks(v: DataFrame, d: int, size: int) -> DataFrame:
    """Blocks of at most `size` vectors; of a sorted partition, in its order. Numbers rise from partition to partition."""

    def run(frames):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for f in frames:
            for s in range(0, len(f), size):
                part = f.iloc[s : s + size]
                yield pd.DataFrame([(number, len(part), float(np.sqrt(part["square"].max())), part["vec_id"].to_numpy(np.int64).tobytes(), _matrix(part["v"], d).tobytes())], columns=[c.split()[0] for c in _BLOCK.split(", ")])
                number += 1

    return saved(v.mapInPandas(run, _BLOCK), "vectors")


def _level(longest):
    """Lengths by levels of a sixteenth of a power of two: at most some 850 for lengths below 2**53."""
    return F.floor(F.log2(F.greatest(longest, F.lit(1.0))) * 16).cast("long")


def _merged(ids: np.ndarray, scores: np.ndarray, more_ids: np.ndarray, more: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of both, ties to smaller ids."""
    ids, scores = np.concatenate([ids, more_ids]), np.concatenate([scores, more])
    at = np.lexsort((ids, -scores))[:k]
    return ids[at], scores[at]


def _searched(q_ids, q, t, blocks, rotation, cuts, k: int):
    """(query_id, vec_id, score) of the best k candidates in blocks (longest, ids, vectors), the longest first. t: what the k-th best score of each query is known to reach."""
    qr = q @ rotation
    length = np.sqrt((qr**2).sum(1))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q_ids]
    t = t.copy()
    for longest, ids, c in blocks:
        slack = 0.5 + 1e-9 * length * longest
        rows = np.flatnonzero(length * longest >= t - slack)
        if not len(rows):
            continue
        cr, sums, done = c @ rotation, np.zeros((len(rows), len(c))), 0
        floor = (t - slack)[rows, None]
        alive = (q_ids[rows, None] != ids[None]) & (length[rows, None] * np.sqrt((cr**2).sum(1))[None] >= floor)
        for cut in cuts:
            sums += qr[rows, done:cut] @ cr[:, done:cut].T
            rest = np.sqrt((qr[rows, cut:] ** 2).sum(1))[:, None] * np.sqrt((cr[:, cut:] ** 2).sum(1))[None]
            alive &= sums + rest >= floor
            done = cut
        for n, i in enumerate(rows.tolist()):
            at = np.flatnonzero(alive[n])
            if len(at):
                found[i] = _merged(*found[i], ids[at], c[at] @ q[i], k)
                if len(found[i][1]) == k:
                    t[i] = max(t[i], float(found[i][1][-1]))
    for query, (ids, scores) in zip(q_ids.tolist(), found, strict=True):
        yield from ((query, i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True))


def top_k(embeddings: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, block: int = 4096, query_block: int = 256, tile: int = 16, span: int = 8, steps: tuple[float, ...] = (0.25, 0.5)) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the highest products with each query; is_query is over vec_id.

    A group holds about `tile` blocks of queries and at most `span` blocks of candidates.
    """
    spark = embeddings.sparkSession
    v = saved(vectors(embeddings, scale), "v")
    n, d = v.agg(F.count("*"), F.max(F.size("v"))).first()
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n:
        return nothing
    d = max(1, d)
    rotation = _rotation(v, d)
    cuts = sorted({max(1, int(d * s)) for s in steps})
    parts = max(1, n // (4 * block))
    ordered = v.repartitionByRange(parts, F.desc("square"), "vec_id").sortWithinPartitions(F.desc("square"), "vec_id")
    candidates = _blocks(ordered, d, block)
    queries = _blocks(v.where(is_query).repartition(max(1, n // (200 * query_block)), "vec_id"), d, query_block)
    levels = candidates.groupBy(_level("longest").alias("level")).agg(F.count("*").alias("n"), F.min("block").alias("first")).collect()  # a row a level
    asking = queries.agg(F.count("*")).first()[0]
    if not asking:
        return nothing
    first = candidates.where(F.col("block") == min(r["first"] for r in levels)).first()  # one block
    first_ids, first_x = np.frombuffer(first["ids"], np.int64), np.frombuffer(first["vectors"], np.int64).reshape(-1, d)
    level = np.array(sorted((r["level"] for r in levels), reverse=True))
    upto = np.cumsum([r["n"] for r in sorted(levels, key=lambda r: -r["level"])])

    def seeded(frames):
        """For each query block the k-th best scores in the first block, and how many blocks it has to see."""
        for f in frames:
            rows = []
            for x in f.itertuples(index=False):
                ids, q = np.frombuffer(x.ids, np.int64), np.frombuffer(x.vectors, np.int64).reshape(-1, d)
                scores = q.astype(float) @ first_x.T.astype(float)
                scores[ids[:, None] == first_ids[None]] = -np.inf
                t = -np.partition(-scores, k - 1, axis=1)[:, k - 1] if len(first_ids) >= k else np.full(len(q), -np.inf)
                length = np.sqrt((q.astype(float) ** 2).sum(1))
                reach = float(np.where(t > 0, t / np.maximum(length, 1e-300), 0.0).min()) * (1 - 1e-9)
                least = int(np.floor(np.log2(max(reach, 1.0)) * 16)) - 1
                see = upto[level >= least]
                rows.append((x.ids, x.vectors, t.tobytes(), int(see[-1]) if len(see) else 1))
            yield pd.DataFrame(rows, columns=["ids", "vectors", "t", "see"])

    # the place of each block in the order of lengths: blocks of the ranges before it, and its own number in its range
    sizes = candidates.groupBy(F.shiftright("block", 32).alias("range")).agg(F.count("*").alias("n"))
    base = before(sizes, [], "range", "n", "base").select("range", "base")
    placed = candidates.withColumn("range", F.shiftright("block", 32)).join(base, "range").withColumn("place", F.col("base") + F.col("block").bitwiseAND((1 << 32) - 1))
    tiles = max(1, asking // tile)
    asked = saved(queries.select("ids", "vectors").mapInPandas(seeded, "ids binary, vectors binary, t binary, see long").withColumn("tile", F.pmod(F.xxhash64("ids"), F.lit(tiles))), "asked")
    tops = asked.groupBy("tile").agg(F.max("see").alias("top"))
    none = F.lit(None).cast("binary")
    mine = asked.select("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("see") - 1) / span))).alias("span"), F.lit(-1).cast("long").alias("place"), F.lit(0.0).alias("longest"), "ids", "vectors", "t")
    theirs = placed.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long")))).join(tops, "tile").where(F.col("place") < F.col("top"))
    theirs = theirs.select("tile", F.floor(F.col("place") / span).alias("span"), "place", "longest", "ids", "vectors", none.alias("t"))

    def group(f):
        q, blocks = f[f["place"] < 0], f[f["place"] >= 0].sort_values("place")
        if not len(q) or not len(blocks):
            return pd.DataFrame([], columns=["query_id", "vec_id", "score"]).astype("int64")
        q_ids = np.concatenate([np.frombuffer(x, np.int64) for x in q["ids"]])
        q_x = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, d) for x in q["vectors"]])
        t = np.concatenate([np.frombuffer(x) for x in q["t"]])
        each = ((longest, np.frombuffer(i, np.int64), np.frombuffer(x, np.int64).reshape(-1, d)) for longest, i, x in zip(blocks["longest"], blocks["ids"], blocks["vectors"], strict=True))
        return pd.DataFrame(_searched(q_ids, q_x, t, each, rotation, cuts, k), columns=["query_id", "vec_id", "score"]).astype("int64")

    found = mine.unionByName(theirs).groupBy("tile", "span").applyInPandas(group, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
