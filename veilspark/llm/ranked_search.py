"""Ranked lexical search: the k best documents for each item, by Fagin's threshold algorithm.

One pass over the documents keeps the terms that a bitmap of the items' terms lets through (2**24 bits whatever their
number; a bit set by chance costs a posting, never a result). It gives a row for each slice of some 16 MB of text: the
slice's documents, their lengths, and their postings. Numbers of documents and terms are summed while that table is
written, document frequencies from it, so every score is by the whole corpus though slices are searched apart.

A slice has two orders of its postings: for each term its documents by descending impact (the part of a score that hangs
on term and document), and for each document its terms, the forward index. For an item the lists of its terms are read
round-robin, a few entries of each at a time; each new document is scored whole by lookups in the forward index. The sum
of the last impacts read, weighed, is the most that an unread document can score: the search of a slice stops when that
threshold falls strictly below the k-th best score (so ties are all seen) or all lists are at their end. Slices come in
groups, and the k-th best score carries on from slice to slice of a group.

Blocks of items meet groups of slices, both of fixed size: neither all items nor all documents are ever in one place, and
a group gives k rows an item at most.

Terms are runs of digits, letters a-z (A-Z are lower-cased) and characters beyond ASCII; they are compared by 64 bits of
hash. Null and empty texts have none; such documents do not count, and such items find nothing. An item is an item_id:
rows that share one, null included, are one item of all their terms, repeats counted. Rows that repeat a doc_id are
documents each, and may be found each. Ties go to the smaller doc_id, null first. Whole texts of any length count. Empty
tables give an empty one. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import counted, saved, slices, text_batches, text_bytes
from ._words import ALNUM, words

BITS = 1 << 24
_NONE = -(1 << 63)
_SLICE = "slice long, n_docs long, n_terms long, docs binary, lengths binary, terms binary, sizes binary, rows binary, counts binary"


def _asked(items: DataFrame) -> DataFrame:
    """item_id, term, q: how often each item holds each of its terms."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches):
        for b in slices(batches):
            w = words(*text_bytes(b.column("text")), ALNUM, True)
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(w.text_of())), pa.array(w.hash.view(np.int64))], names=["item_id", "term"])

    found = text_batches(items.select("item_id", "text")).mapInArrow(run, f"item_id {kind}, term long")
    return saved(found.groupBy("item_id", "term").agg(F.count("*").alias("q")), "asked")


def _bitmap(asked: DataFrame) -> np.ndarray:
    def run(frames):
        bits = np.zeros(BITS, bool)
        for f in frames:
            bits[f["term"].to_numpy().view(np.uint64) % np.uint64(BITS)] = True
        yield pd.DataFrame({"bits": [zstandard.ZstdCompressor(level=1).compress(np.packbits(bits).tobytes())]})

    out = np.zeros(BITS // 8, np.uint8)
    for r in asked.select("term").coalesce(32).mapInPandas(run, "bits binary").collect():  # at most 32 bitmaps
        out |= np.frombuffer(zstandard.ZstdDecompressor().decompress(r["bits"]), np.uint8)
    return out


def _packed(a: np.ndarray, kind: str) -> bytes:
    """Numbers as byte planes, of which the high ones are nearly empty."""
    planes = a.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(raw: bytes, kind: str) -> np.ndarray:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(data.T).view(kind).ravel()


def _index(docs: DataFrame, bitmap: np.ndarray, most: int) -> tuple[DataFrame, int, int]:
    """(the slices, number of documents with terms, number of terms)."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # 2 MB

    def run(batches):
        from pyspark import TaskContext

        bits = np.unpackbits(shared.value).view(bool)
        number, size, held, base = TaskContext.get().partitionId() << 32, 0, [], 0

        def row():
            doc, length = (np.concatenate([h[i] for h in held]) for i in range(2))
            term, at, tf = (np.concatenate([h[i] for h in held]) for i in range(2, 5))
            order = np.lexsort((at, term))
            term, at, tf = term[order], at[order], tf[order]
            new = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(new, len(term)))
            values = (number, int((length > 0).sum()), int(length.sum()), _packed(doc, "<i8"), _packed(length, "<i8"), _packed(term[new], "<u8"), _packed(sizes, "<u4"), _packed(np.diff(at, prepend=0), "<i4"), _packed(tf, "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=[c.split()[0] for c in _SLICE.split(", ")])

        for b in slices(batches):
            raw, offsets = text_bytes(b.column("text"))
            w = words(raw, offsets, ALNUM, True)
            keep = np.flatnonzero(bits[w.hash % np.uint64(BITS)])
            term, at = w.hash[keep], w.text_of()[keep]
            order = np.lexsort((term, at))
            term, at = term[order], at[order]
            new = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (at[1:] != at[:-1]))) if len(term) else np.zeros(0, np.int64)
            held.append((b.column("doc_id").to_numpy(), np.diff(w.first), term[new], base + at[new], np.diff(np.append(new, len(term)))))
            base, size = base + b.num_rows, size + len(raw)
            if size >= most:
                yield row()
                number, size, held, base = number + 1, 0, [], 0
        if held:
            yield row()

    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc_id"), "text")
    found, seen = counted(text_batches(texts).mapInArrow(run, _SLICE), "slices", n=F.sum("n_docs"), terms=F.sum("n_terms"))
    return found, seen["n"] or 0, seen["terms"] or 0


def _frequencies(index: DataFrame) -> DataFrame:
    """term, df."""

    def run(batches):
        for b in batches:
            for terms, sizes in zip(b.column("terms").to_pylist(), b.column("sizes").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(_unpacked(terms, "<u8").view(np.int64)), pa.array(_unpacked(sizes, "<u4").astype(np.int64))], names=["term", "df"])

    return index.select("terms", "sizes").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


@dataclass
class Slice:
    """A slice's postings by term and impact, and its forward index."""

    doc: np.ndarray  #: doc_id of each document
    term: np.ndarray  #: hashes of its terms, sorted
    first: np.ndarray  #: where the list of each term begins; one more at the end
    listed: np.ndarray  #: documents of the lists, each by descending impact
    impact: np.ndarray  #: and their impacts
    key: np.ndarray  #: forward index: document * terms + term, sorted
    value: np.ndarray  #: and the impact of each

    @classmethod
    def opened(cls, x, n_docs: int, n_terms: int, flat: int, slope: int) -> Slice:
        doc, length, term = _unpacked(x.docs, "<i8"), _unpacked(x.lengths, "<i8"), _unpacked(x.terms, "<u8")
        sizes, at = _unpacked(x.sizes, "<u4").astype(np.int64), np.cumsum(_unpacked(x.rows, "<i4").astype(np.int64))
        tf, of = _unpacked(x.counts, "<u4").astype(np.int64), np.repeat(np.arange(len(term)), sizes)
        m = 100 - slope + (slope * length * n_docs) // max(n_terms, 1)
        impact = (1_000_000_000 * tf) // (1000 * tf + flat * m[at])
        by = np.lexsort((at, -impact, of))
        key = at * max(len(term), 1) + of
        forward = np.argsort(key, kind="stable")
        return cls(doc, term, np.append(0, np.cumsum(sizes)), at[by], impact[by], key[forward], impact[forward])

    def scores(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores by lookups in the forward index."""
        wanted = docs[:, None] * len(self.term) + terms[None]
        found = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[found] == wanted, self.value[found], 0) @ weights

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray], step: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """The k best (doc_id, score) of `best` and this slice, for an item's terms (hashes) and weights."""
        at = np.searchsorted(self.term, terms)
        there = (at < len(self.term)) & (self.term[np.minimum(at, len(self.term) - 1)] == terms) if len(self.term) else np.zeros(len(terms), bool)
        at, weights = at[there], weights[there]
        begin, end = self.first[at], self.first[at + 1]
        seen, depth = np.zeros(len(self.doc), bool), 0
        while len(at) and (begin + depth < end).any():
            read = np.concatenate([self.listed[b:e] for b, e in zip((begin + depth).tolist(), np.minimum(begin + depth + step, end).tolist(), strict=True) if b < e])
            depth, step = depth + step, min(2 * step, 512)
            fresh = np.unique(read[~seen[read]])
            seen[fresh] = True
            scores = self.scores(fresh, at, weights)
            if len(best[1]) == k:
                fresh, scores = fresh[scores >= best[1][-1]], scores[scores >= best[1][-1]]
            if len(fresh):
                ids, all_scores = np.concatenate([best[0], self.doc[fresh]]), np.concatenate([best[1], scores])
                order = np.lexsort((ids, -all_scores))[:k]
                best = ids[order], all_scores[order]
            open_ = begin + depth < end
            threshold = int((weights * np.where(open_, self.impact[np.minimum(begin + depth, end) - 1], 0)).sum())
            if len(best[1]) == k and threshold < best[1][-1]:
                break
        return best


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, flat: int = 8, slope: int = 75, most: int = 16_000_000, per_group: int = 8, per_block: int = 256) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 of each item.

    A term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))) and adds w * ((10**9 tf) div (1000 tf + flat * m)) for each time
    the item holds it, where m = 100 - slope + (slope * n * N) div L. `most` bytes of text or a little more make a slice,
    per_group slices a group, about per_block items a block.
    """
    spark = docs.sparkSession
    asked = _asked(items)
    kind = items.schema["item_id"].dataType.simpleString()
    index, n_docs, n_terms = _index(docs, _bitmap(asked), most)
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weighed = asked.join(_frequencies(index).select("term", weight.alias("w")), "term").where("w > 0").select("item_id", "term", (F.col("q") * F.col("w")).alias("w"))
    n_items, n_slices = asked.select(F.approx_count_distinct("item_id")).first()[0], index.count()
    blocks, groups = max(1, n_items // per_block), max(1, n_slices // per_group)

    def packed(f):
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_pandas(f[["item_id", "term", "w"]], preserve_index=False)
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return pd.DataFrame({"block": [f["block"].iloc[0]], "held": [sink.getvalue().to_pybytes()]})

    dealt = weighed.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    asking = dealt.groupBy("block").applyInPandas(packed, "block long, held binary")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group")
    names = [c.split()[0] for c in _SLICE.split(", ")]
    mine = asking.select("block", every, "held", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in _SLICE.split(", ")))
    theirs = index.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("slice"), F.lit(groups)).alias("group"), F.lit(None).cast("binary").alias("held"), *names)

    def found(f):
        nothing = pd.DataFrame({"item_id": [], "doc_id": [], "score": []})
        held = f["held"].dropna()
        if not len(held):
            return nothing
        with pa.ipc.open_stream(held.iloc[0]) as opened:
            q = opened.read_all()
        ids = q.column("item_id").combine_chunks().dictionary_encode("encode")
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.combine_chunks()
        code, term, w = ids.indices.to_numpy(), q.column("term").to_numpy().view(np.uint64), q.column("w").to_numpy()
        order = np.argsort(code, kind="stable")
        cuts = np.searchsorted(code[order], np.arange(len(ids.dictionary) + 1))
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in cuts[1:]]
        for x in f[f["held"].isna()].itertuples(index=False):
            part = Slice.opened(x, n_docs, n_terms, flat, slope)
            for i in range(len(best)):
                mine_ = order[cuts[i] : cuts[i + 1]]
                best[i] = part.search(term[mine_], w[mine_], k, best[i])
        rows = [pd.DataFrame({"item_id": [item] * len(b[0]), "doc_id": b[0], "score": b[1]}) for item, b in zip(ids.dictionary.to_pylist(), best, strict=True) if len(b[0])]
        return pd.concat(rows) if rows else nothing

    every_best = mine.unionByName(theirs).groupBy("block", "group").applyInPandas(found, f"item_id {kind}, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    top = every_best.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= k)
    return top.select("item_id", "rank", F.when(F.col("doc_id") != _NONE, F.col("doc_id")).alias("doc_id"), "score")
