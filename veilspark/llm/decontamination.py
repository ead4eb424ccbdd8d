"""Benchmark decontamination: a prefix-filtered join of documents with the windows of benchmark items.

A window is `window` consecutive words of an item (the whole item if it has fewer). Its shingles are its runs of three
words (the whole window if it has fewer); a document that contains a window contains all of them, so it is enough to look
for one, the rarest in the documents: the necessary prefix of a containment join. Where it is found at the place that its
position in the window allows, inside the document, the document's shingles at all other places are compared too.

One pass over the documents keeps, of each, the number of words and its shingles that a bitmap of the benchmark's
shingles lets through: 2**24 bits whatever the benchmark's size. A bit set by chance costs a row, never a result. Document frequencies, the
join and the check work on that table, which is as small as the overlap with the benchmark.

Words are runs of digits, a-z (after lower-casing A-Z) and characters beyond ASCII. A null or empty text has none; an
item without words has no window, and items that share a text share its windows; a null item_id hits but is not listed.
Rows that repeat a doc_id are judged each, as whole texts of any length. An empty table of documents gives an empty one,
an empty benchmark no hits. Other columns are ignored.

Every shingle of a window is compared at its place, by 64 bits of hash of its words: two different windows of w words are
taken for one only if all w - 2 of their shingles collide (a single one, if w is 3 or less: a chance of about n m / 2**64
for n places and m short windows).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import saved, slices, text_batches, text_bytes
from ._words import ALNUM, run_hash, words

SHINGLE, BITS = 3, 1 << 24


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, len and the hashes of the shingles of each window, in order."""

    def run(batches):
        for b in slices(batches):
            raw, offsets = text_bytes(b.column("text"))
            w = words(raw, offsets, ALNUM, True)
            ids, lens, shingles = [], [], []
            for i, item in enumerate(b.column("item_id").to_pylist()):
                begin, end = int(w.first[i]), int(w.first[i + 1])
                n = min(window, end - begin)
                if not n:
                    continue
                k = min(SHINGLE, n)
                h = run_hash(w.hash, np.arange(begin, end - k + 1), k).view(np.int64)
                for s in range(end - begin - n + 1):
                    ids.append(item)
                    lens.append(n)
                    shingles.append(h[s : s + n - k + 1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(lens, pa.int32()), pa.array(shingles, pa.list_(pa.int64()))], names=["item_id", "len", "shingles"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    found = text_batches(items).mapInArrow(run, "item_id string, len int, shingles array<long>")
    return saved(found.withColumn("window", F.md5(F.concat_ws(",", F.col("len").cast("string"), F.col("shingles").cast("array<string>")))), "windows")


def _bitmaps(windows: DataFrame) -> dict[int, np.ndarray]:
    """For each length of shingle that occurs, one bit for each hash modulo BITS."""

    def run(frames):
        maps: dict[int, np.ndarray] = {}
        for f in frames:
            for n, h in zip(f["len"], f["shingles"], strict=True):
                maps.setdefault(min(SHINGLE, n), np.zeros(BITS, bool))[np.asarray(h).view(np.uint64) % np.uint64(BITS)] = True
        squeeze = zstandard.ZstdCompressor(level=1)
        for k, m in maps.items():
            yield pd.DataFrame({"k": [k], "bits": [squeeze.compress(np.packbits(m).tobytes())]})

    out: dict[int, np.ndarray] = {}
    for r in windows.select("len", "shingles").coalesce(32).mapInPandas(run, "k int, bits binary").collect():  # at most 3 * 32 bitmaps
        bits = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["bits"]), np.uint8)
        out[r["k"]] = out.get(r["k"], 0) | bits
    return {k: np.unpackbits(v).view(bool) for k, v in out.items()}


def _hits(docs: DataFrame, maps: dict[int, np.ndarray]) -> DataFrame:
    """A row for each document: doc_id, n_words, and the places and hashes of shingles that a bitmap lets through."""
    shared = docs.sparkSession.sparkContext.broadcast({k: np.packbits(v) for k, v in maps.items()})  # at most 3 * BITS bits

    def run(batches):
        maps = {k: np.unpackbits(v).view(bool) for k, v in shared.value.items()}
        for b in slices(batches):
            raw, offsets = text_bytes(b.column("text"))
            w = words(raw, offsets, ALNUM, True)
            text = w.text_of()
            found = []
            for k, bits in maps.items():
                at = w.places(k)
                h = run_hash(w.hash, at, k)
                keep = bits[h % np.uint64(BITS)]
                found.append((at[keep], h[keep]))
            at = np.concatenate([a for a, _ in found]) if found else np.zeros(0, np.int64)
            h = np.concatenate([h for _, h in found]).view(np.int64) if found else at
            order = np.lexsort((at,))
            at, h = at[order], h[order]
            cuts = pa.array(np.searchsorted(at, w.first), pa.int32())
            place = at - w.first[text[at]] if len(at) else at
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(w.first)), pa.ListArray.from_arrays(cuts, pa.array(place)), pa.ListArray.from_arrays(cuts, pa.array(h))],
                names=["doc_id", "n_words", "places", "shingles"],
            )

    found = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, places array<long>, shingles array<long>")
    return saved(found.withColumn("row", F.monotonically_increasing_id()), "hits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence of a window), n_items (items with one), items (their ids, sorted as strings)."""
    windows = _windows(benchmark, window)
    hits = _hits(docs, _bitmaps(windows))
    pair = F.explode(F.arrays_zip("places", "shingles")).alias("p")
    each = hits.select("row", "n_words", pair).select("row", "n_words", F.col("p.places").alias("place"), F.col("p.shingles").alias("shingle"))
    rarity = each.groupBy("shingle").agg(F.count("*").alias("df"))
    distinct = windows.dropDuplicates(["window"]).select("window", "len", "shingles")
    parts = distinct.select("window", F.posexplode("shingles").alias("offset", "shingle"))
    # a window of which a shingle is in no document can't occur; of the others the rarest shingle is the prefix
    prefix = parts.join(rarity, "shingle").groupBy("window").agg(F.count("*").alias("k"), F.min(F.struct("df", "shingle", "offset")).alias("rarest"))
    prefix = prefix.join(distinct, "window").where(F.col("k") == F.size("shingles")).select("window", "len", "shingles", F.col("rarest.shingle").alias("shingle"), F.col("rarest.offset").alias("offset"))
    start = F.col("place") - F.col("offset")
    candidates = each.join(prefix, "shingle").where((start >= 0) & (start + F.col("len") <= F.col("n_words"))).select("row", "window", "len", "shingles", start.alias("start")).distinct()
    needed = candidates.select("row", "window", "len", "start", F.size("shingles").alias("k"), F.posexplode("shingles").alias("offset", "shingle")).withColumn("place", F.col("start") + F.col("offset"))
    met = needed.join(each.select("row", "place", "shingle").distinct(), ["row", "place", "shingle"])
    found = saved(met.groupBy("row", "window", "len", "start", "k").agg(F.count("*").alias("n")).where(F.col("n") == F.col("k")).select("row", "window", "len", "start"), "found")
    end = F.col("start") + F.col("len")
    before = F.coalesce(F.max(end).over(Window.partitionBy("row").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = F.greatest(F.lit(0), end - F.greatest("start", before))
    spans = found.select("row", "start", "len").distinct().select("row", covered.alias("n")).groupBy("row").agg(F.sum("n").alias("n_hit"))
    items = found.select("row", "window").distinct().join(windows.select("window", "item_id").distinct(), "window").groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    whole = hits.select("row", "doc_id", "n_words").join(spans, "row", "left").join(items, "row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return whole.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items")
