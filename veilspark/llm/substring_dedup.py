"""Substring deduplication: every word in a window of words that occurred before is removed.

Pass 1 counts each window (a hash of its words) in a spread count-min sketch (_sketch): the partial sketches of slices of
the documents are merged by block, and each slice learns which of its windows may occur twice. Pass 2 sends those alone,
the first of each in its slice only (the rest of that slice are known repeats at once, so a passage that a third of all
documents hold is sent once a slice); they are grouped exactly, by 96 bits of hash, and all but the earliest
(doc_id, start) are repeats. Repeats go back to their slice, where a last pass cuts the words they cover. The sketch only
ever overestimates, so it loses no repeat; its cells grow with the words, so it filters alike at every size.

Words are runs of anything but ASCII white space. Null and empty texts have none. A null doc_id sorts before all others.
Rows that share a doc_id and a start are one place: a repeated row does not repeat itself. An empty table gives an empty
one. Texts of any length are whole: one of more than a slice's bytes is a slice of its own. Two hashes of windows of
different words agree with a chance of about n**2 / 2**97 for n windows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import saved, slices, text_bytes, without
from ._sketch import Sketch, opened, sliced
from ._words import NOT_SPACE, long_run_hash, words

_NONE = -(1 << 63)
_PART = "bucket long, slice long, n long, h1 binary, h2 binary, place binary"
ADDED = ["n_words", "n_removed", "kept_text", "kept_sha256"]


def _places(doc: np.ndarray, row: np.ndarray, start: np.ndarray) -> bytes:
    """Sorted by row: the rows of a slice, their documents, how many places each has, and the places."""
    new = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    counts = np.diff(np.append(new, len(row))).astype(np.uint32)
    parts = (np.diff(doc[new].astype(np.int64), prepend=0), row[new].astype(np.int32), counts, start.astype(np.uint32))
    return np.int64(len(new)).tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in parts))


def _placed(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, data = int(np.frombuffer(raw, np.int64, 1)[0]), zstandard.ZstdDecompressor().decompress(raw[8:])
    doc, row = np.cumsum(np.frombuffer(data, np.int64, n)), np.frombuffer(data, np.int32, n, 8 * n)
    counts = np.frombuffer(data, np.uint32, n, 12 * n)
    return np.repeat(doc, counts), np.repeat(row, counts), np.frombuffer(data, np.uint32, -1, 16 * n).astype(np.int64)


def _windows(batch: pa.RecordBatch, window: int) -> tuple[np.ndarray, ...]:
    """(h1, h2, row, start) of the windows of a slice, a part of its texts at a time."""
    found, base = [], 0
    for b in slices(iter([batch]), most=2_000_000):
        w = words(*text_bytes(b.column("text")), NOT_SPACE, False)
        at = w.places(window)
        row = w.text_of()[at]
        h2 = (long_run_hash(w.hash, at, window, 1) >> np.uint64(32)).astype(np.uint32)
        found.append((long_run_hash(w.hash, at, window, 0), h2, base + row, at - w.first[row]))
        base += b.num_rows
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _repeats(parts: DataFrame, size: int, window: int, per_key: float, per_bucket: int = 1_000_000) -> DataFrame:
    """slice, late: for each slice the places of windows that start earlier elsewhere, in pieces of _places."""
    expected = size // 6  # a word for 6 bytes: only the cells and buckets hang on it
    sketch, buckets = Sketch(expected, per_key, 2), max(12, expected // 3 // per_bucket)

    def keys(b):
        return _windows(b, window)[0]

    def sent(number: int, batch: pa.RecordBatch, found) -> list[tuple]:
        h1, h2, row, start = _windows(batch, window)
        keep = sketch.levels(h1, found) > 0
        h1, h2, row, start = h1[keep], h2[keep], row[keep], start[keep]
        doc = batch.column("__doc_key").to_numpy()[row]
        order = np.lexsort((start, doc, h2, h1))
        same = np.zeros(len(order), bool)
        same[1:] = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))] if len(order) else order
        late = np.zeros(len(order), bool)
        late[order] = (doc[order] != doc[first]) | (start[order] != start[first])
        out, known = [], np.flatnonzero(late)
        if len(known):
            out.append((number % buckets, number, 0, b"", b"", _places(doc[known], row[known], start[known])))
        chosen = np.flatnonzero(~late)
        to = (h1[chosen] >> np.uint64(20)) % np.uint64(buckets)
        by = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[by], np.arange(buckets + 1, dtype=to.dtype))
        for k in np.flatnonzero(cuts[1:] > cuts[:-1]):
            c = chosen[by[cuts[k] : cuts[k + 1]]]
            out.append((int(k), number, len(c), h1[c].tobytes(), h2[c].tobytes(), _places(doc[c], row[c], start[c])))
        return out

    def find(batches):
        for batch in batches:
            for number, held, found in zip(batch.column("slice").to_pylist(), batch.column("held"), batch.column("found").to_pylist(), strict=True):
                rows = sent(number, opened(held.as_buffer()), found)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 3 else pa.binary()) for i, c in enumerate(zip(*rows, strict=True))], names=[c.split()[0] for c in _PART.split(", ")])

    def group(frame):
        known, mine = frame[frame["n"] == 0], frame[frame["n"] > 0]
        placed = [_placed(p) for p in mine["place"]]
        doc, row, start = (np.concatenate([p[i] for p in placed] or [np.zeros(0, np.int64)]) for i in range(3))
        of = np.repeat(np.arange(len(mine)), mine["n"])
        h1 = np.concatenate([np.frombuffer(x, np.uint64) for x in mine["h1"]] or [np.zeros(0, np.uint64)])
        h2 = np.concatenate([np.frombuffer(x, np.uint32) for x in mine["h2"]] or [np.zeros(0, np.uint32)])
        order = np.argsort(h1)
        equal = np.zeros(len(order) + 1, bool)
        equal[1:-1] = h1[order][1:] == h1[order][:-1]
        many = order[equal[1:] | equal[:-1]]
        order = many[np.lexsort((start[many], doc[many], h2[many], h1[many]))]
        same = np.zeros(len(order), bool)
        same[1:] = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))] if len(order) else order
        late = np.sort(order[(doc[order] != doc[first]) | (start[order] != start[first])])
        cuts = np.searchsorted(of[late], np.arange(len(mine) + 1))
        numbers = mine["slice"].to_numpy()
        out = [(numbers[i], _places(doc[o], row[o], start[o])) for i in range(len(mine)) if len(o := late[cuts[i] : cuts[i + 1]])]
        return pd.DataFrame(out + list(zip(known["slice"], known["place"], strict=True)), columns=["slice", "place"])

    found = sketch.counted(parts, keys).mapInArrow(find, _PART)
    late = found.groupBy("bucket").applyInPandas(group, "slice long, place binary")
    return late.groupBy("slice").agg(F.collect_list("place").alias("late"))


def _cut(raw: bytes, starts: np.ndarray, window: int) -> tuple[int, list[bytes], bytes]:
    """(words, kept words, the text without the others and the white space after each)."""
    array = np.frombuffer(raw, np.uint8)
    w = words(array, np.array([0, len(array)]), NOT_SPACE, False)
    gone = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(gone, starts, 1)
    np.add.at(gone, starts + window, -1)
    kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
    until = np.append(w.start[1:], len(array))
    text = raw[: w.start[0]] + b"".join([raw[s:e] for s, e in zip(w.start[kept].tolist(), until[kept].tolist(), strict=True)])
    return len(w.start), [raw[s:e] for s, e in zip(w.start[kept].tolist(), w.end[kept].tolist(), strict=True)], text


def substring_dedup(docs: DataFrame, window: int = 20, per_key: float = 4.0) -> DataFrame:
    """docs with n_words, n_removed, kept_text (the text without the removed words and the white space after each; the text itself if none) and kept_sha256 (of the kept words joined by one space). Columns of docs with these names are replaced."""
    docs = without(docs, ADDED)
    names = docs.columns
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = sliced(docs.withColumn("__doc_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE))), "slices")
    both = parts.join(_repeats(parts, size, window, per_key), "slice", "left")

    def cut(batches):
        from hashlib import sha256

        for batch in batches:
            for held, late in zip(batch.column("held"), batch.column("late").to_pylist(), strict=True):
                b, marks = opened(held.as_buffer()), {}
                for place in late or ():
                    _, row, start = _placed(place)
                    new = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    for r, s in zip(row[new].tolist(), np.split(start, new[1:]), strict=True):
                        marks.setdefault(r, []).append(s)
                n, removed, kept, digests = [], [], [], []
                for i, text in enumerate(b.column("text").to_pylist()):
                    raw = (text or "").encode()
                    if i in marks:
                        total, parts_, now = _cut(raw, np.concatenate(marks[i]), window)
                        text = now.decode()
                    else:
                        parts_ = raw.split()
                        total = len(parts_)
                    n.append(total)
                    removed.append(total - len(parts_))
                    kept.append(text)
                    digests.append(sha256(b" ".join(parts_)).hexdigest())
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(digests, pa.string())], names=[*names, *ADDED])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return both.mapInArrow(cut, schema + ", n_words long, n_removed long, kept_text string, kept_sha256 string")
