"""Suffix-array deduplication of bytes: every byte in a string of `window` bytes that starts earlier elsewhere is removed.

What must meet is found by anchors: of the strings of 2/5 of a window inside each window, the one of the smallest hash.
Equal windows have equal anchors, so a repeat's anchor occurs twice at least. The windows that share an anchor in one place
make a snippet: some 160 bytes for 100. A spread count-min sketch of anchors (_sketch) tells each slice of the documents
which of its anchors may occur again; it only overestimates, so it loses none, and its cells grow with the corpus. Those
snippets alone are sent, dealt by anchor. Copies of one snippet in a slice are known repeats but for the first, and are not
sent: a passage that a third of all documents hold is sent once a slice.

Where a string shorter than a window is very common, its snippets are many and differ. So snippets of an anchor that occurs very
often are parted further, by the anchor's place in a window and the bytes that all windows of that place share (NARROW).

A bucket of anchors puts its distinct snippets, each at its earliest place, one after another and builds a run-length
index of them, for a share of anchors at a time: a Burrows-Wheeler transform by runs with sampled run ends (run_index). Streaming through the text, the
index gives the matching statistics of each place; windows whose matches reach the window's length are linked, and of
linked ones all but the earliest (doc_id, start) are repeats. What lies between the separators of snippets matches no
further than they do, so a snippet's ends are exact to the byte. Repeats go back to their slice, where a last pass cuts
the bytes they cover.

Texts are their UTF-8 bytes; null and empty texts have none. Matches never cross documents. A null doc_id sorts before all
others. Rows that share a doc_id and a start are one place: a repeated row does not repeat itself. Texts of any length are
whole; one of more than a slice's bytes is a slice of its own. An empty table gives an empty one. Bytes are removed singly,
so what is kept of a text may not be valid UTF-8: it is binary. Snippets are told apart by 96 bits of hash (and then their
windows by their bytes), anchors by 64: that only sends more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, text_bytes, without
from ._sketch import Sketch, opened, sliced
from ._words import _BASES, _BYTES, mix
from .run_index import RunIndex

_NONE, _HIGH = -(1 << 63), ~np.uint64((1 << 24) - 1)
_SENT = "bucket long, slice long, n long, snippets binary, text binary"
ADDED = ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
#: From so many occurrences on, as a power of two, an anchor's snippets are parted by where it stands in their windows, to so
#: many places a part.
NARROW = ((18, 1), (12, 8))
#: Of a snippet: what it is dealt by, two hashes, its document, row in its slice, first window and number of windows.
_SNIPPET = [("key", "<u4"), ("h1", "<u8"), ("h2", "<u4"), ("doc", "<i8"), ("row", "<i4"), ("start", "<i8"), ("count", "<i4")]
_MARK = [("row", "<i4"), ("start", "<i8"), ("count", "<i4")]


def _packed(kinds, columns) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.astype(k).tobytes() for c, (_, k) in zip(columns, kinds, strict=True)))


def _unpacked(kinds, raw: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(raw), 0, []
    n = len(data) // sum(np.dtype(k).itemsize for _, k in kinds)
    for _, k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _ranges_of(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after another."""
    ends = np.cumsum(length)
    return np.repeat(begin - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)


def _smallest(h: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w values in a row."""
    span = 1
    while span * 2 <= w:
        h = np.minimum(h[: len(h) - span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (w - span)], h[w - span :]) if w > span else h


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base, kept for the next call."""
    if len(_POWERS.get(base, ())) < n:
        out = np.full(max(n, 1 << 19), base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[base][:n]


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), dtype=np.uint64, out=out[1:])
    return out


def _hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    return mix((sums[end] - sums[begin]) * _powers(pow(base, -1, 1 << 64), len(sums))[begin])


def _snippets_of(raw: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(anchor, its place, h1, h2, row, start, count) of the snippets of texts of less than 2**24 bytes in all."""
    k, n = max(1, 2 * window // 5), len(raw)
    if n < window:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none.astype(np.uint64), none.astype(np.uint32), none, none, none
    values = _BYTES[raw]
    sums = _sums(values, _BASES[1])
    h = sums[k:] - sums[:-k]
    h *= _powers(pow(_BASES[1], -1, 1 << 64), len(h))
    ordered = (h & _HIGH) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the first place
    least = _smallest(ordered, window - k + 1)
    lengths = np.diff(offsets)
    some = np.column_stack([np.maximum(lengths - window + 1, 0), np.minimum(lengths, window - 1)]).ravel()
    valid = np.repeat(np.tile([True, False], len(lengths)), some)[: len(least)]
    new = np.append(True, least[1:] != least[:-1])
    new[1:] |= ~valid[:-1]
    last = np.append(new[1:] | ~valid[1:], True)
    begin = np.flatnonzero(valid & new)
    count = np.flatnonzero(valid & last) + 1 - begin
    at = (least[begin] & ~_HIGH).astype(np.int64)
    row = np.searchsorted(offsets, begin, "right") - 1
    end = begin + count + window - 1
    h2 = _hash(_sums(values, _BASES[2]), begin, end, _BASES[2]) >> np.uint64(32)
    return mix(h[at]), at - offsets[row], _hash(sums, begin, end, _BASES[1]), h2.astype(np.uint32), row, begin - offsets[row], count


def _snippets(batch: pa.RecordBatch, window: int, most: int = 1 << 15) -> list[np.ndarray]:
    """The same of a slice, a part of its texts, or of one long text, at a time."""
    found, base = [], 0
    for b in slices(iter([batch]), most=most):
        raw, offsets = text_bytes(b.column("text"))
        pieces = [(0, raw, offsets)]
        if len(raw) > 2 * most:  # a single text; a snippet that is cut in two stays in the bucket of its anchor
            pieces = [(a, p := raw[a : a + most + window - 1], np.array([0, len(p)])) for a in range(0, len(raw), most)]
        for a, part, cuts in pieces:
            anchor, at, h1, h2, row, start, count = _snippets_of(part, cuts, window)
            found.append((anchor, a + at, h1, h2, base + row, a + start, count))
        base += b.num_rows
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _narrowed(raw: np.ndarray, offsets: np.ndarray, at, row, start, count, window: int, width: int, block: int = 1 << 15) -> list[np.ndarray]:
    """(key, h1, h2, row, start, count) of snippets parted into classes of `width` places of the anchor in a window.

    Equal windows have their anchor at the same place, so they stay in one class. All windows of a class share the
    window - width + 1 bytes at fixed places around the anchor; the class and these bytes' hash are the key.
    """
    high, low = at - start, at - start - count + 1
    n = high // width - low // width + 1
    of = np.repeat(np.arange(len(at)), n)
    c = high[of] // width - (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
    to, from_ = np.minimum(high[of], c * width + width - 1), np.maximum(low[of], c * width)
    first, many = at[of] - to, to - from_ + 1
    key, h1, h2 = np.empty(len(of), np.uint64), np.empty(len(of), np.uint64), np.empty(len(of), np.uint64)
    for b in range(0, len(of), block):
        s = slice(b, b + block)
        length = many[s] + window - 1
        values = _BYTES[raw[_ranges_of(offsets[row[of[s]]] + first[s], length)]]
        end = np.cumsum(length)
        sums, shared = _sums(values, _BASES[1]), end - length + (at[of[s]] - c[s] * width) - first[s]
        h1[s] = _hash(sums, end - length, end, _BASES[1])
        h2[s] = _hash(_sums(values, _BASES[2]), end - length, end, _BASES[2])
        key[s] = mix(_hash(sums, shared, shared + window - width + 1, _BASES[1]) + c[s].astype(np.uint64))
    return [key, h1, (h2 >> np.uint64(32)).astype(np.uint32), row[of], first, many]


def _first(order: np.ndarray, *by: np.ndarray) -> np.ndarray:
    """Of each of `order` the first there that is equal in all of `by`, of which order is sorted."""
    if not len(order):
        return order
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in by], axis=0)
    return order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]


def _repeated(h1, h2, doc, start, count, text: np.ndarray, begin: np.ndarray, window: int) -> list[tuple[np.ndarray, ...]]:
    """(snippet, first window, number of windows) of all windows that start earlier in another of these snippets; begin: of each snippet in text."""
    order = np.lexsort((start, doc, h2, h1))
    first = np.empty(len(order), np.int64)
    first[order] = _first(order, h1, h2)
    later = (doc != doc[first]) | (start != start[first])
    copies = np.flatnonzero(later)
    found = [(copies, start[copies], count[copies])]
    distinct = np.unique(first)
    distinct = distinct[np.lexsort((start[distinct], doc[distinct]))]
    if len(distinct) < 2:
        return found
    length = count[distinct] + window - 1
    at = np.cumsum(length + 1) - length - 1
    codes = np.ones(int(length.sum()) + len(length), np.int16)  # 1 parts the snippets
    codes[_ranges_of(at, length)] = text[_ranges_of(begin[distinct], length)].astype(np.int16) + 2
    places = _ranges_of(at, count[distinct])
    of = np.repeat(np.arange(len(distinct)), count[distinct])
    name = RunIndex(codes).groups(places, window, len(codes))
    _, document = np.unique(doc[distinct], return_inverse=True)
    key = (document[of].astype(np.int64) << 40) + start[distinct][of] + places - at[of]
    earliest = np.full(len(codes), np.iinfo(np.int64).max)
    np.minimum.at(earliest, name, key)
    late = np.flatnonzero(key > earliest[name])
    new = np.flatnonzero(np.append(True, (late[1:] != late[:-1] + 1) | (of[late[1:]] != of[late[:-1]]))) if len(late) else late
    n = np.diff(np.append(new, len(late)))
    snippet, from_ = distinct[of[late[new]]], places[late[new]] - at[of[late[new]]]
    # a place that several rows share: what holds for one of them holds for all
    mates = np.flatnonzero(~later & (np.arange(len(first)) != first))
    same = [(snippet, start[snippet] + from_, n)]
    if len(mates):
        by = np.argsort(first[mates], kind="stable")
        lo, hi = (np.searchsorted(first[mates][by], snippet, side) for side in ("left", "right"))
        twin = mates[by][_ranges_of(lo, hi - lo)]
        same.append((twin, start[twin] + np.repeat(from_, hi - lo), np.repeat(n, hi - lo)))
    return found + same


def _repeats(parts: DataFrame, size: int, window: int, per_key: float, per_bucket: int, narrow: tuple, per_index: int = 400_000) -> DataFrame:
    """slice, late: for each slice the marked runs of windows, in pieces of _MARK."""
    step = (window - 2 * window // 5 + 2) // 2  # the mean distance of anchors
    sketch, buckets = Sketch(size // step, per_key, 2), max(12, size // per_bucket)

    def keys(b):
        return _snippets(b, window)[0]

    def sent(number: int, batch: pa.RecordBatch, found) -> list[tuple]:
        anchor, *snippets = _snippets(batch, window)
        raw, offsets = text_bytes(batch.column("text"))
        level, at = sketch.levels(anchor, found), snippets.pop(0)
        parts_ = []
        for least, width in (*narrow, (1, 0)):
            mine = np.flatnonzero(level >= least)
            level[mine] = 0
            held = [x[mine] for x in snippets]
            parts_.append(_narrowed(raw, offsets, at[mine], *held[2:], window, min(width, window)) if width else [anchor[mine], *held])
        key, h1, h2, row, start, count = (np.concatenate(x) for x in zip(*parts_, strict=True))
        doc = batch.column("__doc_key").to_numpy()[row]
        order = np.lexsort((start, doc, h2, h1))
        first = np.empty(len(order), np.int64)
        first[order] = _first(order, h1, h2)
        late = (doc != doc[first]) | (start != start[first])
        out, known = [], np.flatnonzero(late)
        if len(known):
            out.append((number % buckets, number, 0, _packed(_MARK, (row[known], start[known], count[known])), b""))
        chosen = np.flatnonzero(~late)
        to = ((key[chosen] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[by], np.arange(buckets + 1))
        squeeze = zstandard.ZstdCompressor(level=1)
        for i in np.flatnonzero(cuts[1:] > cuts[:-1]):
            c = np.sort(chosen[by[cuts[i] : cuts[i + 1]]])
            text = raw[_ranges_of(offsets[row[c]] + start[c], count[c] + window - 1)]
            out.append((int(i), number, len(c), _packed(_SNIPPET, (key[c], h1[c], h2[c], doc[c], row[c], start[c], count[c])), squeeze.compress(text.tobytes())))
        return out

    def find(batches):
        for batch in batches:
            for number, held, found in zip(batch.column("slice").to_pylist(), batch.column("held"), batch.column("found").to_pylist(), strict=True):
                rows = sent(number, opened(held.as_buffer()), found)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 3 else pa.binary()) for i, c in enumerate(zip(*rows, strict=True))], names=[c.split()[0] for c in _SENT.split(", ")])

    def group(frame):
        known, mine = frame[frame["n"] == 0], frame[frame["n"] > 0]
        out = list(zip(known["slice"], known["snippets"], strict=True))
        if len(mine):
            key, *snippets = (np.concatenate(x) for x in zip(*(_unpacked(_SNIPPET, s) for s in mine["snippets"]), strict=True))
            row, snippets[5] = snippets[3], snippets[5].astype(np.int64)
            length = snippets[5] + window - 1
            text, begin = np.frombuffer(b"".join(map(zstandard.ZstdDecompressor().decompress, mine["text"])), np.uint8), np.cumsum(length) - length
            of, numbers = np.repeat(np.arange(len(mine)), mine["n"]), mine["slice"].to_numpy()
            shares, late = 1 + len(text) // per_index, []
            for k in range(shares):  # an index each
                at = np.flatnonzero(key % np.uint32(shares) == k)
                snippet, from_, n = (np.concatenate(x) for x in zip(*_repeated(*(x[at] for i, x in enumerate(snippets) if i != 3), text, begin[at], window), strict=True))
                late.append((at[snippet].astype(np.int32), from_, n.astype(np.int32)))
            snippet, from_, n = (np.concatenate(x) for x in zip(*late, strict=True))
            by = np.argsort(of[snippet], kind="stable")
            cuts = np.searchsorted(of[snippet][by], np.arange(len(mine) + 1))
            for i in np.flatnonzero(cuts[1:] > cuts[:-1]):
                o = by[cuts[i] : cuts[i + 1]]
                out.append((numbers[i], _packed(_MARK, (row[snippet[o]], from_[o], n[o]))))
        return pd.DataFrame(out, columns=["slice", "marks"])

    found = sketch.counted(parts, keys).mapInArrow(find, _SENT)
    late = found.groupBy("bucket").applyInPandas(group, "slice long, marks binary")
    return late.groupBy("slice").agg(F.collect_list("marks").alias("late"))


def suffix_dedup(docs: DataFrame, window: int = 100, per_key: float = 4.0, per_bucket: int = 16_000_000, narrow: tuple = NARROW) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (maximal runs of removed bytes), kept (the other bytes) and kept_sha256. Columns of docs with these names are replaced.

    per_bucket: bytes of the corpus for each bucket of anchors. narrow: see NARROW.
    """
    docs = without(docs, ADDED)
    names = docs.columns
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = sliced(docs.withColumn("__doc_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE))), "slices")
    both = parts.join(_repeats(parts, size, window, per_key, per_bucket, narrow), "slice", "left")

    def cut(batches):
        from hashlib import sha256

        for batch in batches:
            for held, late in zip(batch.column("held"), batch.column("late").to_pylist(), strict=True):
                b = opened(held.as_buffer())
                raw, offsets = text_bytes(b.column("text"))
                gone = np.zeros(len(raw) + 1, np.int32)
                for marks in late or ():
                    row, start, count = _unpacked(_MARK, marks)
                    np.add.at(gone, offsets[row] + start, 1)
                    np.add.at(gone, offsets[row] + start + count + window - 1, -1)
                covered = np.cumsum(gone[:-1]) > 0
                removed = np.diff(np.append(0, np.cumsum(covered))[offsets])
                heads = covered & np.append(True, ~covered[:-1]) if len(covered) else covered
                heads[offsets[:-1][offsets[:-1] < len(raw)]] |= covered[offsets[:-1][offsets[:-1] < len(raw)]]
                spans = np.diff(np.append(0, np.cumsum(heads))[offsets])
                kept = [raw[s:e][~covered[s:e]].tobytes() if n else raw[s:e].tobytes() for s, e, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), removed.tolist(), strict=True)]
                digests = [sha256(x).hexdigest() for x in kept]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), pa.array(np.diff(offsets)), pa.array(removed), pa.array(spans), pa.array(kept, pa.binary()), pa.array(digests, pa.string())], names=[*names, *ADDED])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return both.mapInArrow(cut, schema + ", n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
