"""Which of overlapping spans stay, in n log n for any number of hits in a text.

These run in Arrow batches, on the spans' columns and not on their texts: Spark's array functions would compare every span
with all kept ones, and copy the kept ones each time. Spans of a batch are sorted once; those that overlap no other stay at
once, and only clusters of overlapping ones are walked, with the kept ones' starts in order.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("source", T.StringType())])
SPANS = T.ArrayType(SPAN)
PAIRS = T.ArrayType(T.StructType([T.StructField("e", T.LongType()), T.StructField("d", T.LongType())]))


def opened(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the lists' elements, the number of the list of each)."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(len(lists)), lengths)


def closed(values: pa.Array, row: np.ndarray, like: pa.Array) -> pa.Array:
    """Lists of values, of rising rows; null where `like` is null."""
    offsets = np.append(0, np.cumsum(np.bincount(row, minlength=len(like)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pc.is_null(like))


def disjoint(row: np.ndarray, start: np.ndarray, end: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which of the intervals [start, end) stay, if each in `order` stays that overlaps none that stays already; by row."""
    keep = np.zeros(len(row), bool)
    if not len(row):
        return keep
    far = int(end.max()) + 1
    lo, hi = start + row * far, end + row * far
    by = np.lexsort((hi, lo))
    reach = np.maximum.accumulate(hi[by])
    new = np.append(True, lo[by][1:] >= reach[:-1])
    cluster = np.empty(len(row), np.int64)
    cluster[by] = np.cumsum(new) - 1
    alone = np.bincount(cluster) == 1
    keep[alone[cluster]] = True
    rest = order[~alone[cluster[order]]]
    rest = rest[np.argsort(cluster[rest], kind="stable")]
    starts: list[int] = []
    ends: list[int] = []
    last = -1
    for i, c, s, e in zip(rest.tolist(), cluster[rest].tolist(), lo[rest].tolist(), hi[rest].tolist(), strict=True):
        if c != last:
            starts, ends, last = [], [], c
        at = bisect_right(starts, s)
        if at and s < ends[at - 1] and starts[at - 1] < e or at < len(starts) and starts[at] < e and s < ends[at]:
            continue
        starts.insert(at, s)
        ends.insert(at, e)
        keep[i] = True
    return keep


def _codes(values: pa.Array) -> np.ndarray:
    """A number for each distinct value, -1 for null."""
    found = pc.dictionary_encode(values)
    return pc.fill_null(found.indices, -1).to_numpy(zero_copy_only=False)


@F.arrow_udf(SPANS)
def _merged(spans: pa.Array, prefer_zh: pa.Array) -> pa.Array:
    m, row = opened(spans)
    start, end = (m.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "end"))
    source = pc.fill_null(m.field("source"), "")
    is_ = lambda s: pc.equal(source, s).to_numpy(zero_copy_only=False)
    prefer = pc.fill_null(prefer_zh, False).to_numpy(zero_copy_only=False)[row]
    known = pc.is_valid(prefer_zh).to_numpy(zero_copy_only=False)[row]
    own = known & np.where(prefer, is_("zh"), is_("en"))
    tier = np.where(is_("regex"), 0, np.where(own, 1, np.where(is_("zh") | is_("en"), 2, 3)))
    score = pc.fill_null(m.field("score"), 0.0).to_numpy(zero_copy_only=False)
    order = np.lexsort((np.arange(len(row)), -score, start - end, tier, row))
    kept = np.flatnonzero(disjoint(row, start, end, order))
    kept = kept[np.lexsort((end[kept], start[kept], row[kept]))]
    return closed(m.take(pa.array(kept)), row[kept], spans)


def distinct_places(m: pa.Array, row: np.ndarray) -> np.ndarray:
    """Where, of equal spans of a row, the first one is."""
    fields = [m.field(k).to_numpy(zero_copy_only=False) for k in ("start", "end")]
    score = m.field("score")
    fields += [_codes(m.field("label")), _codes(m.field("source")), pc.fill_null(score, 0.0).to_numpy(zero_copy_only=False), pc.is_null(score).to_numpy(zero_copy_only=False)]
    order = np.lexsort((*fields, row))
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (row, *fields)], axis=0)
    return np.sort(order[new])  # the sort is stable: of equal ones the first


@F.arrow_udf(SPANS)
def _distinct(spans: pa.Array) -> pa.Array:
    m, row = opened(spans)
    first = distinct_places(m, row)
    return closed(m.take(pa.array(first)), row[first], spans)


def merged(spans: Column, prefer_zh: Column) -> Column:
    """Spans that don't overlap, by start: rules first, then models of the text's language, then others; in each the longer, then the surer, then the earlier listed ones.

    spans: a column, or an expression without lambdas in lambdas (see session.settled).
    """
    return _merged(spans.cast(SPANS), prefer_zh)


def distinct(spans: Column) -> Column:
    """Of equal spans the first, in their order."""
    return _distinct(spans.cast(SPANS))


@F.arrow_udf(PAIRS)
def once(pairs: pa.Array) -> pa.Array:
    """Of pairs (e, d) in order those whose e and d no earlier pair that stays has taken."""
    m, row = opened(pairs)
    kept, taken_e, taken_d, last = [], set(), set(), -1
    for i, (r, e, d) in enumerate(zip(row.tolist(), m.field("e").to_pylist(), m.field("d").to_pylist(), strict=True)):
        if r != last:
            taken_e, taken_d, last = set(), set(), r
        if e not in taken_e and d not in taken_d:
            taken_e.add(e)
            taken_d.add(d)
            kept.append(i)
    return closed(m.take(pa.array(kept, pa.int64())), row[kept], pairs)
