"""Dictionaries of any size: automata over their values, run once over each text in Arrow batches.

values(label, value) are dealt by hash into shards of about SHARD characters, so that a shard's automaton (Aho-Corasick: a
trie of the values with links from each place to the longest one that ends it) fits a worker's memory beside the texts. A
shard is sent to all tasks, which is bounded by its size, and each worker builds it once. A dictionary of one shard
is a column of the texts. One of more is searched shard by shard: the texts are numbered and written once, what a shard
finds is written by row number, and the finds are joined to the texts at the end. Either way all places of all values are
found first and chosen after, so the number of shards changes no result.

A value that begins or ends with an ASCII letter or digit does not match inside a longer run of them. Of what overlaps, the
leftmost and then the longest stays, as a pattern of all values would find it. per_label: labels are searched apart and
may overlap, and a value of several labels has all of them. Else a value of several labels has the smallest. A null label
is SENSITIVE. Null and empty values match nothing, null texts hold nothing; repeated rows count once.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import SPANS, closed, disjoint, opened
from ..functions.spans import no_spans
from ..session import batched, kept

#: Characters of a shard's values. An automaton takes some 40 bytes for each.
SHARD = 2_000_000
#: What a label is that is not given.
UNNAMED = "SENSITIVE"
_BUILT: dict[str, object] = {}


def _edge(c: str) -> bool:
    return c.isascii() and c.isalnum()


def _automaton(name: str, shard: list[tuple[str, tuple[int, ...]]]):
    """The automaton of a shard's (value, numbers of its labels), built once in each worker; one at a time is kept."""
    if name not in _BUILT:
        import ahocorasick

        _BUILT.clear()
        found = ahocorasick.Automaton()
        for value, labels in shard:
            found.add_word(value, (len(value), _edge(value[0]), _edge(value[-1]), labels))
        found.make_automaton()
        _BUILT[name] = found
    return _BUILT[name]


def _places(texts: pa.Array, automaton) -> tuple[list[int], list[int], list[int], list[int]]:
    """(row, start, end, label) of all places where a value may stand."""
    rows, starts, ends, names = [], [], [], []
    for r, text in enumerate(texts.to_pylist()):
        for last, (length, first_edge, last_edge, labels) in automaton.iter(text) if text else ():
            at = last + 1 - length
            if first_edge and at and _edge(text[at - 1]) or last_edge and last + 1 < len(text) and _edge(text[last + 1]):
                continue
            for label in labels:
                rows.append(r)
                starts.append(at)
                ends.append(last + 1)
                names.append(label)
    return rows, starts, ends, names


def _spans(start: np.ndarray, end: np.ndarray, label: pa.Array) -> pa.Array:
    n = len(start)
    arrays = [pa.array(start, pa.int32()), pa.array(end, pa.int32()), label, pa.nulls(n, pa.float64()), pa.repeat(pa.scalar("regex"), n)]
    return pa.StructArray.from_arrays(arrays, names=["start", "end", "label", "score", "source"])


def _chosen(row: np.ndarray, start: np.ndarray, end: np.ndarray, label: np.ndarray, per_label: bool) -> np.ndarray:
    """Places that stay, by row (and label): the leftmost, then the longest. label: numbers in the order of the names."""
    group = row * (int(label.max()) + 1 if len(label) else 1) + label if per_label else row
    order = np.lexsort((label, -end, start, group))
    _, dense = np.unique(group, return_inverse=True)
    stay = np.flatnonzero(disjoint(dense.astype(np.int64), start, end, order))
    return stay[np.lexsort((start[stay], group[stay]))]


def _shards(values: DataFrame, per_label: bool, least: int, size: int) -> tuple[int, DataFrame]:
    """(number of shards, shard, value, labels)."""
    held = values.where(F.length("value") >= max(1, least)).select(F.coalesce("label", F.lit(UNNAMED)).alias("label"), "value")
    labels = F.array_sort(F.collect_set("label")) if per_label else F.array(F.min("label"))
    held = held.groupBy("value").agg(labels.alias("labels"))
    n = 1 + (held.agg(F.sum(F.length("value"))).first()[0] or 0) // size
    return n, held.withColumn("shard", F.pmod(F.xxhash64("value"), F.lit(n)))


def _search(spark, shard: DataFrame, choose: bool, per_label: bool):
    """A function of a text column: the spans of a shard's values; all of them, or those that stay."""
    rows = shard.select("value", "labels").collect()  # about SHARD characters
    names = sorted({x for r in rows for x in r["labels"]})
    number = {x: i for i, x in enumerate(names)}
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r["value"], tuple(number[x] for x in r["labels"])) for r in rows]))

    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        row, start, end, label = (np.array(x, np.int64) for x in (_places(texts, _automaton(*sent.value)) if len(sent.value[1]) else ([],) * 4))
        if choose:
            stay = _chosen(row, start, end, label, per_label)
            row, start, end, label = row[stay], start[stay], end[stay], label[stay]
        found = pa.array(names, pa.string()).take(pa.array(label))
        return closed(_spans(start, end, found), row, pa.array(np.ones(len(texts), bool)))

    return run


def _of_all(per_label: bool):
    @F.arrow_udf(SPANS)
    def run(spans: pa.Array) -> pa.Array:
        m, row = opened(spans)
        start, end = (m.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "end"))
        names, label = np.unique(np.array(m.field("label").to_pylist(), dtype=object), return_inverse=True) if len(m) else (None, row)
        stay = _chosen(row, start, end, label.astype(np.int64), per_label)
        return closed(m.take(pa.array(stay)), row[stay], spans)

    return run


def with_dictionary(docs: DataFrame, values: DataFrame | None, name: str, per_label: bool, text: Column | None = None, least: int = 1, size: int | None = None) -> DataFrame:
    """docs with `name`: the spans of the values of at least `least` characters in `text` (a column of docs), by label and start."""
    text = F.col("text") if text is None else text
    if values is None:
        return docs.withColumn(name, no_spans())
    spark = batched(docs).sparkSession
    n, shards = _shards(values, per_label, least, size or SHARD)
    if n == 1:
        return docs.withColumn(name, _search(spark, shards, True, per_label)(text))
    shards = kept(shards)
    placed = kept(docs.withColumn("__row", F.monotonically_increasing_id()))
    found = []
    for i in range(n):  # each is written before the next is sent
        spans = _search(spark, shards.where(F.col("shard") == i), False, per_label)(text)
        found.append(kept(placed.select("__row", spans.alias("spans")).where(F.size("spans") > 0)))
    each = reduce(DataFrame.unionAll, found).groupBy("__row").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    chosen = each.select("__row", _of_all(per_label)(F.col("spans")).alias(name))
    return placed.join(chosen, "__row", "left").withColumn(name, F.coalesce(name, no_spans())).drop("__row")
