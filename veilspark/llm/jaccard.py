"""Documents linked by the Jaccard similarity of their word shingles, exactly, and the components of the links.

1. A spread count-min sketch (_sketch) tells about how many documents hold each shingle. Shingles are ordered by that
   level of rarity, then by hash: one order for all documents.
2. A set of n shingles shares at least ceil(n t) with any set it is linked with, so the two have a shingle among the first
   n - ceil(n t) + 1 of each. Only these go to the inverted lists, and of these only shingles that may occur twice: most
   documents have that many of their own and send nothing. Documents of equal sets are one class, listed once.
3. Classes that meet in a list are candidates of each other. The search runs in rounds, so that a list of N copies never
   makes N**2 pairs: first each class is searched for by the list neighbour it meets most often, of those that come first
   in a list; links give components. After that only lists that still hold several components count. They are bundled by
   their largest component; members outside it ask the whole bundle, a few of them a round and in the end every one, so
   each two classes of a list that links don't join have been compared. What a round finds is kept as links of components,
   one for each two of them, never as pairs.
4. A bundle is dealt to blocks, each with inverted lists over its sets; the askers go to every block. A T-occurrence search
   by DivideSkip finds the sets that reach the overlap needed: the longest lists are set aside, a heap merges the short
   ones, and what occurs often enough there is looked up in the long ones by binary search.

Words are runs of anything but ASCII white space, after lower-casing A-Z. A set holds the distinct shingles of `k` words;
a text of fewer words is one shingle; null, empty and blank texts are linked with nothing. A null doc_id sorts before all
others. Rows that repeat a doc_id are documents each. An empty table gives an empty one; columns but doc_id and text are
ignored. Texts of any length are whole. Shingles are compared by 64 bits of hash, and sets by 128 bits.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import counted, dropped, saved, slices, text_bytes
from ._sketch import Sketch, opened, sliced
from ._words import NOT_SPACE, mix, run_hash, words
from .components import components

_NONE = -(1 << 63)
PART = 2048
#: How many members of a list ask in each round after the first.
ROUNDS = (8, 256, None)
_SALTS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)]
_DESCRIBED = "doc_key long, n long, s1 long, s2 long, tokens binary, prefix array<long>, places array<int>"


class Threshold:
    """percent: links need 100 * intersection >= percent * union."""

    def __init__(self, percent: int):
        self.percent = percent

    def overlap(self, n, m):
        """Elements that linked sets of n and m share at least."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def prefix(self, n):
        """How many of n elements, in an order common to all sets, are enough to meet every linked set's."""
        return n + 1 + -self.percent * n // 100


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, sorted by both."""
    w = words(raw, offsets, NOT_SPACE, True)
    count = np.diff(w.first)
    at = w.places(k)
    text, h = w.text_of()[at], run_hash(w.hash, at, k)
    for n in range(1, k):
        short = np.flatnonzero(count == n)
        text, h = np.concatenate([text, short]), np.concatenate([h, run_hash(w.hash, w.first[short], n)])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return text[new], h[new]


def _sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """shingle_sets of a slice, a part of its texts at a time."""
    found, base = [], 0
    for b in slices(iter([batch]), most=2_000_000):
        text, h = shingle_sets(*text_bytes(b.column("text")), k)
        found.append((text + base, h))
        base += b.num_rows
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _added(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    np.add.at(out, index, values)
    return out.view(np.int64)


def _described(docs: DataFrame, t: Threshold, k: int) -> DataFrame:
    """doc_key, n, s1 and s2 (hashes of the set) of each document; of those that may be linked, once a slice and set, the
    set's hashes (tokens), the shingles of its prefix that may occur twice, and their places in the set's order."""
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc_key"), "text")
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = sliced(named, "slices")
    sketch = Sketch(size // 6, 12.0, 1)  # a word for 6 bytes: only the cells hang on it

    def keys(b):
        return _sets(b, k)[1]

    def run(batches):
        for batch in batches:
            for held, found in zip(batch.column("held"), batch.column("found").to_pylist(), strict=True):
                b = opened(held.as_buffer())
                text, h = _sets(b, k)
                n = np.bincount(text, minlength=b.num_rows)
                s1, s2 = (_added(text, mix(h ^ s), b.num_rows) for s in _SALTS)
                level = sketch.levels(h, found)
                order = np.lexsort((h, level, text))
                first = np.concatenate([[0], np.cumsum(n)])
                place = np.arange(len(h)) - np.repeat(first[:-1], n)
                sent = (place < np.repeat(t.prefix(n), n)) & (level[order] > 0)
                alive = np.bincount(text[order][sent], minlength=b.num_rows) > 0
                _, once = np.unique(np.stack([s1, s2]), axis=1, return_index=True)
                alive &= np.isin(np.arange(b.num_rows), once)
                sent &= alive[text]
                cuts = np.concatenate([[0], np.cumsum(np.bincount(text[order][sent], minlength=b.num_rows))])
                lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x)) for x in (h[order][sent].view(np.int64), place[sent].astype(np.int32))]
                tokens = [h[first[i] : first[i + 1]].tobytes() if alive[i] else None for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column("doc_key"), pa.array(n), pa.array(s1), pa.array(s2), pa.array(tokens, pa.binary()), *lists], names=[c.split()[0] for c in _DESCRIBED.split(", ")])

    out = saved(sketch.counted(parts, keys).mapInArrow(run, _DESCRIBED), "described")
    dropped(parts)
    return out


def _close(t: Threshold, a: str, b: str) -> Column:
    """Whether sizes, and places of a common shingle in both orders, leave room for the overlap."""
    n, m, i, j = (F.col(f"{x}.{y}") for y in ("n", "place") for x in (a, b))
    need = F.ceil(t.percent * (n + m) / F.lit(100 + t.percent) - 1e-9)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * t.percent) & (F.least(i, j) + F.least(n - i, m - j) >= need)


def _dealt(lists: DataFrame) -> DataFrame:
    """lists with part: long lists are dealt to parts of about PART members, so that joins on a list are no single task's."""
    return lists.withColumn("part", F.pmod(F.xxhash64("c"), F.ceil(F.col("size") / PART).cast("long")))


def _for_parts(of_list: DataFrame) -> DataFrame:
    """of_list(token, size, ...), a row for each part of the list."""
    return of_list.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / PART).cast("long") - 1))).drop("size")


def _first_askers(lists: DataFrame, t: Threshold) -> DataFrame:
    """a, b: of the classes that come first in a list, the one that each class b shares most lists with."""
    centre = lists.groupBy("token", "size").agg(F.min_by(F.struct("c", "n", "place"), "c").alias("y"))
    met = _dealt(lists).select("token", "part", F.struct("c", "n", "place").alias("x")).join(_for_parts(centre), ["token", "part"])
    met = met.where((F.col("x.c") != F.col("y.c")) & _close(t, "x", "y"))
    often = met.groupBy(F.col("x.c").alias("b"), F.col("y.c").alias("a")).agg(F.count("*").alias("k"))
    return often.groupBy("b").agg(F.max_by("a", F.struct("k", "a")).alias("a"))


def t_occurrence(lists: list[np.ndarray], least: int, reach) -> list[tuple[int, int]]:
    """(candidate, occurrences) of the candidates that occur in at least reach(candidate) of the sorted lists, all of which are at least `least`.

    DivideSkip: the longest lists are set aside; what occurs `least` times must occur in the others at least that less
    their number, which a heap finds; then it is looked up in the long lists by binary search, until it can't get there.
    """
    lists = sorted((x for x in lists if len(x)), key=len)
    if len(lists) < least:
        return []
    aside = min(least - 1, int(least / (0.0085 * math.log2(len(lists[-1]) + 1) + 1)))
    short, long_ = lists[: len(lists) - aside], lists[len(lists) - aside :]
    need = least - aside
    found = [(c, n) for c, n in ((c, sum(1 for _ in same)) for c, same in groupby(heapq.merge(*(x.tolist() for x in short)))) if n >= need]
    if len(found) > 8:
        c, n = (np.array(x) for x in zip(*found, strict=True))
        goal = np.array([reach(x) for x in c.tolist()])
        for left, x in zip(range(aside, 0, -1), long_, strict=True):
            may = n + left >= goal
            c, n, goal = c[may], n[may], goal[may]
            at = np.minimum(np.searchsorted(x, c), len(x) - 1)
            n = n + (x[at] == c)
        return [(int(i), int(k)) for i, k, g in zip(c, n, goal, strict=True) if k >= g]
    out, plain = [], [x.tolist() for x in long_]
    for c, n in found:
        goal, left = reach(c), aside
        for x in plain:
            if n + left < goal:
                break
            i = bisect_left(x, c)
            n, left = n + (i < len(x) and x[i] == c), left - 1
        if n >= goal:
            out.append((c, n))
    return out


def _block_links(names: list[int], sets: list[np.ndarray], askers: dict[int, tuple[int, np.ndarray]], t: Threshold):
    """Links of components, (one, other), that the askers (label and set, by class) have with a block of sets (labelled names)."""
    root: dict[int, int] = {}

    def find(x):
        while x in root:
            x = root[x]
        return x

    sizes, labels = np.array([len(s) for s in sets]), np.array(names)
    token = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(token, kind="stable")
    token, of = token[order], of[order]
    for label, x in askers.values():
        others = np.flatnonzero((labels != label) & (np.minimum(sizes, len(x)) * 100 >= np.maximum(sizes, len(x)) * t.percent))
        if not len(others):
            continue
        begin, end = np.searchsorted(token, x, "left"), np.searchsorted(token, x, "right")
        lists = [of[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True) if e > b]
        goal = t.overlap(len(x), sizes)
        least, reach = int(goal[others].min()), goal.tolist()
        for i, _ in t_occurrence(lists, least, lambda i: max(least, reach[i])):  # noqa: B023
            one, other = find(label), find(names[i])
            if one != other:
                root[max(one, other)] = min(one, other)
                yield min(one, other), max(one, other)


def _searched(members: DataFrame, askers: DataFrame, classes: DataFrame, t: Threshold, per_block: int = 400_000, most_askers: int = 256) -> DataFrame:
    """a, b: links of components that askers have in their bundles. Both tables hold bundle, c and label, each c once a bundle.

    A bundle's members are dealt to blocks of about per_block shingles, its askers to chunks of about most_askers.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt")  # so that the join on a hot bundle is many keys
    salt = F.pmod(F.hash("c"), F.lit(16)).alias("salt")
    size = members.join(classes.select("c", "n"), "c").groupBy("bundle").agg(F.ceil(F.sum("n") / per_block).alias("blocks"))
    dealt = size.join(askers.groupBy("bundle").agg(F.ceil(F.count("*") / most_askers).alias("chunks")), "bundle")
    dealt = dealt.select("*", salts)
    at = lambda n: F.pmod(F.xxhash64("c"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = members.select("*", salt).join(dealt, ["bundle", "salt"]).select("bundle", at("blocks").alias("block"), each("chunks").alias("chunk"), "c", "label", F.lit(False).alias("asks"))
    theirs = askers.select("*", salt).join(dealt, ["bundle", "salt"]).select("bundle", each("blocks").alias("block"), at("chunks").alias("chunk"), "c", "label", F.lit(True).alias("asks"))
    held = mine.unionByName(theirs).join(classes.select("c", F.col("tokens").alias("set")), "c")

    def run(frames):
        def rows():
            for f in frames:
                yield from f[["bundle", "block", "chunk", "c", "label", "asks", "set"]].itertuples(index=False, name=None)

        out = []
        for _, block in groupby(rows(), key=lambda r: r[:3]):
            labels, sets, asking = [], [], {}
            for *_, c, label, asks, raw in block:
                if asks:
                    asking[c] = (label, np.frombuffer(raw, np.uint64))
                else:
                    labels.append(label)
                    sets.append(np.frombuffer(raw, np.uint64))
            if sets and asking:
                out += _block_links(labels, sets, asking, t)
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    keys = ["bundle", "block", "chunk"]
    return held.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "a long, b long").distinct()


def _mixed(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """token, size, bundle, c, label: the members of lists with several components, and the largest one of their list, which bundles it."""
    named = lists.select("token", "size", "c").join(roots.select(F.col("node").alias("c"), F.col("root").alias("label")), "c", "left").withColumn("label", F.coalesce("label", "c"))
    held = named.groupBy("token", "size", "label").agg(F.count("*").alias("k")).groupBy("token", "size")
    kinds = held.agg(F.max_by("label", F.struct("k", "label")).alias("bundle"), F.count("*").alias("kinds")).where("kinds > 1")
    return _dealt(named).join(_for_parts(kinds.drop("kinds")), ["token", "part"]).select("token", "size", "bundle", "c", "label")


def _askers(mixed: DataFrame, most: int | None) -> DataFrame:
    """Members outside a bundle's component: all of them, or of more than `most` one for each of so many parts by hash."""
    outside = mixed.where("label <> bundle")
    if most is None:
        return outside
    part = outside.withColumn("part", F.pmod(F.xxhash64("c", F.lit(most)), F.lit(most)))
    some = part.groupBy("bundle", "part").agg(F.count("*").alias("k"), F.min(F.struct("c", "label")).alias("x"))
    crowded = some.groupBy("bundle").agg(F.sum("k").alias("k")).where(F.col("k") > most).select("bundle")
    few = outside.join(crowded, "bundle", "left_anti")
    return few.unionByName(some.join(crowded, "bundle").select("bundle", "x.c", "x.label"))


def _links(lists: DataFrame, classes: DataFrame, t: Threshold) -> DataFrame:
    """node, root: the components of the links between classes."""
    first = saved(_first_askers(lists, t), "first")
    members = first.select(F.col("a").alias("bundle"), F.col("b").alias("c"), F.col("b").alias("label"))
    askers = first.select("a").distinct().select(F.col("a").alias("bundle"), F.col("a").alias("c"), F.col("a").alias("label"))
    roots = components(_searched(members, askers, classes, t))
    dropped(first)
    for most in ROUNDS:
        lists, found = counted(_mixed(lists, roots), "mixed", n=F.count("*"))
        if not found["n"]:
            break
        members, outside = counted(lists.select("bundle", "c", "label").distinct(), "members", n=F.count_if(F.col("label") != F.col("bundle")))
        askers, asked = counted(_askers(members, most), "askers", n=F.count("*"))
        links, found = counted(_searched(members, askers, classes, t), "links", n=F.count("*"))
        dropped(members)
        dropped(askers)
        if found["n"]:  # links join components: their roots move, and nodes with them
            above = components(links).select(F.col("node").alias("root"), F.col("root").alias("above"))
            moved = roots.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            roots = saved(moved.unionByName(above.join(roots.select("node"), F.col("root") == F.col("node"), "left_anti").select(F.col("root").alias("node"), F.col("above").alias("root"))), "roots")
        if asked["n"] == outside["n"]:  # every member outside has asked all of its bundle: nothing is left
            break
    return roots


def jaccard_components(docs: DataFrame, percent: int = 90, k: int = 3) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links lead to) of each document."""
    t = Threshold(percent)
    described = _described(docs, t, k)
    alive = described.where(F.col("tokens").isNotNull()).groupBy("n", "s1", "s2").agg(*(F.first(x).alias(x) for x in ("tokens", "prefix", "places")))
    classes = saved(alive.withColumn("c", F.monotonically_increasing_id()), "classes")
    each = classes.select("c", "n", F.explode(F.arrays_zip("prefix", "places")).alias("p")).select("c", "n", F.col("p.prefix").alias("token"), F.col("p.places").alias("place"))
    shared = saved(each.groupBy("token").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    lists = saved(each.join(shared, "token"), "lists")
    dropped(shared)
    roots = _links(lists, classes, t)
    dropped(lists)
    own = described.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_key").alias("least"))
    named = own.join(classes.select("n", "s1", "s2", "c"), ["n", "s1", "s2"], "left").join(roots.withColumnRenamed("node", "c"), "c", "left")
    named = saved(named.select("n", "s1", "s2", "least", "root"), "named")
    of_root = named.where("root is not null").groupBy("root").agg(F.min("least").alias("component"))
    of_root = of_root.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(15))))  # so that a large component is many keys
    dealt = named.withColumn("part", F.pmod(F.xxhash64("n", "s1", "s2"), F.lit(16)))
    whole = saved(dealt.join(of_root, ["root", "part"], "left").select("n", "s1", "s2", F.coalesce("component", "least").alias("component")), "components")
    for done in (classes, roots, named):
        dropped(done)
    # a table read back on either side: Spark may split the rows of a class with very many copies
    found = described.select("doc_key", "n", "s1", "s2").join(whole, ["n", "s1", "s2"], "left")
    real_id = lambda c: F.when(c != _NONE, c)
    return found.select(real_id(F.col("doc_key")).alias("doc_id"), F.col("n").alias("n_shingles"), real_id(F.coalesce("component", "doc_key")).alias("component_id"))
