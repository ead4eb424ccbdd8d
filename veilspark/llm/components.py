"""Connected components of an edge table by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import counted, dropped


def _jumped(parent: DataFrame) -> DataFrame:
    """node, root: each node's last ancestor, of a table node, root of parents that are smaller than their nodes."""
    while True:
        above = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
        step = parent.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        now, found = counted(step, "parents", moved=F.count_if("moved"))
        dropped(parent)
        parent = now.drop("moved")
        if not found["moved"]:
            return parent


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of an edge (a, b) reaches, and the roots themselves.

    Each node hooks on to its smallest smaller neighbour; the trees are flattened by pointer jumping, which takes the
    logarithm of their depth in steps; what edges are left between trees makes the next graph. All steps are joins and
    aggregations of rows of two numbers, so no node's neighbours have to lie in one task. A table of no edges gives none.
    """
    ends = edges.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    left, found = counted(ends.distinct(), "edges", n=F.count("*"))
    roots = None
    while found["n"] or roots is None:
        tree = _jumped(counted(left.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("root")), "parents")[0])
        if roots is None:
            roots = tree
        else:  # nodes of the trees so far move with their roots, which are the nodes of this graph
            moved = roots.join(tree.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            roots = moved.unionByName(tree)
        of = lambda name: tree.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))  # noqa: B023, E731
        met = left.join(of("low"), "low", "left").join(of("high"), "high")
        low = F.coalesce("low_root", "low")
        rest, found = counted(met.where(low != F.col("high_root")).select(F.least(low, "high_root").alias("low"), F.greatest(low, "high_root").alias("high")).distinct(), "edges", n=F.count("*"))
        dropped(left)
        left = rest
        if found["n"]:
            roots = counted(roots, "roots")[0]
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
