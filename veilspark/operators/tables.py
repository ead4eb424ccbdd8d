"""Columns of tables: which hold personal data, and masking them whole.

Tables are wide DataFrames of any types. The decision is a long plan: cells that are no formula and not blank, each
distinct value of a column detected once, votes by label; columns whose name decides are never looked into.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.scalars import header_type, is_candidate, stripped
from ..session import settled
from . import codec
from .detect import detect


def header_types(df: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """ix, name and label (null if the name decides nothing) of each column."""
    named = df.sparkSession.createDataFrame(list(enumerate(df.columns)), "ix int, name string")
    return named.withColumn("label", header_type(F.col("name"), (config or EngineConfig()).header_rules))


def cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """row_id, ix, name, value: the table in long form, all values as text."""
    columns = columns or df.columns
    rows = df if "row_id" in df.columns else df.withColumn("row_id", F.monotonically_increasing_id())
    each = F.array(*(F.struct(F.lit(df.columns.index(c)).alias("ix"), F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))
    return rows.select("row_id", F.inline(each))


def column_votes(long: DataFrame, config: EngineConfig | None = None, of: tuple[str, ...] = (), **lists) -> DataFrame:
    """ix, name, label, votes, hit_cells, first: how often each label lies in a column's cells. Each distinct value is detected once.

    of: further columns of `long` that tell tables apart.
    """
    config = config or EngineConfig()
    # cells are short, and detection costs far more than their bytes tell: as many tasks as shuffles have
    tasks = config.partitions or int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    good = long.where(is_candidate(F.col("value")))
    values = good.groupBy(*of, "ix", "name", "value").agg(F.count("*").alias("n"), F.min("row_id").alias("row"))
    distinct = values.select("value").distinct().select(F.col("value").alias("doc_id"), F.col("value").alias("text"), F.lit(False).alias("is_code"))
    named = F.transform("spans", lambda m, i: F.struct(i.alias("pos"), m.label.alias("label")))
    named = F.filter(named, lambda x: ~x.label.isin(*config.ignored_column_labels)) if config.ignored_column_labels else named
    found = settled(detect(distinct, replace(config, partitions=tasks), **lists), "found", named).select(F.col("doc_id").alias("value"), "found").where(F.size("found") > 0)
    # a vote for each label, and one entry without a place for the cell itself: detection runs once for both
    entries = F.concat(F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("label"))), "found")
    each = values.join(found, "value").select(*of, "ix", "name", "n", "row", F.explode_outer(entries).alias("e")).select(*of, "ix", "name", "n", "row", "e.*")
    votes = each.groupBy(*of, "ix", "name", "label", F.col("pos").isNull().alias("cell")).agg(F.sum("n").alias("votes"), F.min(F.struct("row", "pos")).alias("first"))
    hit = F.sum(F.when(F.col("cell"), F.col("votes"))).over(Window.partitionBy(*of, "ix"))
    return votes.withColumn("hit_cells", hit).where(~F.col("cell")).select(*of, "ix", "name", "label", "votes", "first", "hit_cells")


def decided(df: DataFrame, config: EngineConfig | None = None, **lists) -> DataFrame:
    """ix, name, label, reason: a column's name decides first, then most of its cells' labels, a tie by what comes first."""
    by_name = header_types(df, config)
    settled = {r["name"] for r in by_name.where("label is not null").select("name").collect()}
    rest = [c for c in df.columns if c not in settled]
    named = by_name.withColumn("reason", F.when(F.col("label").isNotNull(), "header"))
    if not rest:
        return named
    order = Window.partitionBy("ix").orderBy(F.desc("votes"), "first")
    top = column_votes(cells(df, rest), config, **lists).withColumn("k", F.row_number().over(order)).where("k = 1")
    votes = top.select("ix", F.col("label").alias("voted"), F.concat(F.lit("content ("), F.col("hit_cells"), F.lit(" cells)")).alias("why"))
    return named.join(votes, "ix", "left").select("ix", "name", F.coalesce("label", "voted").alias("label"), F.coalesce("reason", "why").alias("reason"))


def mask_columns(df: DataFrame, types: dict[str, str], tags: DataFrame | None = None, order: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table, map, report of changed cells by column): every cell of the given columns but blanks and formulas becomes its value's tag, in the order of rows, then columns.

    order: a column of unique numbers that rows are ordered by; without it the order is that of Spark's partitions, which
    may change from one reading of a table to the next, and with it the numbers of tags.
    """
    spark = df.sparkSession
    tags = codec.empty_map(spark) if tags is None else tags
    from ..session import kept

    rows = kept(df.withColumn("row_id", F.col(order).cast("long") if order else F.monotonically_increasing_id()))
    label = F.element_at(F.create_map(*(F.lit(x) for kv in types.items() for x in kv)), F.col("name")) if types else F.lit(None).cast("string")
    long = cells(rows.select("row_id", *types), list(types)) if types else None
    if long is None:
        return df, tags, spark.createDataFrame([], "name string, label string, cells long")
    place = {c: i for i, c in enumerate(df.columns)}
    ix = F.element_at(F.create_map(*(F.lit(x) for kv in place.items() for x in kv)), F.col("name"))
    used = kept(long.where(is_candidate(F.col("value"))).select("row_id", ix.alias("ix"), "name", label.alias("label"), stripped(F.col("value")).alias("value")))
    full = kept(codec.extended_map(used.select("label", "value", F.col("row_id").alias("o1"), F.col("ix").alias("o2")), tags))
    one = full.groupBy("value").agg(F.max_by("tag", "n").alias("tag"))
    wide = used.join(one, "value").groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "tag"))).alias("__tags"))
    joined = rows.join(wide, "row_id", "left")
    out = [F.coalesce(F.element_at("__tags", F.lit(c)), F.col(f"`{c}`").cast("string")).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns]
    return joined.select(*out), full, used.groupBy("name", "label").agg(F.count("*").alias("cells"))


def mask_table(df: DataFrame, config: EngineConfig | None = None, tags: DataFrame | None = None, order: str | None = None, **lists):
    """(table, map, report) with the columns that `decided` finds."""
    types = {r["name"]: r["label"] for r in decided(df, config, **lists).where("label is not null").orderBy("ix").collect()}  # a row a column
    return mask_columns(df, types, tags, order)
