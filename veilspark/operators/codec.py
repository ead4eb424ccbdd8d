"""Reversible tags: values get <LABEL_n>, texts are rewritten, and come back.

Numbers rise by label in the order of (document, start from the right); a value that has a tag keeps it whatever its
label. Here that is a relational plan: the first place of each new value, its rank in its label, and the largest number
the map already holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.patterns import TAG
from ..functions.spans import rewritten
from ..session import kept, ranked

MAP = "tag string, label string, n long, value string"


def empty_map(spark) -> DataFrame:
    """Also what clearing a map leaves: tags begin at 1 again, and texts masked before stay as they are."""
    return spark.createDataFrame([], MAP)


def imported_map(pairs: DataFrame) -> DataFrame:
    """(tag, value) as a map; tags of another form keep a null label."""
    label, n = F.regexp_extract("tag", f"^{TAG}$", 1), F.regexp_extract("tag", f"^{TAG}$", 2)
    return pairs.select("tag", F.nullif(label, F.lit("")).alias("label"), F.when(n != "", n.cast("long")).alias("n"), "value")


def extended_map(places: DataFrame, tags: DataFrame) -> DataFrame:
    """tags and the new ones. places: label, value and order columns o1, o2 of each occurrence."""
    known = tags.groupBy("value").agg(F.max("n").alias("n"))
    first = places.groupBy("value").agg(F.min(F.struct("o1", "o2", "label")).alias("f")).join(known, "value", "left_anti").select("value", "f.*")
    numbered = ranked(first, "label", [F.col("o1"), F.col("o2"), F.col("value")], "k")
    top = tags.where("label is not null").groupBy("label").agg(F.max("n").alias("top"))
    new = numbered.join(top, "label", "left").withColumn("n", F.col("k") + F.coalesce("top", F.lit(0)))
    return tags.unionByName(new.select(scalars.tag(F.col("label"), F.col("n")).alias("tag"), "label", "n", "value"))


def mask(found: DataFrame, tags: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with masked and hits, the extended map) of documents with spans. masked is null where nothing was found.

    Documents rank by doc_ord if they have it, else by doc_id.
    """
    tags = empty_map(found.sparkSession) if tags is None else tags
    order = "doc_ord" if "doc_ord" in found.columns else "doc_id"
    rows = kept(found.withColumn("__row", F.monotonically_increasing_id()))
    each = rows.select("__row", F.col(order).alias("o1"), "text", F.explode_outer("spans").alias("m")).where("m is not null")
    each = each.select("__row", "o1", (-F.col("m.start")).alias("o2"), "m.start", "m.end", "m.label", F.substring("text", F.col("m.start") + 1, F.col("m.end") - F.col("m.start")).alias("value"))
    full = kept(extended_map(each.select("o1", "o2", "label", "value"), tags))
    one = full.groupBy("value").agg(F.max_by("tag", "n").alias("tag"))
    pieces = each.join(one, "value").groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "tag"))).alias("pieces"))
    out = rows.join(pieces, "__row", "left").withColumn("masked", F.when(F.col("pieces").isNotNull(), rewritten(F.col("text"), F.col("pieces"))))
    return out.withColumn("hits", F.coalesce(F.size("pieces"), F.lit(0))).withColumn("hits", F.greatest("hits", F.lit(0))).drop("pieces", "__row"), full


def restore(docs: DataFrame, tags: DataFrame, column: str = "masked") -> DataFrame:
    """docs with restored: tags of the map replaced by their values, unknown ones left."""
    rows = kept(docs.withColumn("__row", F.monotonically_increasing_id()))
    gaps, found = F.split(column, TAG, -1), F.regexp_extract_all(column, F.lit(TAG), F.lit(0))
    each = rows.where(F.col(column).rlike(TAG)).select("__row", F.posexplode(found).alias("i", "tag"))
    values = each.join(tags.select("tag", "value").dropDuplicates(["tag"]), "tag", "left").groupBy("__row").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("value", "tag").alias("v")))), lambda x: x.v).alias("__values"))
    whole = F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size("__values")), F.col("__values"), lambda g, v: F.concat(g, v)), ""), F.element_at(gaps, -1))
    out = rows.join(values, "__row", "left")
    return out.withColumn("restored", F.when(F.col("__values").isNotNull(), whole).otherwise(F.col(column))).drop("__row", "__values")


def action(text: Column) -> Column:
    """What "auto" does with a text: restores it if it holds a tag, else masks it."""
    return F.when(text.rlike(TAG), "restore").otherwise("mask")


def process(docs: DataFrame, tags: DataFrame, detect, how: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(documents with action and result, map). detect: documents to documents with spans. result is null where nothing changed."""
    chosen = docs.withColumn("action", action(F.col("text")) if how == "auto" else F.lit(how))
    masked, full = mask(detect(chosen.where("action = 'mask'")), tags)
    back = restore(chosen.where("action = 'restore'"), tags, "text").withColumn("result", F.nullif("restored", "text"))
    names = [*docs.columns, "action", "result"]
    return masked.withColumn("result", F.col("masked")).select(names).unionByName(back.select(names)), full


def round_trip(found: DataFrame) -> DataFrame:
    """doc_id, text, restored and same: whether masking and restoring gives every text back."""
    masked, tags = mask(found)
    back = restore(masked.withColumn("masked", F.coalesce("masked", "text")), tags)
    return back.select("doc_id", "text", "restored", F.col("restored").eqNullSafe(F.col("text")).alias("same"))
