"""Scans: files routed by kind, a result a file, risk, and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CODE_EXTENSIONS, MEDIA_EXTENSIONS, RISK_ERROR, RISK_HIGH, RISK_MEDIUM, RISK_NONE, TABLE_EXTENSIONS, TEXT_EXTENSIONS
from ..functions.scalars import risk_of


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), "(?<=.)(\\.[^.]+)$", 1))


def file_kind(path: Column) -> Column:
    e = extension(path)
    kinds = {"code": CODE_EXTENSIONS, "media": MEDIA_EXTENSIONS, "text": TEXT_EXTENSIONS, "table": TABLE_EXTENSIONS}
    return F.coalesce(*(F.when(e.isin(*v), F.lit(k)) for k, v in kinds.items()))


def label_counts(spans: DataFrame, key: str = "path") -> DataFrame:
    """key, labels map<label, count>, hits, of spans(key, label)."""
    each = spans.groupBy(key, "label").agg(F.count("*").alias("n"))
    return each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("labels"), F.sum("n").alias("hits"))


def results(files: DataFrame, spans: DataFrame, key: str = "path") -> DataFrame:
    """A row for each file(key, kind, error): hits, labels, risk. Files that failed carry their error and that risk."""
    found = files.join(label_counts(spans, key), key, "left")
    risk = F.when(F.col("error").isNotNull(), RISK_ERROR).otherwise(risk_of(F.map_keys(F.coalesce("labels", F.create_map().cast("map<string,bigint>")))))
    return found.select(key, "kind", F.coalesce("hits", F.lit(0)).alias("hits"), "labels", "error", risk.alias("risk"))


def risk_rank(risk: Column) -> Column:
    return F.when(risk == RISK_HIGH, 0).when(risk == RISK_MEDIUM, 1).when(risk == RISK_ERROR, 2).when(risk == RISK_NONE, 3)


def by_risk(found: DataFrame, key: str = "path") -> DataFrame:
    return found.orderBy(risk_rank(F.col("risk")), key)


def summary(found: DataFrame) -> DataFrame:
    """dangerous, safe, failed, hits. A file that failed is not safe."""
    return found.agg(F.count_if(F.col("risk").isin(RISK_HIGH, RISK_MEDIUM)).alias("dangerous"), F.count_if(F.col("risk") == RISK_NONE).alias("safe"), F.count_if(F.col("risk") == RISK_ERROR).alias("failed"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))


def report(found: DataFrame, key: str = "path", most: int = 15) -> DataFrame:
    """line: a text report, the most dangerous `most` files and the counts."""
    top = by_risk(found.where(F.col("risk").isin(RISK_HIGH, RISK_MEDIUM)), key).limit(most)
    labels = F.array_join(F.transform(F.map_entries("labels"), lambda e: F.concat(e.key, F.lit(" "), e.value)), ", ")
    lines = top.select(F.format_string("[%s] %s: %s", F.col("risk"), F.col(key), labels).alias("line"))
    return lines.unionByName(summary(found).select(F.format_string("dangerous %d, safe %d, failed %d", "dangerous", "safe", "failed").alias("line")))


def label_rollup(spans: DataFrame, *by: str) -> DataFrame:
    """Counts of spans by the given columns and all their subtotals."""
    return spans.rollup(*by).agg(F.count("*").alias("n"))
