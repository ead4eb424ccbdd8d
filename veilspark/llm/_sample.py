"""A bounded sample of labelled texts for fitting a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int, most_bytes: int) -> list[tuple[str, object]]:
    """(text, label) of at most `rows` documents: those first by a hash of doc_id among the labelled ones that `allowed` lets in.

    Texts of over most_bytes are left out before the choice, so the sample holds at most rows * most_bytes bytes and is as
    full as the shorter texts allow. A document's
    label is the largest of its labels.
    """
    short = docs.where(F.octet_length("text") <= most_bytes).select("doc_id", "text")
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & allowed).groupBy("doc_id").agg(F.max(label).alias(label))
    chosen = known.join(short.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = short.join(F.broadcast(chosen), "doc_id")  # at most `rows` pairs of numbers
    once = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max(label).alias(label))
    return [(r["text"], r[label]) for r in once.select("text", label, "doc_id").orderBy("doc_id").collect()]
