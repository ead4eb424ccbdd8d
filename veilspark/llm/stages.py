"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and, but for the last, returns documents' columns.

Nulls, empty and very long texts: whole texts are judged; a null or empty one is never toxic by its words, never a near
copy, repeat or hit, and stays. A null doc_id is a document's id as any other and sorts first. Decisions on a doc_id
(near copies, contamination) hold for all rows that bear it; rows equal in every column are one where near copies go.
Ties: the smallest doc_id of a group of near copies stays, the earliest (doc_id, place) of a repeated passage. Columns beyond
those of documents are dropped, whatever their names. An empty table gives an empty table of the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import held_out
from .decontamination import decontaminate
from .jaccard import jaccard_components
from .packing import pack
from .queries import _path, table
from .substring_dedup import substring_dedup
from .toxicity import score, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score reaches 0.3 go. The model learns from labelled documents of the whole corpus."""
    model = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 4, 2))
    return score(docs.select(COLUMNS), model).where(F.col("score") < 0.3).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest doc_id: five words, a similarity of 0.8 or more."""
    found = jaccard_components(docs.select("doc_id", "text"), percent=80, k=5)
    kept = found.where(_same("doc_id", "component_id")).select(F.col("doc_id").alias("__kept")).distinct()
    once = docs.select(COLUMNS).dropDuplicates(COLUMNS)
    return once.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi").select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 20 words that occurred before are cut out; documents without any keep their text as it is."""
    found = substring_dedup(docs.select(COLUMNS), window=20)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of 10 words of a benchmark item go."""
    found = decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)
    bad = found.where("n_hit > 0").select(F.col("doc_id").alias("__bad")).distinct()
    return docs.select(COLUMNS).join(bad, F.col("doc_id").eqNullSafe(F.col("__bad")), "left_anti")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of at most 1024, each with the mixture of the sources that are left."""
    return pack(docs, _path("byte_bpe_50k.json"), end_id=0, window=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack_windows),
]
