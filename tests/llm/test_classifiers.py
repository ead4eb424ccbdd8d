"""op5, op7 and op10: held-out accuracy, defined results for odd texts, clashing columns."""

import zlib

import pytest
from pyspark.sql import functions as F

from veilspark.llm import language, quality, toxicity
from veilspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def auc(pairs):
    """Chance that a row of label 1 scores above one of label 0."""
    ones, zeros = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


@pytest.mark.parametrize("query,label,parts,part,least", [("op5_toxicity", "toxic", 4, 2, 0.8), ("op10_quality", "quality", 5, 0, 0.85)])
def test_held_out_rows(spark, query, label, parts, part, least):
    got = QUERIES[query](spark, SF).collect()
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == part)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    pairs = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(pairs) > 50 and auc(pairs) >= least
    assert sum((s >= 0.3) == y for s, y in pairs) / len(pairs) >= 0.88


def test_language_of_held_out_rows(spark):
    got = QUERIES["op7_language"](spark, SF).collect()
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pairs = [(r["lang_pred"], langs[r["doc_id"]]) for r in got if r["held_out"]]
    assert len(pairs) > 200 and sum(a == b for a, b in pairs) / len(pairs) >= 0.99


@pytest.mark.parametrize("query", ["op5_toxicity", "op7_language", "op10_quality"])
def test_hostile_rows(spark, rows, sf_dir, empty_dir, query):
    got = QUERIES[query](spark, sf_dir).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by_doc = {r["doc_id"]: r for r in got}
    assert by_doc[None]["held_out"] is False
    if query == "op7_language":
        texts = {}
        for d, t, *_ in rows:
            texts.setdefault(d, []).append(t)
        for d, t in texts.items():
            if len(t) == 1:
                assert (by_doc[d]["lang_pred"] == "und") == (not any(c.isalpha() for c in t[0] or ""))
    assert QUERIES[query](spark, empty_dir).collect() == []


def test_clashing_columns_are_replaced(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for found, column in (
        (toxicity.toxicity(docs, labels, F.lit(True)), "score"),
        (quality.quality(docs, labels, F.lit(True)), "score"),
        (language.identify(docs, language.train(docs, docs.select("doc_id", "lang"), F.lit(True)), spans=True), "lang_pred"),
    ):
        assert found.columns.count(column) == 1 and {"doc_id", "text", "place", "n_words"} <= set(found.columns)
        assert found.where(F.col("place") == 9).count() == docs.count()


def test_offending_sentences(spark):
    """Labels are of documents; the sentence that makes one toxic is the one that is found."""
    good = ["The garden was quiet. We walked along the river! Nothing else happened.", "Bread was sold here. A long day."]
    docs = [(i, good[i % 2] if i % 3 else f"A calm start. You grumblefux idiot number {i}! The end of it.") for i in range(300)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = toxicity.toxicity(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True)).collect()
    for r in found:
        assert r["predicted"] == int(r["doc_id"] % 3 == 0)
        worst = max(r["offending"], key=lambda x: x["score"], default=None)
        assert (worst is not None) == bool(r["predicted"]) and (worst is None or "grumblefux" in r["text"][worst["start"] : worst["end"]])


def test_spans_of_mixed_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang in ('en', 'de')")
    model = language.train(docs, docs.select("doc_id", "lang"), F.lit(True))
    mixed = "The committee will publish the results of the study on the following day. Die Ergebnisse der Untersuchung werden am nächsten Tag von dem Ausschuss veröffentlicht."
    [r] = language.identify(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model, spans=True).collect()
    assert [s["lang"] for s in r["spans"]] == ["en", "de"] and abs(r["spans"][1]["start"] - mixed.index("Die")) < 12
