"""page_boxes: Spark holds every row that is at a Python worker whole, with its words, so only lines that may have spans go there."""

from pyspark.sql import functions as F

from veilspark.config import EngineConfig
from veilspark.operators.detect import detect
from veilspark.plans.queries import QUERIES


def _nodes(plan):
    yield plan
    for k in range(plan.children().size()):
        yield from _nodes(plan.children().apply(k))


def _received(found):
    """Rows that each step in Python gave back, in the plan that has run."""
    steps = [n for n in _nodes(found._jdf.queryExecution().executedPlan()) if n.nodeName() == "ArrowEvalPython"]
    return [n.metrics().get("pythonNumRowsReceived").get().value() for n in steps]


def test_lines_without_spans_stay_out_of_python(spark, tmp_path):
    words = [f"({chr(97 + i % 26)})" for i in range(6000)]
    words[5], words[1005], words[2005], words[3005] = "ann@example.org", "bob＠example.org", "ｗｏｒｄ", "地址：台北市信義區市府路"
    spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = QUERIES["page_boxes"](spark, str(tmp_path))
        got = {(r["label"], r["value"]) for r in found.collect()}
        received = _received(found)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {("EMAIL", "ann@example.org"), ("EMAIL", "bob＠example.org")} <= got and [v for label, v in got if label == "ADDRESS"]
    assert len(received) >= 3 and 0 < max(received) < 40  # of 600 lines in three forms and more


def test_rows_that_are_not_wanted_go_and_others_are_as_before(spark):
    texts = ["nothing here", "see ann@example.org", "x ｗ", "at bob＠example.org", "wanted", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("is_code", F.lit(True))
    known = spark.createDataFrame([("PERSON", "nothing")], "label string, value string")
    for config in (EngineConfig(), EngineConfig(normalise=False)):
        for lists in ({}, {"known": known}, {"safe": spark.createDataFrame([("ann@example.org",)], "value string")}):
            whole = {r["doc_id"]: r for r in detect(docs, config, **lists, overlay=True).collect()}
            some = {r["doc_id"]: r for r in detect(docs, config, **lists, overlay=True, wanted=F.col("text") == "wanted").collect()}
            assert set(some) >= {4, *(k for k, r in whole.items() if r["spans"])} and len(whole) == len(texts)
            assert all(whole[k].asDict(True) == r.asDict(True) for k, r in some.items())
    assert set(some) == {1, 4}
