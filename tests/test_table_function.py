"""detect_spans in SQL equals detect() on whole tables."""

import pytest

from veilspark.functions import table_function
from veilspark.operators.detect import detect, long_spans

SF = "/root/testdata/sf0.001"


def test_equal_to_detect(spark):
    from test_detection import SAMPLES

    table_function.register(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(SAMPLES)] + [(7 * 10**6, "a​nn@example.org ＜p＞ &#65;BC-1234 ​")], "doc_id long, text string"))
    docs = docs.unionByName(spark.read.parquet(f"{SF}/pages.parquet").selectExpr("page_id + 2000000 AS doc_id", "html AS text"))
    docs.createOrReplaceTempView("searched")
    got = spark.sql("SELECT doc_id, s.start, s.end, s.label, s.value FROM searched, LATERAL detect_spans(text) s").collect()
    want = long_spans(detect(docs)).select("doc_id", "start", "end", "label", "value").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 300


def test_wrong_arguments(spark):
    table_function.register(spark)
    assert spark.sql("SELECT * FROM detect_spans(NULL)").collect() == []
    assert [tuple(r) for r in spark.sql("SELECT * FROM detect_spans('to a@b.org')").collect()] == [(3, 10, "EMAIL", "a@b.org")]
    with pytest.raises(Exception, match="takes a text"):
        spark.sql("SELECT * FROM detect_spans(5)").collect()
