"""Texts go to Python in batches that a worker can hold."""

from pyspark.sql import functions as F

from veilspark.operators.detect import detect
from veilspark.operators.dictionary import with_dictionary
from veilspark.session import BATCH, ROWS, batched


def test_batches_of_texts_are_bounded(spark):
    own = spark.newSession()

    @F.arrow_udf("int")
    def rows(x):
        import pyarrow as pa

        return pa.array([len(x)] * len(x), pa.int32())

    docs = own.range(0, 3 * ROWS, 1, 1).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    detect(docs)
    assert docs.select(F.max(rows("text"))).first()[0] <= ROWS
    other = spark.newSession()
    words = other.createDataFrame([("A", "x")], "label string, value string")
    with_dictionary(other.createDataFrame([(1, "x")], "doc_id long, text string"), words, "spans", False)
    assert other.conf.get(BATCH) == str(ROWS)
    other.conf.set(BATCH, "77")
    assert batched(other.range(1)).sparkSession.conf.get(BATCH) == "77"
