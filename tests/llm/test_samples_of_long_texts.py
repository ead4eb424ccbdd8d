"""op10_quality and op5_toxicity: the labelled sample is full, and all of its texts teach."""

from pyspark.sql import functions as F

from veilspark.llm import quality
from veilspark.llm._sample import labelled_sample


def test_long_texts_do_not_shrink_the_sample(spark):
    docs = spark.createDataFrame([(i, "x" * (20 if i % 10 == 0 else 200)) for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", F.lit(True), rows=8, most_bytes=100)
    assert len(got) == 8 and {len(t) for t, _ in got} == {20}


def test_every_block_teaches(monkeypatch):
    seen = []
    monkeypatch.setattr(quality.zstandard, "train_dictionary", lambda size, blocks, level: seen.extend(blocks) or quality.zstandard.ZstdCompressionDict(b" " * 8))
    texts = ["".join(f"{c}{i}-{k} " for k in range(2000)) for c in "ab" for i in range(4)]
    quality.fit([(t, int(t[0] == "a")) for t in texts])
    assert b"".join(seen).decode() == "".join(texts[:2] + texts[4:6])
