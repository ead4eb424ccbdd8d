"""Streams over files that arrive in several batches, with restarts."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veilspark.operators import codec
from veilspark.operators.detect import detect
from veilspark.streaming import events as ev

DOCS = "doc_id long, text string"


def test_masking_goes_on_after_a_restart(spark, tmp_path):
    source, out, tags, mark = (str(tmp_path / x) for x in ("in", "out", "map", "checkpoint"))

    def run(rows):
        spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(source)
        query = ev.mask_stream(spark.readStream.schema(DOCS).parquet(source), detect, tags, out, mark)
        query.awaitTermination()
        return {r["doc_id"]: (r["action"], r["text"]) for r in spark.read.parquet(out).collect()}

    assert run([(1, "mail a@b.org or c@d.org")]) == {1: ("mask", "mail <EMAIL_2> or <EMAIL_1>")}
    got = run([(2, "again a@b.org and e@f.org"), (3, "nothing"), (4, "back: <EMAIL_2> <EMAIL_9>")])
    assert got[2] == ("mask", "again <EMAIL_2> and <EMAIL_3>") and got[3] == ("mask", "nothing") and got[4] == ("restore", "back: a@b.org <EMAIL_9>")
    held = spark.read.schema(codec.MAP + ", v long").parquet(tags)
    assert sorted((r["tag"], r["value"], r["v"]) for r in held.collect()) == [("<EMAIL_1>", "c@d.org", 0), ("<EMAIL_2>", "a@b.org", 0), ("<EMAIL_3>", "e@f.org", 1)]


def test_a_lost_map_is_an_error(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for k, folder in enumerate(("map", "elsewhere")):
        spark.createDataFrame([(k, "a@b.org")], DOCS).write.mode("append").parquet(source)
        query = ev.mask_stream(spark.readStream.schema(DOCS).parquet(source), detect, str(tmp_path / folder), out, mark)
        if k == 0:
            query.awaitTermination()
        else:
            with pytest.raises(Exception, match="PATH_NOT_FOUND"):
                query.awaitTermination()


def test_lists_are_read_for_each_batch(spark, tmp_path):
    source, out, tags, mark, known = (str(tmp_path / x) for x in ("in", "out", "map", "checkpoint", "known"))
    seen = {}
    for k, value in enumerate(("Ann Lee", "Bob Ray")):
        spark.createDataFrame([("PERSON", value)], "label string, value string").write.mode("append").parquet(known)
        spark.createDataFrame([(k, "Ann Lee met Bob Ray")], DOCS).write.mode("append").parquet(source)
        look = lambda b: detect(b, known=spark.read.parquet(known))
        ev.mask_stream(spark.readStream.schema(DOCS).parquet(source), look, tags, out, mark).awaitTermination()
        seen = {r["doc_id"]: r["text"] for r in spark.read.parquet(out).collect()}
    assert seen == {0: "<PERSON_1> met Bob Ray", 1: "<PERSON_1> met <PERSON_2>"}


def test_windows_and_sessions_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    base = datetime(2024, 1, 1)
    rows = [(i, base + timedelta(minutes=7 * i + (i % 5)), i % 3, "ab"[i % 2]) for i in range(60)]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    source = str(tmp_path / "in")
    frame.repartition(3).write.parquet(source)
    stream = lambda: spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)

    def drained(df, mode):
        q = df.writeStream.format("memory").queryName(f"t{id(df)}").outputMode(mode).option("checkpointLocation", str(tmp_path / f"c{id(df)}")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(map(tuple, spark.table(f"t{id(df)}").collect()))

    counts = ev.tumbling_counts(stream(), "1 hour", "event_type")
    assert drained(counts, "complete") == sorted(map(tuple, ev.tumbling_counts(frame, "1 hour", "event_type").collect()))
    slides = ev.sliding_counts(stream(), "1 hour", "30 minutes", "event_type")
    assert drained(slides, "complete") == sorted(map(tuple, ev.sliding_counts(frame, "1 hour", "30 minutes", "event_type").collect()))
    sessions = ev.debounced(stream(), "30 minutes", "user_id", "event_id", "event_type")
    assert drained(sessions, "complete") == sorted(map(tuple, ev.debounced(frame, "30 minutes", "user_id", "event_id", "event_type").collect()))
    once = ev.unseen(stream().unionByName(stream()), "event_id", "1 day").select("event_id")
    assert drained(once, "append") == [(i,) for i in range(60)]


def test_stale_overrides(spark):
    a = spark.createDataFrame([(1, 5), (2, 7), (3, None)], "user_id long, seq long")
    b = spark.createDataFrame([(1, 5), (1, 4), (2, 8)], "user_id long, seq long")
    assert {r["user_id"]: r["stale"] for r in ev.stale(a, b, "user_id", "seq").collect()} == {1: False, 2: True, 3: False}
    assert [r["c"] for r in spark.range(1).select(ev.changed(F.lit(1), F.lit(None)).alias("c")).collect()] == [True]
