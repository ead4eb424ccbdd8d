"""Streams of copied texts and of events: batch and stream run the same functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import codec


def tumbling_counts(events: DataFrame, width: str, *by: str, late: str | None = None) -> DataFrame:
    """window_start, by, n: events(ts, ...) counted by windows of event time."""
    events = events.withWatermark("ts", late) if late and events.isStreaming else events
    return events.groupBy(F.window("ts", width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def sliding_counts(events: DataFrame, width: str, step: str, *by: str, late: str | None = None) -> DataFrame:
    events = events.withWatermark("ts", late) if late and events.isStreaming else events
    return events.groupBy(F.window("ts", width, step).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def debounced(events: DataFrame, gap: str, key: str, order: str, payload: str, late: str | None = None) -> DataFrame:
    """key, session_start, n, latest: of events that follow each other within the gap only the last counts."""
    events = events.withWatermark("ts", late) if late and events.isStreaming else events
    s = events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max(F.struct(order, payload)).alias("m"))
    return s.select(key, F.col("w.start").alias("session_start"), "n", F.col(f"m.{payload}").alias("latest"))


def latest(events: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The last state of each key."""
    return events.groupBy(key).agg(F.max(F.struct(order, *columns)).alias("m")).select(key, "m.*")


def unseen(events: DataFrame, key: str, late: str | None = None) -> DataFrame:
    """Each sequence number once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def stale(overrides: DataFrame, current: DataFrame, key: str, seq: str) -> DataFrame:
    """overrides with whether the key has moved on since they were computed, so that they must be computed again."""
    now = current.groupBy(key).agg(F.max(seq).alias("__now"))
    return overrides.join(now, key, "left").withColumn("stale", ~F.col(seq).eqNullSafe(F.col("__now"))).drop("__now")


def mask_stream(texts: DataFrame, detect: Callable[[DataFrame], DataFrame], map_path: str, out_path: str, checkpoint: str, how: str = "auto", retries: int = 3, **trigger) -> StreamingQuery:
    """Each micro-batch of texts(doc_id, text) masked or restored with one tag map that grows from batch to batch.

    Each batch adds its new tags to the map as <map_path>/v=<batch>, before its output. The map of a batch is all that the
    batches before it added, so one that runs again gives the same tags, and what it added before is replaced. Only the
    first batch may find no map. detect is called for each batch: lists that it reads then are as new as the batch.
    """
    spark = texts.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        try:
            tags = spark.read.schema(codec.MAP + ", v long").parquet(map_path).where(F.col("v") < number).drop("v")
        except AnalysisException as e:
            if number or e.getCondition() != "PATH_NOT_FOUND":
                raise
            tags = codec.empty_map(spark)
        for attempt in range(retries):
            try:
                out, full = codec.process(batch, tags, detect, how)
                full.join(tags.select("tag", "value"), ["tag", "value"], "left_anti").select(tags.columns).write.mode("overwrite").parquet(f"{map_path}/v={number}")
                out.select("doc_id", "action", F.coalesce("result", "text").alias("text")).write.mode("overwrite").parquet(f"{out_path}/batch={number}")
                return
            except Exception:
                if attempt + 1 == retries:
                    raise

    return texts.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_labels(spans: DataFrame, width: str, late: str) -> DataFrame:
    """Counts of detections by label and window of event time, of spans(ts, label)."""
    return tumbling_counts(spans, width, "label", late=late)


def changed(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)
