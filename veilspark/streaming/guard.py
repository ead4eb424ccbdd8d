"""Work in flight on a stream, and texts that meet changes of a list.

guarded() decides for each request of a key whether it runs: while one runs, a further request is dropped, or waits its turn,
as `how` says. Whether one runs is state of the key, in Spark's state store; so is the queue. A request ends by a row of kind
"done", or, if none comes, when event time has moved `patience` past its start: then a timer lets the next one run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DECIDED = "key string, seq long, ts timestamp, decision string"


class Guard(StatefulProcessor):
    """At most one request of a key runs. Rows: key, seq, ts (milliseconds in event time), kind ("request" or "done")."""

    def __init__(self, how: str, patience: int):
        if how not in ("drop", "queue"):
            raise ValueError('how must be "drop" or "queue"')
        self.how, self.patience = how, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", "seq long, since long")
        self.waiting = handle.getListState("waiting", "seq long")

    def _start(self, key: str, seq: int, at: int) -> tuple:
        self.running.update((seq, at))
        self.handle.registerTimer(at + self.patience)
        return key, seq, at, "run"

    def _free(self, key: str, at: int) -> Iterator[tuple]:
        """The one that runs has ended at `at`: the next one of the queue runs."""
        self.running.clear()
        queue = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        if queue:
            if queue[1:]:
                self.waiting.put([(s,) for s in queue[1:]])
            else:
                self.waiting.clear()
            yield self._start(key, queue[0], at)

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["key", "seq", "ts", "decision"])
        frame["ts"] = pd.to_datetime(frame["ts"], unit="ms")
        return frame

    def handleInputRows(self, key, rows, timerValues):
        own = pd.concat(list(rows)).sort_values(["at", "seq", "kind"])
        out: list[tuple] = []
        for seq, at, kind in zip(own["seq"].tolist(), own["at"].tolist(), own["kind"].tolist(), strict=True):
            now = self.running.get()
            while now is not None and now[1] + self.patience <= at:  # it should have ended before this row
                out += self._free(key[0], now[1] + self.patience)
                now = self.running.get()
            if kind == "done":
                if now is not None and now[0] == seq:
                    out += self._free(key[0], at)
            elif now is None:
                out.append(self._start(key[0], seq, at))
            elif self.how == "queue":
                self.waiting.appendValue((seq,))
            else:
                out.append((key[0], seq, at, "dropped"))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """All that should have ended by now, one after another: those it lets run may be over their time as well."""
        until, out = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), []
        now = self.running.get()
        while now is not None and now[1] + self.patience <= until:
            out += self._free(key[0], now[1] + self.patience)
            now = self.running.get()
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass


def guarded(requests: DataFrame, how: str = "drop", patience: str = "30 seconds", late: str = "10 seconds") -> DataFrame:
    """key, seq, ts, decision ("run" or "dropped") of a stream requests(key, seq, ts, kind). ts: when it runs or was dropped.

    Rows of a micro-batch are taken by event time; one that comes later than `late` is none. Rows without key, seq or ts are none.
    The session must keep its state in RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    if requests.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKS:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {ROCKS}")
    unit = dict(zip(("second", "minute", "hour"), (1_000, 60_000, 3_600_000), strict=True))
    n, name = patience.split()
    held = requests.where("key is not null and seq is not null and ts is not null").withWatermark("ts", late)
    rows = held.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), "ts", F.unix_millis("ts").alias("at"), "kind")
    return rows.groupBy("key").transformWithStateInPandas(Guard(how, int(n) * unit[name.rstrip("s")]), DECIDED, "Append", "EventTime")


def affected(texts: DataFrame, changes: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """doc_id, ts, value, label, changed_at: texts(user_id, doc_id, ts, text) that hold a value(user_id, ts, value, label) which the
    user's list got in the time `within` after them, so that they must be masked again. Streams or tables; each stream's rows are
    waited for as long as the other's watermark lets them matter."""
    marked = lambda df: df.withWatermark("ts", late) if df.isStreaming else df
    t = marked(texts).select("user_id", "doc_id", F.col("ts"), "text")
    c = marked(changes).select(F.col("user_id").alias("__user"), F.col("ts").alias("changed_at"), "value", "label")
    met = (F.col("user_id") == F.col("__user")) & (F.col("changed_at") >= F.col("ts")) & (F.col("changed_at") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    held = (F.col("value") != "") & F.contains(F.col("text"), F.col("value"))
    return t.join(c, met & held).select("doc_id", "ts", "value", "label", "changed_at")
