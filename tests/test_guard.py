"""Work in flight and the join of two streams, over files that arrive in several batches, with restarts."""

import random
from datetime import datetime, timedelta

import pytest

from veilspark.streaming import guard

BASE = datetime(2024, 1, 1)
REQUESTS = "key string, seq long, ts timestamp, kind string"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, guard.ROCKS)
    yield
    spark.conf.unset(name)


def at(seconds):
    return BASE + timedelta(seconds=seconds)


def drained(spark, df, out, mark):
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def plain(rows, how, patience):
    """One request of a key at a time, row by row in event time."""
    out, running, waiting = [], {}, {}

    def free(key, when):
        running.pop(key)
        if waiting.get(key):
            start(key, waiting[key].pop(0), when)

    def start(key, seq, when):
        running[key] = (seq, when)
        out.append((key, seq, when, "run"))

    def expire(key, until):
        while key in running and running[key][1] + timedelta(seconds=patience) <= until:
            free(key, running[key][1] + timedelta(seconds=patience))

    for key, seq, ts, kind in sorted(rows, key=lambda r: (r[2], r[1], r[3])):
        expire(key, ts)
        if kind == "done":
            if key in running and running[key][0] == seq:
                free(key, ts)
        elif key not in running:
            start(key, seq, ts)
        elif how == "queue":
            waiting.setdefault(key, []).append(seq)
        else:
            out.append((key, seq, ts, "dropped"))
    return out, running, expire


@pytest.mark.parametrize("how", ["drop", "queue"])
def test_one_request_at_a_time(spark, rocks, tmp_path, how):
    """Three batches with a restart before each; some requests never end, and the last rows move event time on."""
    rng = random.Random(7)
    rows, seq = [], 0
    for key in "ab":
        t = 0
        for _ in range(40):
            t += rng.randrange(1, 9)
            seq += 1
            rows.append((key, seq, at(t), "request"))
            if rng.random() < 0.7:
                rows.append((key, seq, at(t + rng.randrange(1, 12)), "done"))
    rows.sort(key=lambda r: r[2])
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    cut = [rows[:50], rows[50:90], rows[90:], [("z", 10**6, at(10_000), "request")], [("z", 10**6 + 1, at(10_001), "request")]]
    for part in cut:
        spark.createDataFrame(part, REQUESTS).coalesce(1).write.mode("append").parquet(source)
        drained(spark, guard.guarded(spark.readStream.schema(REQUESTS).parquet(source), how, "20 seconds", "30 seconds"), out, mark)
    want, running, expire = plain(rows, how, 20)
    for key in list(running):
        expire(key, at(10_000))
    got = [tuple(r) for r in spark.read.schema(guard.DECIDED).parquet(out).where("key <> 'z'").collect()]
    assert sorted(got) == sorted(want) and {d for *_, d in got} == ({"run", "dropped"} if how == "drop" else {"run"})


def test_wrong_settings(spark):
    with pytest.raises(ValueError, match="drop"):
        guard.Guard("wait", 1)
    with pytest.raises(ValueError, match="providerClass"):
        guard.guarded(spark.createDataFrame([], REQUESTS))


def test_texts_meet_changes(spark, tmp_path):
    """Two streams of several batches, with a restart, late rows on either side: equal to the join of the tables."""
    rng = random.Random(3)
    texts = [(i % 3, i, at(60 * i), f"about {rng.choice(['Ann', 'Bob', 'Eve'])} and {rng.choice(['Ann', 'x'])}") for i in range(60)] + [(0, 900, None, "Ann"), (1, 901, at(5), None)]
    changes = [(rng.randrange(3), at(60 * rng.randrange(70)), rng.choice(["Ann", "Bob", "", None]), "PERSON") for _ in range(40)]
    kinds = ("user_id long, doc_id long, ts timestamp, text string", "user_id long, ts timestamp, value string, label string")
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    whole = guard.affected(spark.createDataFrame(texts, kinds[0]), spark.createDataFrame(changes, kinds[1]), "20 minutes")
    by_time = sorted(changes, key=lambda r: r[1])
    for k in range(3):  # each batch ends before the next begins; rows of the batch before come late, but within ten minutes
        for name, part, kind in (("t", texts[20 * k : 20 * k + 20] + (texts[60:] if k == 2 else []), kinds[0]), ("c", [r for r in by_time if at(1200 * k) <= r[1] < at(1200 * k + 1200) or k == 2 and r[1] >= at(3600)], kinds[1])):
            spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        streams = (spark.readStream.schema(kind).parquet(str(tmp_path / name)) for name, kind in zip("tc", kinds))
        drained(spark, guard.affected(*streams, "20 minutes", "10 minutes"), out, mark)
    got = sorted(map(tuple, spark.read.parquet(out).select(whole.columns).collect()))
    assert got == sorted(map(tuple, whole.collect())) and len(got) > 10
    late = [(0, 5000, at(60), "about Ann")]  # hours behind: dropped, where the join of the tables would have it
    spark.createDataFrame(late, kinds[0]).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    streams = (spark.readStream.schema(kind).parquet(str(tmp_path / name)) for name, kind in zip("tc", kinds))
    drained(spark, guard.affected(*streams, "20 minutes", "10 minutes"), out, mark)
    assert spark.read.parquet(out).where("doc_id = 5000").count() == 0
