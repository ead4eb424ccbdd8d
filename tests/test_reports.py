"""Sketches of batches: merged they are those of one run, and near the exact counts."""

import random
from collections import defaultdict

from veilspark.operators import reports

SPANS = "label string, source string, risk string, value string"


def test_two_days_equal_one_run(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice(["EMAIL", "URL", None]), rng.choice("ab"), rng.choice(["high", "none"]), rng.choice([None, "v" * rng.randrange(1, 40) + str(rng.randrange(8_000))])) for _ in range(30_000)]
    days = [spark.createDataFrame(rows[:11_000], SPANS), spark.createDataFrame(rows[11_000:], SPANS)]
    path = str(tmp_path / "sketches")
    for name, day in zip(("mon", "tue"), days):
        reports.fold(day, path, name)
    reports.fold(days[1], path, "tue")  # again: it replaces
    got = {(r["label"], r["source"], r["risk"], r["level"]): r for r in reports.merged_report(reports.folded(spark, path)).collect()}
    one = {(r["label"], r["source"], r["risk"], r["level"]): r for r in reports.merged_report(reports.sketched(spark.createDataFrame(rows, SPANS))).collect()}
    exact = defaultdict(list)
    for label, source, risk, value in rows:
        for level in range(8):
            exact[label if not level & 4 else None, source if not level & 2 else None, risk if not level & 1 else None, level].append(value)
    assert set(got) == set(one) == set(exact)
    for key, values in exact.items():
        held = [v for v in values if v is not None]
        distinct = len(set(held))
        assert got[key]["n"] == one[key]["n"] == len(values)
        assert abs(got[key]["n_values"] - distinct) <= 0.06 * distinct + 2 and abs(one[key]["n_values"] - distinct) <= 0.06 * distinct + 2
        for share in (50, 90):
            below = sum(len(v) <= got[key][f"length_{share}"] for v in held) / len(held)
            above = sum(len(v) >= got[key][f"length_{share}"] for v in held) / len(held)
            assert below >= share / 100 - 0.04 and above >= 1 - share / 100 - 0.04


def test_an_empty_batch(spark):
    none = spark.createDataFrame([], SPANS)
    assert reports.merged_report(reports.sketched(none)).where("level < 7").count() == 0
