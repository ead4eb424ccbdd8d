"""Dictionaries of any size against one alternation, and overlaps against a plain quadratic loop."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from veilspark.config import EngineConfig
from veilspark.functions.intervals import distinct, merged, once
from veilspark.operators.detect import detect
from veilspark.operators.dictionary import with_dictionary

SPANS = "array<struct<start:int,end:int,label:string,score:double,source:string>>"


def pattern(values):
    """All values as one pattern, the longest first, with borders where they begin or end with a letter or digit."""
    edge = lambda c: c.isascii() and c.isalnum()
    parts = [("(?<![A-Za-z0-9])" if edge(v[0]) else "") + re.escape(v) + ("(?![A-Za-z0-9])" if edge(v[-1]) else "") for v in sorted(values, key=len, reverse=True)]
    return re.compile("|".join(parts)) if parts else re.compile("(?!)")


def by_pattern(text, values, per_label, least=1):
    held = {(x or "SENSITIVE", v) for x, v in values if v and len(v) >= least}
    if per_label:
        return [(m.start(), m.end(), x) for x in sorted({x for x, _ in held}) for m in pattern([v for y, v in held if y == x]).finditer(text or "")]
    label = {v: min(x for x, w in held if w == v) for _, v in held}
    return [(m.start(), m.end(), label[m[0]]) for m in pattern(list(label)).finditer(text or "")]


def dictionary(n, rng):
    out = [("A", "ab"), ("B", "ab"), (None, "bc "), ("A", None), (None, None), ("A", ""), ("Z", "abc"), ("A", "abc"), ("C", "x-y"), ("C", "-y-"), ("D", "王小明"), ("E", "小明 "), ("A", "ab"), ("C", "😀a"), ("B", "c.d")][: max(1, n)]
    return out + [(rng.choice("ABC"), "".join(rng.choice("abcdef -.王") for _ in range(rng.randrange(1, 9)))) for _ in range(n - len(out))]


def texts_of(rng):
    out = [None, "", "ab", "xab ab-abc", "x-y-y-", "王小明 ab 小明 😀abc.d", "aab abcab ab"]
    return out + ["".join(rng.choice("abcdef  -.王x0") for _ in range(rng.randrange(0, 400))) for _ in range(40)]


@pytest.mark.parametrize(("n", "size"), [(1, None), (15, None), (300, None), (300, 150), (15, 4)])
@pytest.mark.parametrize("per_label", [True, False])
def test_equal_to_the_pattern(spark, n, size, per_label):
    rng = random.Random(n)
    values, texts = dictionary(n, rng), texts_of(rng)
    docs = spark.createDataFrame([(7, t, "extra") for t in texts], "doc_id long, text string, labels string")
    found = with_dictionary(docs, spark.createDataFrame(values, "label string, value string"), "s", per_label, least=1, size=size)
    assert found.columns == ["doc_id", "text", "labels", "s"]
    got = sorted(((r["text"] or "", [tuple(m)[:3] for m in r["s"]]) for r in found.collect()), key=str)
    assert got == sorted(((t or "", by_pattern(t, values, per_label)) for t in texts), key=str)


def test_a_hundred_thousand_values(spark):
    """Texts made of the values: those between letters are none."""
    rng = random.Random(1)
    values = list({f"{rng.choice(['Ann', 'Bo', 'Ça', '李'])} {rng.randrange(10**6)}{rng.choice(['', '.', '号'])}" for _ in range(100_000)})
    texts = [" ".join(rng.choice(values) + rng.choice(["", "", "x", ","]) for _ in range(60)) for _ in range(30)]
    held = set(values)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    frame = spark.createDataFrame([("P", v) for v in values], "label string, value string")
    want = {}
    for t in texts:  # by the longest value that stands at a place, from left to right
        at, out = 0, []
        while at < len(t):
            for n in range(min(16, len(t) - at), 0, -1):
                v = t[at : at + n]
                if v in held and not (at and t[at - 1].isascii() and t[at - 1].isalnum() and v[0].isascii()) and not (v[-1].isascii() and v[-1].isalnum() and t[at + n : at + n + 1].isascii() and t[at + n : at + n + 1].isalnum()):
                    out.append((at, at + n))
                    at += n - 1
                    break
            at += 1
        want[t] = out
    for size in (None, 400_000):
        got = {r["text"]: [(m["start"], m["end"]) for m in r["s"]] for r in with_dictionary(docs, frame, "s", False, size=size).collect()}
        assert got == want and sum(map(len, want.values())) > 500


@pytest.mark.parametrize("order", [1, -1])
def test_one_rule_for_two_labels(spark, order):
    """A value of two labels has the smallest, in whatever order they are listed and however many values there are."""
    rows = [("ZZZ", "Ann Lee"), ("AAA", "Ann Lee")][::order]
    for more in (0, 3000):
        values = spark.createDataFrame(rows + [("M", f"other {i}") for i in range(more)], "label string, value string")
        found = detect(spark.createDataFrame([(1, "for Ann Lee today")], "doc_id long, text string"), EngineConfig(), sensitive=values)
        assert [(m["start"], m["end"], m["label"]) for m in found.first()["spans"]] == [(4, 11, "AAA")]


def plain_merge(spans, zh):
    tier = lambda s: 0 if s == "regex" else 3 if s not in ("zh", "en") else 1 if zh is not None and (s == "zh") == zh else 2
    kept = []
    for m in sorted(spans, key=lambda m: (tier(m[4]), m[0] - m[1], -(m[3] or 0))):
        if not any(m[0] < k[1] and k[0] < m[1] for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: m[:2])


def test_overlaps(spark):
    rng = random.Random(4)
    rows = [(None, True), ([], False)]
    for i in range(150):
        n, width = rng.randrange(0, 60), rng.choice([30, 200, 3000])
        made = [(s := rng.randrange(width), s + rng.randrange(1, 25), rng.choice("PQ"), rng.choice([None, 0.5, 0.9]), rng.choice(["regex", "zh", "en", "field", None])) for _ in range(n)]
        rows.append((made + made[: n // 3], rng.choice([True, False, None])))
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, s {SPANS}, zh boolean").repartition(3)
    for r in frame.select("i", merged(F.col("s"), F.col("zh")).alias("m"), distinct(F.col("s")).alias("d")).collect():
        spans, zh = rows[r["i"]]
        assert (r["m"], r["d"]) == (None, None) if spans is None else ([tuple(m) for m in r["m"]] == plain_merge(spans, zh) and [tuple(m) for m in r["d"]] == list(dict.fromkeys(spans)))


def test_pairs_once(spark):
    rng = random.Random(2)
    rows = [[(rng.randrange(9), rng.randrange(9)) for _ in range(rng.randrange(30))] for _ in range(40)]
    frame = spark.createDataFrame([(i, sorted(r)) for i, r in enumerate(rows)], "i int, h array<struct<e:bigint,d:bigint>>")
    for r in frame.select("i", once(F.col("h")).alias("k")).collect():
        kept = []
        for e, d in sorted(rows[r["i"]]):
            if all(e != x and d != y for x, y in kept):
                kept.append((e, d))
        assert [tuple(x) for x in r["k"]] == kept


def test_a_hundred_thousand_hits_in_one_text(spark):
    """Far from quadratic: a text of 100,000 addresses among texts without any."""
    text = " ".join(f"ann{i}@example.org" for i in range(100_000))
    docs = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "doc_id long, text string")
    began = time.time()
    found = detect(docs).select("doc_id", F.size("spans").alias("n"), F.size("candidates").alias("c"), F.try_element_at("spans", F.lit(-1)).alias("last")).collect()
    assert time.time() - began < 60
    assert {r["doc_id"]: r["n"] for r in found} == {1: 100_000, 2: 0, 3: 0}
    [last] = [r["last"] for r in found if r["doc_id"] == 1]
    assert (last["end"], last["label"]) == (len(text), "EMAIL")


def test_one_cluster_of_many_spans(spark):
    """Spans that all overlap in a chain under one long span of a lower tier."""
    n = 60_000
    spans = F.concat(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 2).alias("start"), (i * 2 + 3).alias("end"), F.lit("L").alias("label"), F.lit(None).cast("double").alias("score"), F.lit("regex").alias("source"))), F.array(F.struct(F.lit(0).alias("start"), F.lit(3 * n).alias("end"), F.lit("M").alias("label"), F.lit(0.5).alias("score"), F.lit("en").alias("source"))))
    began = time.time()
    got = spark.range(1).select(merged(spans, F.lit(False)).alias("m")).select(F.size("m"), F.element_at("m", -1)["start"]).first()
    assert tuple(got) == (n // 2, 2 * n - 4) and time.time() - began < 30
