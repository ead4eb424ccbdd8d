"""merged_spans, label_rollup, rule_counts_by_label: what detection passes over, and that nothing is lost by it."""

import random
import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tests.test_detection import SAMPLES, SF
from veilspark.config import EngineConfig
from veilspark.functions import normalize, patterns
from veilspark.operators.detect import detect


def test_plain_characters_stay(spark):
    chars = [chr(i) for i in range(0x30000) if not 0xD800 <= i < 0xE000]
    plain = [c for c in chars if not re.search(normalize.UNPLAIN, c)]
    assert len(plain) > 30_000 and not [c for c in plain if re.search(normalize.INVISIBLE, c)]
    text = "".join(plain)
    assert normalize.Trail.of(text).changed(normalize._compatible(text)).text == text
    assert normalize.Trail.of("-".join(plain)).changed(normalize._compatible("-".join(plain))).text == "-".join(plain)
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(chars)], "i int, text string")
    found = {r["i"] for r in frame.where(F.col("text").rlike(normalize.UNPLAIN)).collect()}
    assert found == {i for i, c in enumerate(chars) if re.search(normalize.UNPLAIN, c)}


def test_only_texts_that_may_change_go_to_python(spark):
    texts = ["Grüße aus Köln — “schön”", "你好，世界。", "Αθηνα Россия かな 한글", "é", "，́", "ﬁ", "a\x0bb", "Ａ", "x­", "<b>", "&lt;", "a --> b"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r["c"] for r in rows.select(normalize.may_change(F.col("text"), F.lit(False)).alias("c")).collect()] == [False] * 3 + [True] * 9
    script = EngineConfig(chinese="s2t", chinese_pairs=("国", "國"))
    assert [r["c"] for r in rows.select(normalize.may_change(F.col("text"), F.lit(False), script).alias("c")).collect()] == [True] * 12


def test_a_text_is_normalised_once(spark):
    found = detect(spark.createDataFrame([(1, "a &amp; b")], "doc_id long, text string")).select("spans")
    plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert len(re.findall(r"(?:ArrowEvalPython|BatchEvalPython) \[run\(", plan)) == 1


def test_rules_miss_nothing_by_hints_and_digits():
    rng, found = random.Random(5), {}
    texts = [t for t in SAMPLES if t] + [r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    texts += ["x TWMD-1234567", "CGH-12345678-1234", "POL-TW-1234567", "CLM-1234-1234567", "統一編號 12345678", "健保投保序号 A1234567890", "+1 (123) 123-1234", "0912 345 678", "GB82 WEST 1234 5698 7654 32", "AKIA" + "B" * 16, "/a/b", "gho_" + "c" * 20, "١٢٣-٤٥-٦٧٨٩", "'https://a.b'", "1990年1月2日", "25.03°N, 121.56°E"]
    texts += [t[a : a + rng.randrange(1, 80)] for t in texts for a in (rng.randrange(max(1, len(t))) for _ in range(10))]
    for rule in (*patterns.TEXT_RULES, *patterns.CODE_RULES):
        for text in texts:
            if m := re.search(rule.pattern, text, re.I if rule.ignore_case else 0):
                found[rule.name] = found.get(rule.name, 0) + 1
                assert rule.hint is None or re.search(rule.hint, text), (rule.name, text)
                assert not rule.digit or re.search(r"\d", m[0]), (rule.name, text)
    assert len(found) >= 25, found


def test_digits_of_any_script_are_found(spark):
    """And a text without one is still searched by the rules that need none."""
    rows = spark.createDataFrame([(1, "no ١٢٣-٤٥-٦٧٨٩"), (2, "ann@example.org, REPORT.PDF, ABCDEFGH")], "doc_id long, text string")
    off = EngineConfig(normalise=False)
    assert {(r["doc_id"], m["label"]) for r in detect(rows, off).collect() for m in r["spans"]} == {(1, "US_SSN"), (2, "EMAIL"), (2, "FILE_NAME"), (2, "SWIFT_CODE")}
