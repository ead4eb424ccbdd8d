"""Detections held against gold answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import once

# Labels that count as equal.
ALIASES = {"PERSON_NAME": "PERSON", "PHONE_NUMBER": "PHONE", "TW_PHONE": "PHONE", "DATE_OF_BIRTH": "DATE", "DATE_TIME": "DATE", "BANK_NAME": "ORGANIZATION", "LOCATION": "ADDRESS"}


#: Characters of a document that answers and detections meet in.
STRETCH = 256


def alias(label: Column, table: dict[str, str] | None = None) -> Column:
    m = F.create_map(*(F.lit(x) for kv in (table or ALIASES).items() for x in kv))
    return F.coalesce(F.element_at(m, label), label)


def expected_positions(gold: DataFrame, articles: DataFrame) -> DataFrame:
    """gold(doc_id, ord, value, label) with start and end: the n-th time a value is asked for, the n-th place it has (places may
    overlap); the first once there are no more; null if it has none."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "value").orderBy("ord"))
    asked = gold.withColumn("nth", nth)
    wanted = asked.select("doc_id", "value").distinct().where("value <> ''").join(articles.select("doc_id", "text"), "doc_id")
    # cut before each place of the value, so that the pieces' lengths add up to the places: one pass over a text for a value
    quoted = F.concat(F.lit("(?=\\Q"), F.replace("value", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    pieces = wanted.select("doc_id", "value", F.startswith("text", "value").alias("leads"), F.posexplode(F.split("text", quoted, -1)).alias("pos", "piece"))
    before = Window.partitionBy("doc_id", "value").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    cuts = pieces.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0))).where((F.col("pos") > 0) | F.col("leads"))
    places = cuts.select("doc_id", "value", (F.col("pos") + F.col("leads").cast("int")).alias("nth"), "start")
    first = places.where("nth = 1").select("doc_id", "value", F.col("start").alias("first"))
    both = asked.join(places, ["doc_id", "value", "nth"], "left").join(first, ["doc_id", "value"], "left")
    start = F.coalesce("start", "first")
    return both.select("doc_id", "ord", "value", "label", start.alias("start"), (start + F.length("value")).alias("end"))


def _meeting(e: DataFrame, d: DataFrame) -> DataFrame:
    """e joined with d where their places share a character: es < de and ds < ee. Both are dealt to stretches of a document,
    so that no answer meets all detections; a pair counts in the stretch where it begins to overlap."""
    over = lambda t, s, z: t.where(F.col(s) < F.col(z)).withColumn("__at", F.explode(F.sequence(F.floor(F.col(s) / STRETCH), F.floor((F.col(z) - 1) / STRETCH))))
    met = over(e, "es", "ee").join(over(d, "ds", "de"), ["doc_id", "__at"]).where("es < de and ds < ee")
    return met.where(F.col("__at") == F.floor(F.greatest("es", "ds") / STRETCH)).drop("__at")


def pairs(expected: DataFrame, detected: DataFrame, exact: bool, by_label: bool) -> DataFrame:
    """doc_id, e, d: the ords of answers and detections that hit each other. Without places, by value."""
    e = expected.select("doc_id", F.col("ord").alias("e"), F.col("start").alias("es"), F.col("end").alias("ee"), F.trim("value").alias("ev"), alias(F.col("label")).alias("el"))
    d = detected.select("doc_id", F.col("ord").alias("d"), F.col("start").alias("ds"), F.col("end").alias("de"), F.trim("value").alias("dv"), alias(F.col("label")).alias("dl"))
    if exact:
        placed = e.join(d.withColumnsRenamed({"ds": "es", "de": "ee"}), ["doc_id", "es", "ee"])
    else:
        placed = _meeting(e, d)
    lost, dim = e.where("es is null"), d.where("ds is null")
    if exact:
        named = lost.join(dim.withColumnRenamed("dv", "ev"), ["doc_id", "ev"])
    else:
        within = (F.col("ev") != "") & (F.col("dv") != "") & (F.col("ev").contains(F.col("dv")) | F.col("dv").contains(F.col("ev")))
        named = lost.join(dim, "doc_id").where(within)
    hit = placed.select("doc_id", "e", "d", "el", "dl").unionByName(named.select("doc_id", "e", "d", "el", "dl"))
    return (hit.where("el = dl") if by_label else hit).select("doc_id", "e", "d")


def score(expected: DataFrame, detected: DataFrame, exact: bool, by_label: bool) -> DataFrame:
    """doc_id, tp, fp, fn: answers take detections in order, one each. Without `exact`, what overlaps anything is neither wrong nor missed."""
    hit = pairs(expected, detected, exact, by_label)
    per = hit.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("e", "d"))).alias("h"))
    taken = once(F.transform("h", lambda x: F.struct(x.e.cast("long").alias("e"), x.d.cast("long").alias("d"))))
    tp = per.select("doc_id", F.size(taken).alias("tp"), F.size(F.array_distinct(F.transform("h", lambda x: x.e))).alias("e_hit"), F.size(F.array_distinct(F.transform("h", lambda x: x.d))).alias("d_hit"))
    counts = expected.groupBy("doc_id").agg(F.count("*").alias("ne")).join(detected.groupBy("doc_id").agg(F.count("*").alias("nd")), "doc_id", "full_outer").join(tp, "doc_id", "left").na.fill(0)
    lost, wrong = ("tp", "tp") if exact else ("e_hit", "d_hit")
    return counts.select("doc_id", F.col("tp").cast("long").alias("tp"), (F.col("nd") - F.col(wrong)).alias("fp"), (F.col("ne") - F.col(lost)).alias("fn"))


def prf(counts: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 (null where undefined), over all rows or by columns."""
    t = counts.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return t.select(*by, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def greedy_match(expected: DataFrame, detected: DataFrame, by_label: bool = True) -> DataFrame:
    """doc_id, e, d: pairs of the largest overlap first, then of the best ratio, each answer and detection once."""
    e = expected.select("doc_id", F.col("ord").alias("e"), F.col("start").alias("es"), F.col("end").alias("ee"), alias(F.col("label")).alias("el"))
    d = detected.select("doc_id", F.col("ord").alias("d"), F.col("start").alias("ds"), F.col("end").alias("de"), alias(F.col("label")).alias("dl"))
    meet = _meeting(e, d)
    meet = meet.where("el = dl") if by_label else meet
    over = F.least("ee", "de") - F.greatest("es", "ds")
    ratio = over / (F.greatest("ee", "de") - F.least("es", "ds"))
    per = meet.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(over.alias("o"), ratio.alias("r"), "e", "d")), asc=False).alias("h"))
    taken = once(F.transform("h", lambda x: F.struct(x.e.cast("long").alias("e"), x.d.cast("long").alias("d"))))
    return per.select("doc_id", F.inline(taken))


def located(gold: DataFrame, articles: DataFrame) -> DataFrame:
    """doc_id, ord, value, label, start, end: each answer is looked for after the end of the one before, then from the top."""
    schema = "doc_id long, ord long, value string, label string, start long, end long"
    per = gold.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "value", "label"))).alias("g")).join(articles.select("doc_id", "text"), "doc_id")

    def run(frames):
        for f in frames:
            out = []
            for doc_id, answers, text in f[["doc_id", "g", "text"]].itertuples(index=False):
                cursor = 0
                for g in answers:
                    at = text.find(g["value"], cursor)
                    at = text.find(g["value"]) if at < 0 else at
                    if at >= 0:
                        cursor = at + len(g["value"])
                    out.append((doc_id, g["ord"], g["value"], g["label"], at if at >= 0 else None, at + len(g["value"]) if at >= 0 else None))
            yield pd.DataFrame(out, columns=["doc_id", "ord", "value", "label", "start", "end"]).astype({"start": "Int64", "end": "Int64"})

    return per.mapInPandas(run, schema)


def char_confusion(gold: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, status, n: characters that are correct, wrong_label, missed or false_positive. A later span wins a character."""
    chars = lambda t, name: t.select("doc_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("i"), "ord", alias(F.col("label")).alias("l")).groupBy("doc_id", "i").agg(F.max_by("l", "ord").alias(name))
    both = chars(gold.where("start < end"), "g").join(chars(found.where("start < end"), "p"), ["doc_id", "i"], "full_outer")
    status = F.when(F.col("p").isNull(), "missed").when(F.col("g").isNull(), "false_positive").when(F.col("g") == F.col("p"), "correct").otherwise("wrong_label")
    return both.select("doc_id", status.alias("status")).groupBy("doc_id", "status").agg(F.count("*").alias("n"))


def ablation(runs: DataFrame) -> DataFrame:
    """runs(config, ord, tp, fp, fn) with precision, recall, f1 and delta, the difference to the first configuration."""
    scored = prf(runs, "config", "ord")
    return scored.withColumn("delta", F.col("f1") - F.first("f1").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))  # a row a configuration


def gained_lost(base: DataFrame, other: DataFrame) -> DataFrame:
    """change and the rows of two result sets that only one holds."""
    return other.exceptAll(base).withColumn("change", F.lit("gained")).unionByName(base.exceptAll(other).withColumn("change", F.lit("lost")))


def average_cer(cases: DataFrame) -> DataFrame:
    """average_cer of cases(cer)."""
    return cases.agg(F.avg("cer").alias("average_cer"))


def by_scale(cases: DataFrame, labels: list[str]) -> DataFrame:
    """label, and PASS or MISS at each scale, of cases(scale, detected array<string>): found in any case of that scale."""
    wanted = cases.select("scale", F.explode(F.array(*map(F.lit, labels))).alias("label"), "detected")
    met = F.when(F.max(F.array_contains("detected", F.col("label")).cast("int")) > 0, "PASS").otherwise("MISS")
    return wanted.groupBy("label").pivot("scale").agg(met)


def recall_matrix(cases: DataFrame, labels: list[str]) -> DataFrame:
    """case, and PASS or MISS for each label, of cases(case, detected array<string>)."""
    return cases.select("case", *(F.when(F.array_contains("detected", x), "PASS").otherwise("MISS").alias(x) for x in labels), F.array_except(F.array(*map(F.lit, labels)), "detected").alias("missing"))
