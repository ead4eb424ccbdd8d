"""Governance lists: sensitive, blocked and safe values, as tables that each operation returns anew.

items(value, label, count, first_seen, last_seen, sources, origin, label_source) · blocked(value, label, count, blocked_at)
· safe(value, note, added_at). `now` is a parameter, so that a run can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import AUTO_MIN, KEPT_SOURCES, MANUAL_MIN
from ..functions.patterns import CODE_RULES
from ..functions.scalars import clean_label, contains_cjk, stripped
from ..functions.spans import detect_rules, detect_text, no_spans

# What the results of adding a value say.
LEFT_BLOCKED, LEFT_SAFE, EXISTS, NEW, SKIPPED = "已從黑名單移出", "已從安全清單移出", "已存在", "新增", "略過"
TOO_SHORT = f"太短 (至少 {MANUAL_MIN} 個字)"

ITEMS = "value string, label string, count long, first_seen timestamp, last_seen timestamp, sources array<string>, origin string, label_source string"
BLOCKED = "value string, label string, count long, blocked_at timestamp"
SAFE = "value string, note string, added_at timestamp"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def newest_first(table: DataFrame, column: str) -> DataFrame:
    return table.orderBy(F.col(column).desc(), "value")


def searched(items: DataFrame, words: str) -> DataFrame:
    """Items whose value or label holds the words, without regard to case."""
    f = words.lower()
    return items.where(F.lower("value").contains(f) | F.lower("label").contains(f))


def without(table: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows whose value is in none of the other tables."""
    for o in others:
        table = table.join(o.select("value").distinct(), "value", "left_anti")
    return table


def is_blocked(values: DataFrame, blocked: DataFrame) -> DataFrame:
    """values with blocked: whether the value is on the list."""
    return values.join(blocked.select("value", F.lit(True).alias("blocked")).distinct(), "value", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))


def _upsert(items: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """new: value, label, count, sources. Counts add up, the first label stays, the last five sources are kept."""
    both = items.alias("o").join(new.alias("n"), "value", "full_outer")
    sources = F.array_distinct(F.concat(F.coalesce("o.sources", F.array().cast("array<string>")), F.coalesce("n.sources", F.array().cast("array<string>"))))
    met = F.col("n.count").isNotNull()
    return both.select(
        "value",
        F.coalesce("o.label", "n.label").alias("label"),
        (F.coalesce("o.count", F.lit(0)) + F.coalesce("n.count", F.lit(0))).cast("long").alias("count"),
        F.coalesce("o.first_seen", now).alias("first_seen"),
        F.when(met, now).otherwise(F.col("o.last_seen")).alias("last_seen"),
        F.when(F.size(sources) > KEPT_SOURCES, F.slice(sources, -KEPT_SOURCES, KEPT_SOURCES)).otherwise(sources).alias("sources"),
        F.coalesce("o.origin", F.lit("auto")).alias("origin"),
        F.coalesce("o.label_source", F.lit("")).alias("label_source"),
    )


def record(items: DataFrame, entries: DataFrame, blocked: DataFrame, safe: DataFrame, now: Column, distinct_by_source: bool = False) -> DataFrame:
    """items with detected entries(value, label, source, ord): each counts once, or once a source (tables)."""
    good = without(entries.withColumn("value", stripped(F.col("value"))).where(F.length("value") >= AUTO_MIN), blocked, safe)
    if distinct_by_source:
        good = good.groupBy("value", "source").agg(F.min_by("label", "ord").alias("label"), F.min("ord").alias("ord"))
    by_source = good.groupBy("value", "source").agg(F.count("*").alias("n"), F.max("ord").alias("last"), F.min(F.struct("ord", "label")).alias("f"))
    counts = by_source.groupBy("value").agg(F.sum("n").alias("count"), F.min("f").getField("label").alias("label"))
    # only the sources seen last are carried on, at most as many as are kept
    latest = Window.partitionBy("value").orderBy(F.desc("last"), F.desc("source"))
    few = by_source.select("value", "last", "source").withColumn("k", F.row_number().over(latest)).where(F.col("k") <= KEPT_SOURCES)
    sources = few.groupBy("value").agg(F.transform(F.array_sort(F.collect_list(F.struct("last", "source"))), lambda x: x.source).alias("sources"))
    return _upsert(items, counts.join(sources, "value").select("value", "label", "count", "sources"), now)


def classified(values: DataFrame) -> DataFrame:
    """values(value) with label and how: the rule that best covers a value alone, then in program code, then in carrier
    sentences; SENSITIVE if none does. A match counts if it covers 60 % of the value and is not much longer; rules come
    before models, then what covers most."""
    v = stripped(F.col("value"))
    zh = contains_cjk(v)
    # Sentences in which a model sees a value in context.
    carriers = ((("聯絡人是", "，請盡快回覆。"), ("Please contact ", " for details.")), (("資料如下：", "。"), ("Details: ", ".")))
    text = lambda lead, t, code=False: F.struct(lead.alias("lead"), t.alias("t"), F.lit(code).alias("code"))
    texts = [text(F.lit(""), v), text(F.lit(""), v, True)]
    for (za, zb), (ea, eb) in carriers:
        texts.append(text(F.when(zh, za).otherwise(ea), F.when(zh, F.concat(F.lit(za), v, F.lit(zb))).otherwise(F.concat(F.lit(ea), v, F.lit(eb)))))

    def picked(lead: Column, spans: Column) -> Column:
        start, size = F.length(lead), F.greatest(F.length(v), F.lit(1))
        cover = lambda m: F.greatest(F.lit(0), F.least(m.end, start + size) - F.greatest(m.start, start)) / size
        fits = F.filter(spans, lambda m: (cover(m) >= 0.6) & (m.end - m.start <= size * 1.5 + 2))
        tier = lambda m: F.when(m.source == "regex", 0).when((m.source == "zh") == zh, 1).otherwise(2)
        best = F.array_min(F.transform(fits, lambda m, i: F.struct(tier(m).alias("t"), (-cover(m)).alias("c"), (-F.coalesce(m.score, F.lit(0.0))).alias("s"), i.alias("i"), m.label.alias("label"))))
        return best.label

    spans = lambda x: F.concat(F.when(x.code, detect_rules(x.t, CODE_RULES)).otherwise(no_spans()), detect_text(x.t))
    # one after another, and only until one has a label
    found = F.aggregate(F.array(*texts), F.lit(None).cast("string"), lambda label, x: F.coalesce(label, picked(x["lead"], spans(x))))
    return values.withColumn("label", clean_label(found)).withColumn("how", F.when(found.isNull(), "default").otherwise("rule"))


def add_manual(items: DataFrame, blocked: DataFrame, safe: DataFrame, wanted: DataFrame, source: str, now: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(items, blocked, safe, results) after a user adds wanted(ord, value, label or null). Values leave the other lists;
    an item's label changes only if the user gives one or it had none. results: value, label, status, note."""
    clean = wanted.withColumn("value", stripped(F.coalesce("value", F.lit(""))))
    short = clean.where(F.length("value") < MANUAL_MIN)
    once = clean.where(F.length("value") >= MANUAL_MIN).groupBy("value").agg(F.min(F.struct("ord", "label")).alias("f")).select("value", "f.ord", "f.label")
    given = F.coalesce(F.col("label"), F.lit("")) != ""
    known = once.where(~given).select("ord", "value")
    told = once.where(given).withColumn("label", clean_label(F.col("label"))).withColumn("how", F.lit("user"))
    new = told.select("ord", "value", "label", "how").unionByName(classified(known).select("ord", "value", "label", "how"))
    was = lambda t, name: t.select("value", F.lit(True).alias(name)).distinct()
    joined = new.join(items.select("value", F.col("label").alias("old"), F.lit(True).alias("exists")), "value", "left").join(was(blocked, "b"), "value", "left").join(was(safe, "s"), "value", "left")
    change = (F.col("how") == "user") | F.coalesce(F.col("old"), F.lit("")).isin("", "SENSITIVE")
    final = joined.withColumn("final", F.when(F.col("exists"), F.when(change, F.col("label")).otherwise(F.col("old"))).otherwise(F.col("label")))
    note = F.concat_ws("；", F.when(F.col("b"), LEFT_BLOCKED), F.when(F.col("s"), LEFT_SAFE))
    results = final.select("ord", "value", F.col("final").alias("label"), F.when(F.col("exists"), EXISTS).otherwise(NEW).alias("status"), note.alias("note"))
    results = results.unionByName(short.select("ord", "value", F.lit("").alias("label"), F.lit(SKIPPED).alias("status"), F.lit(TOO_SHORT).alias("note")))
    kept_label = items.join(final.where("exists").select("value", "final", "how", change.alias("change")), "value", "left")
    old = kept_label.select(
        "value", F.when(F.col("final").isNotNull(), F.col("final")).otherwise(F.col("label")).alias("label"), "count", "first_seen",
        F.when(F.col("final").isNotNull(), now).otherwise(F.col("last_seen")).alias("last_seen"), "sources",
        F.when(F.col("final").isNotNull(), F.lit("manual")).otherwise(F.col("origin")).alias("origin"),
        F.when(F.col("change"), F.col("how")).otherwise(F.col("label_source")).alias("label_source"),
    )
    fresh = final.where("exists is null").select("value", F.col("final").alias("label"), F.lit(1).cast("long").alias("count"), now.alias("first_seen"), now.alias("last_seen"), F.array(F.lit(source)).alias("sources"), F.lit("manual").alias("origin"), F.col("how").alias("label_source"))
    return old.unionByName(fresh), without(blocked, new), without(safe, new), results.orderBy("ord")


def block(items: DataFrame, blocked: DataFrame, values: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(items, blocked): values move to the blocked list with their label and count."""
    moved = values.select("value").distinct().join(items.select("value", "label", "count"), "value", "left").select("value", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("count", F.lit(0)).cast("long").alias("count"), now.alias("blocked_at"))
    return without(items, values), without(blocked, values).unionByName(moved)


remove = block


def mark_safe(items: DataFrame, safe: DataFrame, values: DataFrame, note: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(items, safe): values move to the safe list."""
    moved = values.select(stripped(F.col("value")).alias("value")).where("value <> ''").distinct().select("value", F.lit(note).alias("note"), now.alias("added_at"))
    return without(items, moved), without(safe, moved).unionByName(moved)


def released(table: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table without the values, the rows that went): taking values off the blocked or the safe list."""
    return without(table, values), table.join(values.select("value").distinct(), "value", "left_semi")
