"""Detection over a table of texts: the flagship plan.

documents(doc_id, text, ...) gets is_code, and spans: rules and dictionaries, joined from normalised and raw text, without
safe values and overlaps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import KNOWN_MIN, EngineConfig
from ..functions import normalize
from ..functions.intervals import SPANS, distinct, merged
from ..functions.patterns import CODE_RULES, TEXT_RULES
from ..functions.scalars import contains_cjk, is_code, stripped
from ..functions.spans import detect_rules, no_spans
from ..session import batched, kept, settled, spread
from .dictionary import with_dictionary

#: Named classifiers of text as code; add one to use it by name.
CLASSIFIERS: dict[str, Callable[[Column], Column]] = {"heuristic": is_code}
#: Models by language: functions of a text column that return spans of source "en" or "zh". None is installed here.
MODELS: dict[str, Callable[[Column], Column]] = {}
# What the models' labels become or are dropped for.
ZH_LABELS = {"name": "PERSON", "address": "ADDRESS", "company": "ORGANIZATION", "government": "ORGANIZATION", "organization": "ORGANIZATION", "position": "POSITION"}
EN_GENERAL, EN_EXCLUDED, ZH_LEAST, ZH_CHUNK, ZH_OVERLAP = ("PERSON", "ORGANIZATION", "LOCATION"), ("US_DRIVER_LICENSE",), 0.7, 350, 50


def classified(docs: DataFrame, classifier: str = "heuristic") -> DataFrame:
    return docs if "is_code" in docs.columns else docs.withColumn("is_code", F.coalesce(CLASSIFIERS[classifier](F.col("text")), F.lit(False)))


def zh_chunks(text: Column) -> Column:
    """array<struct<offset, text>>: stretches of 350 characters, each sharing 50 with the next, as the model can take."""
    step = ZH_CHUNK - ZH_OVERLAP
    last = F.greatest(F.lit(0), F.floor((F.length(text) - 1) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * step).alias("offset"), F.substring(text, k * step + 1, F.lit(ZH_CHUNK)).alias("text")))


def zh_spans(raw: Column) -> Column:
    """A model's raw spans: known labels at a score of 0.7 or more, rounded; of equal ones the surest; by place."""
    table = F.create_map(*(F.lit(x) for kv in ZH_LABELS.items() for x in kv))
    named = F.transform(raw, lambda m: F.struct(m.start, m.end, F.element_at(table, m.label), F.round(m.score, 2), F.lit("zh")).cast("struct<start:int,end:int,label:string,score:double,source:string>"))
    good = F.filter(named, lambda m: m.label.isNotNull() & (m.score >= ZH_LEAST))
    best = lambda k, x: F.exists(k, lambda y: (y.start == x.start) & (y.end == x.end) & (y.label == x.label))
    by_score = F.array_sort(F.transform(good, lambda m, i: F.struct((-m.score).alias("s"), i.alias("i"), m.alias("m"))))
    return F.array_sort(F.aggregate(by_score, no_spans(), lambda k, x: F.when(best(k, x.m), k).otherwise(F.concat(k, F.array(x.m)))))


def model_spans(text: Column, code: Column) -> Column:
    """What the installed models find: the English one's general labels not in Chinese text, none of it in code; the Chinese one's persons only in code."""
    en = MODELS["en"](text) if "en" in MODELS else no_spans()
    zh = MODELS["zh"](text) if "zh" in MODELS else no_spans()
    en = F.filter(en, lambda m: ~m.label.isin(*EN_EXCLUDED) & ~(contains_cjk(text) & m.label.isin(*EN_GENERAL)))
    return F.when(code, F.filter(zh, lambda m: m.label == "PERSON")).when(contains_cjk(text), F.concat(en, zh)).otherwise(en)


def detected(text: Column, code: Column, config: EngineConfig) -> Column:
    """Code rules where the text is code, text rules, models and further detectors, in this order."""
    code_rules = CODE_RULES if config.code_rules is None else config.code_rules
    text_rules = TEXT_RULES if config.text_rules is None else config.text_rules
    return F.concat(F.when(code, detect_rules(text, code_rules)).otherwise(no_spans()), detect_rules(text, text_rules), model_spans(text, code), *(d(text, code) for d in config.detectors))


def detect(docs: DataFrame, config: EngineConfig | None = None, known: DataFrame | None = None, sensitive: DataFrame | None = None, safe: DataFrame | None = None, overlay: bool = False, wanted: Column | None = None) -> DataFrame:
    """docs with is_code, candidates (all spans found) and spans (what stays). known and sensitive: (label, value); safe: (value).

    overlay: rules and models are merged first, and what lists find is laid over the rest, where it may overlap it.
    wanted: rows that are to stay without any span. Others may go, and without lists they go before they are sent to Python: Spark holds
    the whole of a row that is there, however little of it was sent, and so the more of them the less they send. None: all rows stay.
    """
    config = config or EngineConfig()
    docs = classified(spread(batched(docs), config.partitions))
    text, code = F.col("text"), F.col("is_code")
    early = wanted is not None and known is None and (sensitive is None or not config.use_known_items)
    if config.normalise:
        change = F.coalesce(normalize.may_change(text, code, config), F.lit(False)) if not config.whitespace else F.lit(True)
        # one pass: only texts that may change are sent to Python, nulls for the rest
        docs = docs.withColumn("__change", change)
        rules = F.coalesce(detected(F.col("__text") if early else F.when(F.col("__change"), F.col("__norm.text")).otherwise(text), code, config), no_spans())
        if early:
            docs = settled(docs.withColumn("__text", F.when(~F.col("__change"), text)), "__plain", rules)
            docs = docs.where(F.col("__change") | (F.size("__plain") > 0) | wanted)
        docs = settled(docs, "__norm", F.when(F.col("__change"), normalize.normalised(F.when(F.col("__change"), text), code, config)))
        if early:
            docs = settled(docs.withColumn("__text", F.col("__norm.text")), "__raw", F.when(F.col("__change"), rules).otherwise(F.col("__plain")))
            docs = docs.where((F.size("__raw") > 0) | wanted).drop("__text", "__plain")
        else:
            docs = settled(docs, "__raw", rules)
        back = F.when(F.col("__change"), F.coalesce(normalize.spans_to_original(F.col("__norm"), F.col("__raw")), no_spans())).otherwise(F.col("__raw"))
        docs = docs.withColumn("__found", back).drop("__raw", "__change")
    else:
        docs = settled(docs, "__found", F.coalesce(detected(text, code, config), no_spans()))
        docs = docs.where((F.size("__found") > 0) | wanted) if early else docs
    docs = with_dictionary(docs, known, "__known", True)
    if config.normalise and known is not None:  # also as the normalised text has them, but in code
        docs = with_dictionary(docs, known, "__inner", True, F.when(~code, F.col("__norm.text")))
        inside = F.coalesce(normalize.spans_to_original(F.col("__norm"), F.col("__inner")), no_spans())
        docs = docs.withColumn("__known", F.concat(inside, "__known")).drop("__inner")
    docs = docs.drop("__norm")
    docs = with_dictionary(docs, sensitive if config.use_known_items else None, "__listed", False, least=KNOWN_MIN)
    zh = F.coalesce(contains_cjk(text), F.lit(False))
    found = merged(F.col("__found"), zh) if overlay else F.col("__found")
    docs = docs.withColumn("candidates", distinct(F.concat(found, "__known", "__listed")))
    docs = without_safe(docs, safe)
    return docs.withColumn("spans", F.col("__unsafe") if overlay else merged(F.col("__unsafe"), zh)).drop("__found", "__known", "__listed", "__unsafe")


def without_safe(docs: DataFrame, safe: DataFrame | None) -> DataFrame:
    """__unsafe: candidates whose stripped text is no safe value, by an anti-join on the value."""
    if safe is None:
        return docs.withColumn("__unsafe", F.col("candidates"))
    placed = kept(docs.withColumn("__row", F.monotonically_increasing_id()))
    each = placed.select("__row", "text", F.posexplode_outer("candidates").alias("__i", "m")).where("m is not null")
    value = stripped(F.substring("text", F.col("m.start") + 1, F.col("m.end") - F.col("m.start")))
    left = each.withColumn("value", value).join(safe.select("value").distinct(), "value", "left_anti")
    back = left.groupBy("__row").agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "m"))), lambda x: x.m).cast(SPANS).alias("__unsafe"))
    return placed.join(back, "__row", "left").withColumn("__unsafe", F.coalesce("__unsafe", no_spans())).drop("__row")


def long_spans(found: DataFrame) -> DataFrame:
    """A row for each span: doc_id, start, end, label, score, source, value, and nth (its number among the document's equal values)."""
    each = found.select("doc_id", "text", F.explode_outer("spans").alias("m")).where("m is not null").select("doc_id", "m.*", F.substring("text", F.col("m.start") + 1, F.col("m.end") - F.col("m.start")).alias("value"))
    return each.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "value").orderBy("start")))
