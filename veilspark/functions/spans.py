"""Spans: where rules match, and texts rewritten at spans. Which of overlapping ones stay: see intervals.

Explode arrays of spans with the _outer forms and drop nulls after: Spark puts a filter on the array under a plain explode,
which would run every rule again.

A span is struct<start int, end int, label string, score double, source string>, half-open, in characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .intervals import SPAN, SPANS
from .patterns import CODE_RULES, TEXT_RULES, Rule, to_java

#: Matches of a text whose places are run up in one array.
BLOCK = 256
DIGIT = to_java(r"\d")


def no_spans() -> Column:
    return F.array().cast(SPANS)


def span(start: Column, end: Column, label: Column, score: Column | None = None, source: str = "regex") -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), label.alias("label"), (F.lit(None) if score is None else score).cast("double").alias("score"), F.lit(source).alias("source")).cast(SPAN)


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _applied(function: str, value: Column, sql: str) -> Column:
    """A function of an array and a lambda in SQL: lambdas in lambdas take hundreds of calls to the JVM if they are built call by call."""
    return F.call_function(function, value, F.expr(sql))


_BLOCKS = f"sequence(1, greatest(size(p), 1), {BLOCK})"
_LENGTH = f"aggregate(slice(p, f, {BLOCK}), 0, (n, q) -> n + q.g + length(q.m))"
_BASES = f"aggregate({_BLOCKS}, array(0), (b, f) -> concat(b, array(element_at(b, -1) + {_LENGTH})))"
_NOTHING = "cast(array() AS array<struct<start:int,end:int,value:string>>)"
_STEP = "named_struct('at', b.at + q.g + length(q.m), 'out', concat(b.out, array(named_struct('start', b.at + q.g, 'end', b.at + q.g + length(q.m), 'value', q.m))))"
_BLOCK = f"aggregate(slice(p, f, {BLOCK}), named_struct('at', a, 'out', {_NOTHING}), (b, q) -> {_STEP}, b -> b.out)"
_PAIRS = "zip_with(slice(x.gaps, 1, size(x.found)), x.found, (g, m) -> named_struct('g', length(g), 'm', m))"
_PLACES = f"x -> get(transform(array({_PAIRS}), p -> flatten(zip_with({_BLOCKS}, slice({_BASES}, 1, size({_BLOCKS})), (f, a) -> {_BLOCK}))), 0)"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches: what lies between matches gives their places.

    Places are sums of lengths. They are run up in blocks of BLOCK matches, so that no array grows with all matches of a text.
    """
    held = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.get(_applied("transform", F.array(held), _PLACES), F.lit(0))


def rule_spans(text: Column, rule: Rule) -> Column:
    found = matches(text, rule.java)
    if rule.inner:
        found = _applied("transform", found, f"m -> named_struct('start', m.start + {rule.inner}, 'end', m.end - {rule.inner}, 'value', substring(m.value, {1 + rule.inner}, length(m.value) - {2 * rule.inner}))")
    if rule.validator is not None:
        found = F.filter(found, lambda m: rule.validator(m.value))
    named = F.transform(found, lambda m: F.struct(m.start, m.end, F.lit(rule.name), F.lit(None), F.lit("regex"))).cast(SPANS)
    return F.when(text.rlike(to_java(rule.hint) if rule.hint else rule.java), named).otherwise(no_spans())


def detect_rules(text: Column, rules: Iterable[Rule]) -> Column:
    """The spans of all rules, in their order. Texts without a digit, as most are, pass over the rules that need one."""

    def found(rules: list[Rule]) -> Column:
        return F.coalesce(F.concat(*(rule_spans(text, r) for r in rules)), no_spans()) if rules else no_spans()

    rules = list(rules)
    rest = [r for r in rules if not r.digit]
    return found(rules) if len(rest) == len(rules) else F.when(text.rlike(DIGIT), found(rules)).otherwise(found(rest))


def detect_text(text: Column) -> Column:
    return detect_rules(text, TEXT_RULES)


def detect_code(text: Column) -> Column:
    return detect_rules(text, (*CODE_RULES, *TEXT_RULES))


def rewritten(text: Column, pieces: Column) -> Column:
    """text with pieces (array<struct<start, end, tag>>, disjoint, by start) put in place."""

    def whole(pieces: Column) -> Column:
        before = lambda i: F.coalesce(F.get(pieces, i - 1).end, F.lit(0))
        parts = F.transform(pieces, lambda p, i: F.concat(F.substring(text, before(i) + 1, p.start - before(i)), p.tag))
        return F.concat(F.array_join(parts, ""), F.substr(text, before(F.size(pieces)) + 1))

    return _held(pieces, whole)
