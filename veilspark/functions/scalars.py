"""Validators and small functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import HIGH_RISK, RISK_HIGH, RISK_MEDIUM, RISK_NONE


def _chars(v: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(v), F.lit(1))), lambda i: F.substring(v, i, F.lit(1)))


def luhn_valid(v: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of 10; other characters don't count."""
    digits = F.regexp_replace(v, "[^0-9]", "")
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when((i - 1) % 2 == n % 2, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add)
    return n.between(13, 19) & (total % 10 == 0)


def iban_valid(v: Column) -> Column:
    """ISO 7064 MOD 97-10."""
    s = F.upper(F.regexp_replace(v, r"[\t-\r\x1c-\x20\x85\p{Z}]+", ""))
    turned = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.coalesce(s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{4,30}$") & (F.aggregate(_chars(turned), F.lit(0), step) == 1), F.lit(False))


def quoted_valid(v: Column, suffixes: str) -> Column:
    """A link, a file name, or one word of 4 to 64 characters with a letter and a digit."""
    word = ~v.contains(" ") & F.length(v).between(4, 64) & v.rlike("[A-Za-z]") & v.rlike("[0-9]")
    return v.rlike("(?i)^https?://") | v.rlike(rf"(?i)\.(?:{suffixes})$") | word


def contains_cjk(text: Column) -> Column:
    return text.rlike("[\\x{4e00}-\\x{9fff}]")


def is_code(text: Column) -> Column:
    """Three signs of program code or more."""
    from .patterns import CODE_SIGNAL

    return F.regexp_count(text, F.lit(CODE_SIGNAL)) >= 3


def clean_label(label: Column) -> Column:
    """Upper case, anything but A-Z and _ as _, none at the ends; SENSITIVE if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.upper(F.trim(F.coalesce(label, F.lit("")))), "[^A-Z_]", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lit("SENSITIVE")).otherwise(s)


def risk_of(labels: Column) -> Column:
    """Of an array of labels."""
    high = F.exists(labels, lambda x: F.upper(x).rlike("|".join(HIGH_RISK)))
    return F.when(F.size(labels) <= 0, RISK_NONE).when(high, RISK_HIGH).otherwise(RISK_MEDIUM)


def stripped(v: Column) -> Column:
    """Without white space at the ends, as Python's strip()."""
    return F.regexp_replace(v, r"^[\t-\r\x1c-\x20\x85\p{Z}]+|[\t-\r\x1c-\x20\x85\p{Z}]+$", "")


def is_candidate(v: Column) -> Column:
    """A cell to detect in: not blank and no formula."""
    return v.isNotNull() & (stripped(v) != "") & ~v.startswith("=")


def header_type(name: Column, rules: tuple | None = None) -> Column:
    from .patterns import HEADER_RULES

    h = stripped(F.coalesce(name, F.lit("")))
    return F.coalesce(*(F.when(h.rlike("(?iu)" + p), F.lit(label)) for p, label in rules or HEADER_RULES))


def cer_normalised(v: Column) -> Column:
    return F.translate(F.regexp_replace(v, "[ \\t]", ""), "：", ":")


def cer(reference: Column, found: Column) -> Column:
    """Edit distance over the reference's length; of an empty reference 0 if nothing was found, else 1."""
    r, f = cer_normalised(reference), cer_normalised(found)
    return F.when(F.length(r) == 0, F.when(F.length(f) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(r, f) / F.length(r))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    o = overlap(s1, e1, s2, e2)
    union = (e1 - s1) + (e2 - s2) - o
    return F.when(union > 0, o / union).otherwise(0.0)


def box_overlap(a: Column, b: Column) -> Column:
    """Shared area over the smaller one; a and b are structs with x0, y0, x1, y1."""
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    h = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    area = lambda x: F.greatest(F.lit(0.0), x.x1 - x.x0) * F.greatest(F.lit(0.0), x.y1 - x.y0)
    smaller = F.least(area(a), area(b))
    return F.when((w <= 0) | (h <= 0) | (smaller <= 0), 0.0).otherwise(w * h / smaller)


def tag(label: Column, n: Column) -> Column:
    return F.concat(F.lit("<"), label, F.lit("_"), n.cast("string"), F.lit(">"))
