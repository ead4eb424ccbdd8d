"""detect_spans(text): detection as a table function for SQL, a row for each span that stays.

    register(spark)
    SELECT doc_id, s.* FROM documents, LATERAL detect_spans(text) s

It gives what operators.detect.detect keeps under the rules of functions.patterns, without lists and models. Rules run in
Python here, a text at a time; on whole tables detect() is the faster way to the same rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..config import EngineConfig
from .intervals import disjoint
from .normalize import normalise_runs
from .patterns import CODE_RULES, CODE_SIGNAL, FILE_SUFFIXES, TEXT_RULES

SCHEMA = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("value", T.StringType())])


def _luhn(value: str) -> bool:
    digits = [int(c) for c in reversed(value) if c in "0123456789"]
    return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def _iban(value: str) -> bool:
    s = re.sub(r"\s+", "", value).upper()
    return bool(re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{4,30}", s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _quoted(value: str) -> bool:
    if re.match("https?://", value, re.IGNORECASE) or re.search(rf"\.(?:{FILE_SUFFIXES})$", value, re.IGNORECASE):
        return True
    return " " not in value and 4 <= len(value) <= 64 and bool(re.search("[A-Za-z]", value) and re.search("[0-9]", value))


_VALID = {"CREDIT_CARD": _luhn, "IBAN": _iban, "QUOTED_SECRET": _quoted}


def _compiled(rules) -> list[tuple]:
    return [(r.name, re.compile(r.pattern, re.IGNORECASE if r.ignore_case else 0), re.compile(r.hint) if r.hint else None, r.inner, _VALID[r.name] if r.validator else None) for r in rules]


class DetectSpans:
    """The table function; a null text has no rows."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(text.dataType, T.StringType | T.NullType):
            raise ValueError("detect_spans takes a text")
        return AnalyzeResult(SCHEMA)

    def __init__(self):
        self.config = EngineConfig()
        self.text, self.code = _compiled(TEXT_RULES), _compiled(CODE_RULES)

    def eval(self, text):
        if text is None:
            return
        is_code = len(re.findall(CODE_SIGNAL, text)) >= 3
        plain, runs = normalise_runs(text, is_code, self.config)
        found: dict[tuple[int, int, str], None] = {}
        for name, pattern, hint, inner, valid in (self.code if is_code else []) + self.text:
            if hint is None or hint.search(plain):
                for m in pattern.finditer(plain):
                    start, end = m.start() + inner, m.end() - inner
                    if valid is None or valid(plain[start:end]):
                        found[start, end, name] = None
        places = [(s, e, n) for s, e, n in (self._original(runs, *f) for f in found) if s < e]
        places = list(dict.fromkeys(places))
        start, end = (np.array([p[i] for p in places], np.int64) for i in range(2))
        row = np.zeros(len(places), np.int64)
        kept = np.flatnonzero(disjoint(row, start, end, np.lexsort((np.arange(len(places)), start - end))))
        for i in kept[np.argsort(start[kept], kind="stable")]:
            s, e, name = places[i]
            yield s, e, name, text[s:e]

    @staticmethod
    def _original(runs: np.ndarray, start: int, end: int, name: str) -> tuple[int, int, str]:
        lo = int(np.searchsorted(runs[:, 0], start, "right")) - 1
        hi = int(np.searchsorted(runs[:, 0], end, "left")) - 1
        at, _, first, _, whole = runs[lo].tolist()
        begin = first if whole else first + max(start - at, 0)
        at, size, first, last, whole = runs[hi].tolist()
        return begin, last if whole else first + min(end - at, size), name


def register(spark: SparkSession, name: str = "detect_spans") -> None:
    spark.udtf.register(name, udtf(DetectSpans))
