"""Rules: regular expressions in Python's flavour, for Spark's (Java's) engine."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from . import scalars

_CLASSES = {"d": r"\p{Nd}", "w": r"\p{L}\p{N}_", "s": r"\t-\r\x1c-\x20\x85\p{Z}"}


def to_java(pattern: str, ignore_case: bool = False) -> str:
    """The same language in Java: \\d, \\w and \\s as the Unicode classes that Python gives them."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            if n in _CLASSES:
                out.append(_CLASSES[n] if inside or n == "d" else f"[{_CLASSES[n]}]")
            elif n in "DWS":
                out.append(f"[^{_CLASSES[n.lower()]}]")
            else:
                out.append(c + n)
            i += 2
            continue
        if c == "[" and inside:
            out.append("\\[")
        else:
            inside = c == "[" or inside and c != "]"
            out.append(c)
        i += 1
    return ("(?iu)" if ignore_case else "") + "".join(out)


@dataclass(frozen=True)
class Rule:
    """validator: of the value, as a Column. inner: characters cut from both ends of a match (a quoted value).
    hint: a cheaper expression that every text with a match also matches. digit: every match holds a digit."""

    name: str
    pattern: str
    ignore_case: bool = False
    validator: Callable[[Column], Column] | None = None
    inner: int = 0
    hint: str | None = None
    digit: bool = False

    @property
    def java(self) -> str:
        return to_java(self.pattern, self.ignore_case)


# What a rule takes for a boundary (CJK neighbours are boundaries, unlike \b), the file suffixes it knows,
# and the patterns, in the order in which ties between them are broken.
L, R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
FILE_SUFFIXES = (
    r"txt|docx?|xlsx?|pptx?|pdf|png|jpe?g|gif|bmp|svg|csv|zip|rar|7z|tar|gz|"
    r"mp4|mp3|wav|py|ipynb|js|ts|jsx|tsx|json|xml|ya?ml|log|ini|cfg|conf|env|sql|html?|css|sh|bat|exe|dll"
)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_QUOTES = "\"'“”‘’"
TEXT_RULES: tuple[Rule, ...] = (
    Rule("TW_PHONE", L + r"09\d{2}[- ]?\d{3}[- ]?\d{3}" + R, hint=r"09\d{2}", digit=True),
    Rule("TW_ID", L + r"[A-Z][12]\d{8}" + R, hint=r"[A-Z][12]\d", digit=True),
    Rule("EMAIL", L + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}" + R, hint="@"),
    Rule("CREDIT_CARD", L + r"(?:\d[ -]?){13,19}" + R, validator=scalars.luhn_valid, hint=r"(?:\d[ -]?){13}", digit=True),
    Rule("URL", L + r"https?://[^\s\"'<>]+", hint="https?://"),
    Rule("FILE_NAME", L + rf"[\w\-. ]+?\.(?:{FILE_SUFFIXES})(?!\s*\()" + R, ignore_case=True, hint=rf"(?i:\.(?:{FILE_SUFFIXES}))(?![A-Za-z0-9_])"),
    Rule("CREDENTIAL_LIKE", L + r"(?=[A-Za-z0-9]{8,29}(?![A-Za-z0-9]))(?=[A-Za-z0-9]*[A-Za-z])(?=[A-Za-z0-9]*[0-9])[A-Za-z0-9]{8,29}" + R, hint="[A-Za-z][0-9]|[0-9][A-Za-z]", digit=True),
    Rule("GENERIC_SECRET", L + r"(?=[A-Za-z0-9_-]{30,}(?![A-Za-z0-9_-]))(?=[A-Za-z0-9_-]*[A-Za-z])(?=[A-Za-z0-9_-]*[0-9])[A-Za-z0-9_-]{30,}" + R, hint="[A-Za-z0-9_-]{30}", digit=True),
    Rule("QUOTED_SECRET", rf"[{_QUOTES}]([^{_QUOTES}\r\n]{{4,100}})[{_QUOTES}]", validator=lambda v: scalars.quoted_valid(v, FILE_SUFFIXES), inner=1, hint=rf"[{_QUOTES}][^{_QUOTES}\r\n]{{4,100}}+[{_QUOTES}]"),
    Rule("MAC_ADDRESS", L + r"(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}" + R, hint=":[0-9A-Fa-f]{2}:"),
    Rule("IP_ADDRESS", L + rf"(?:{_OCTET}\.){{3}}{_OCTET}" + R, hint=r"\.\d{1,3}\.\d", digit=True),
    Rule("IBAN", L + r"[A-Z]{2}\d{2}(?:[ ]?[A-Za-z0-9]{2,4}){3,8}" + R, validator=scalars.iban_valid, hint=r"[A-Z]{2}\d{2}", digit=True),
    Rule("SWIFT_CODE", L + r"[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?" + R, hint="[A-Z]{6}"),
    Rule("VEHICLE_VIN", L + r"[A-HJ-NPR-Z0-9]{17}" + R, hint="[A-Z0-9]{17}"),
    Rule("US_SSN", L + r"\d{3}-\d{2}-\d{4}" + R, hint=r"-\d{2}-\d{4}", digit=True),
    Rule("US_PHONE", L + r"\+1[ ]?\(\d{3}\)[ ]?\d{3}-\d{4}" + R, hint=r"\+1 ?\(", digit=True),
    Rule("GPS_COORDINATES", r"\d{1,3}\.\d+°\s*[NS]\s*,\s*\d{1,3}\.\d+°\s*[EW]", hint="°", digit=True),
    Rule("DATE_OF_BIRTH", r"\d{4}年\d{1,2}月\d{1,2}日", hint="年", digit=True),
    Rule("LICENSE_NUMBER", L + r"TWMD-\d{7}" + R, hint="TWMD-", digit=True),
    Rule("MEDICAL_RECORD_NUMBER", L + r"(?:MRN-\d{4}-\d{6}|CGH-\d{8}-\d{4})" + R, hint="MRN-|CGH-", digit=True),
    Rule("INSURANCE_POLICY_NUMBER", L + r"POL-TW-\d{7}" + R, hint="POL-TW-", digit=True),
    Rule("EMPLOYEE_ID", L + r"EMP-\d{5}" + R, hint="EMP-", digit=True),
    Rule("CASE_NUMBER", L + r"CLM-\d{4}-\d{7}" + R, hint="CLM-", digit=True),
    Rule("TAX_ID", r"(?:統一編號|统一编号)\s*\d{8}", hint="編號|编号", digit=True),
    Rule("INSURANCE_ID", r"(?:健保投保序號|健保投保序号)\s*[A-Z]\d{10}", hint="健保投保序", digit=True),
    Rule("DRIVER_LICENSE", L + r"[A-Z]\d{7}" + R, hint=r"[A-Z]\d{7}", digit=True),
    Rule("LICENSE_PLATE", L + r"[A-Z]{3}-\d{4}" + R, hint=r"[A-Z]{3}-\d{4}", digit=True),
    Rule("BANK_ACCOUNT", L + r"\d{3,4}-\d{3,4}-\d{6,9}" + R, hint=r"-\d{3,4}-\d{6}", digit=True),
    Rule(
        "ADDRESS",
        r"[\u4e00-\u9fff]{2,4}(?:市|縣)[\u4e00-\u9fff]{2,4}(?:區|鄉|鎮)[\u4e00-\u9fff0-9]{2,10}(?:路|街|大道)"
        r"(?:[一二三四五六七八九十0-9]{1,3}段)?\d{1,4}號(?:\d{1,3}樓)?",
        hint="號",
        digit=True,
    ),
)
CODE_RULES: tuple[Rule, ...] = (
    Rule("FILE_PATH", r"(?:[A-Za-z]:\\(?:[^\\/:*?\"<>|\r\n]+\\)*[^\\/:*?\"<>|\r\n]+)|(?:/(?:[^/\s]+/)+[^/\s]+)", hint=r"[A-Za-z]:\\|/[^/\s]+/"),
    Rule("JWT", L + r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+" + R, hint="eyJ"),
    Rule("API_KEY_OPENAI", L + r"sk-(?:proj-|ant-)?[A-Za-z0-9_-]{20,}" + R, hint="sk-"),
    Rule("API_KEY_AWS", L + r"(?:AKIA|ASIA)[0-9A-Z]{16}" + R, hint="AKIA|ASIA"),
    Rule("API_KEY_GITHUB", L + r"(?:ghp|gho|ghu|ghs|ghr|github_pat)_[A-Za-z0-9_]{20,}" + R, hint="gh[a-z]_|github_pat_"),
    Rule("API_KEY_GOOGLE", L + r"AIza[0-9A-Za-z\-_]{35}" + R, hint="AIza"),
)
#: Every text in which one of these rules matches has one of these signs: a digit, or what a rule without digits needs.
SIGN = "|".join((r"\d", *(r.hint or r.pattern for r in (*TEXT_RULES, *CODE_RULES) if not r.digit)))
# Fixed values: (pattern for a column's name, label), the first that fits, found anywhere in the name, without regard to
# case; the signs of program code; the form of a tag.
HEADER_RULES: tuple[tuple[str, str], ...] = (
    (r"姓名|名字|聯絡人|^(first|last|full|user)?[_ ]?name$", "PERSON"),
    (r"e-?mail|電子郵件|信箱", "EMAIL_ADDRESS"),
    (r"phone|mobile|tel|電話|手機", "PHONE_NUMBER"),
    (r"身分證|身份證|統一編號|national[_ ]?id|^id[_ ]?(no|number)$|ssn", "TW_NATIONAL_ID"),
    (r"address|地址", "ADDRESS"),
    (r"credit|card|信用卡|卡號", "CREDIT_CARD"),
)
CODE_SIGNAL = r"(?=[cdfirv{};=#])(?:[{};]|=>|#include|\b(?:(?:def|class|import|const|var|return) \b|function\b))"
TAG = r"<([A-Z_]+)_(\d+)>"
