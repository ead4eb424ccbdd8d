"""Settings of the engine, and the fixed sets they start from."""

from __future__ import annotations

from dataclasses import dataclass, field

# Suffixes by kind of file, folders that a scan skips, and what marks a label as high risk.
CODE_EXTENSIONS = (".py", ".js", ".ts", ".java", ".c", ".cpp", ".h", ".cs", ".go", ".rs", ".php", ".rb", ".sh", ".sql", ".json", ".yml", ".yaml")
MEDIA_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tiff", ".webp", ".pdf")
TEXT_EXTENSIONS = (".txt", ".md", ".log")
TABLE_EXTENSIONS = (".csv", ".tsv", ".xlsx", ".xlsm")
SKIPPED_FOLDERS = (".git", "__pycache__", "node_modules", ".venv", "venv")
HIGH_RISK = ("KEY", "JWT", "PASSWORD", "PASSWD", "SECRET", "TOKEN", "CARD", "NATIONAL_ID", "SSN", "PRIVATE")
OUTPUT_SUFFIX = "_masked"
RISK_HIGH, RISK_MEDIUM, RISK_ERROR, RISK_NONE = "高", "中", "錯誤", "無"
# Least lengths of detected, added and known values; sources kept of a value; punctuation that compatibility
# forms leave alone.
AUTO_MIN, MANUAL_MIN, KNOWN_MIN = 3, 2, 3
KEPT_SOURCES = 5
KEPT_PUNCTUATION = "，；：！？（）～"


@dataclass(frozen=True)
class EngineConfig:
    normalise: bool = True
    nfkc: bool = True
    invisible: bool = True
    html: bool = True
    whitespace: bool = False
    chinese: str | None = None  #: "auto", "s2t" or "t2s", with the pairs in `chinese_pairs`
    chinese_pairs: tuple[str, str] = ("", "")  #: simplified characters, and the traditional one for each
    max_chars: int | None = None  #: longer texts are searched as they are; None: no limit
    use_known_items: bool = True
    ignored_column_labels: tuple[str, ...] = ()
    #: Texts are dealt to so many partitions before detection, where a source has too few; None: as they are read.
    partitions: int | None = None
    #: Rules of texts, of code and of column names; None: those of functions.patterns. Append to them to add one's own.
    text_rules: tuple | None = None
    code_rules: tuple | None = None
    header_rules: tuple | None = None
    #: Extra detectors: functions of (text, is_code) columns that return an array of spans.
    detectors: tuple = field(default_factory=tuple)
