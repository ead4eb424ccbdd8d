"""Workbooks (.xlsx, .xlsm) read and written without a spreadsheet library: a zip archive of XML, a file to a row.

A workbook's cells are rows of path, sheet, row_id, ix, value; a sheet's first row has row_id 0, its first column ix 0. Only
texts are values: numbers, dates, truth values, errors and formulas are no candidates for detection, and neither are the
covered cells of merged ranges. Changing a workbook rewrites its changed cells alone; styles, formulas, other sheets and all other parts stay as they are.

register(spark) adds the format "workbook": spark.read.format("workbook").load(path) gives the cells of a file or of a
folder's files, a task each; df.write.format("workbook").save(path) makes new workbooks, one a task, from such cells. They
are written beside and moved in place when all tasks have ended, so that a failed job leaves none of them.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from html import unescape
from posixpath import join, normpath
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

CELLS = "path string, sheet string, row_id long, ix int, value string"
_TOKEN = re.compile(r"<(?:\w+:)?row\b([^>]*)>|<((?:\w+:)?)c\b([^>]*?)(?:/>|>(.*?)</(?:\w+:)?c>)", re.DOTALL)
_TEXT = re.compile(r"<(?:\w+:)?rPh\b.*?</(?:\w+:)?rPh>|<(?:\w+:)?t\b[^>]*?(?:/>|>(.*?)</(?:\w+:)?t>)", re.DOTALL)
_VALUE = re.compile(r"<(?:\w+:)?v\b[^>]*>(.*?)</(?:\w+:)?v>", re.DOTALL)
_FORMULA = re.compile(r"<(?:\w+:)?f\b")
_SHARED = re.compile(r"<(?:\w+:)?si\b[^>]*?(?:/>|>(.*?)</(?:\w+:)?si>)", re.DOTALL)
_MERGED = re.compile(r'<(?:\w+:)?mergeCell\b[^>]*\bref="([A-Z]+)(\d+):([A-Z]+)(\d+)"')
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _attribute(tag: str, name: str) -> str | None:
    found = re.search(rf'(?<![\w:]){name}="([^"]*)"', tag)
    return unescape(found[1]) if found else None


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n - 1


def _letters(ix: int) -> str:
    out, n = "", ix + 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _text(xml: str) -> str:
    return unescape("".join(m[1] or "" for m in _TEXT.finditer(xml)))


def _read(z: zipfile.ZipFile, name: str) -> str:
    return z.read(name).decode("utf-8-sig")


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of each sheet, in order."""
    parts = {}
    for tag in re.findall(r"<(?:\w+:)?Relationship\b([^>]*)>", _read(z, "xl/_rels/workbook.xml.rels")):
        target = _attribute(tag, "Target")
        parts[_attribute(tag, "Id")] = target.lstrip("/") if target.startswith("/") else normpath(join("xl", target))
    tags = re.findall(r"<(?:\w+:)?sheet\b([^>]*)>", _read(z, "xl/workbook.xml"))
    found = [(_attribute(t, "name"), parts.get(_attribute(t, r"\w+:id"))) for t in tags]
    return [(name, part) for name, part in found if part and "chartsheets/" not in part]


def _walk(xml: str) -> Iterator[tuple[re.Match, int, int]]:
    """Each cell's element, row and column; where they are not named, they follow the ones before."""
    row, ix = -1, -1
    for m in _TOKEN.finditer(xml):
        if m[2] is None:
            named = _attribute(m[1], "r")
            row, ix = int(named) - 1 if named else row + 1, -1
            continue
        at = re.match(r"([A-Z]+)(\d+)$", _attribute(m[3], "r") or "")
        row, ix = (int(at[2]) - 1, _column(at[1])) if at else (row, ix + 1)
        yield m, row, ix


def _covered(xml: str) -> list[tuple[int, int, int, int]]:
    return [(int(b) - 1, int(d) - 1, _column(a), _column(c)) for a, b, c, d in _MERGED.findall(xml)]


def cells_of(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row_id, ix, value) of all texts."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [_text(m[1] or "") for m in _SHARED.finditer(_read(z, "xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        for sheet, part in _sheets(z):
            xml = _read(z, part)
            hidden = {(r, c) for a, b, x, y in _covered(xml) if (b - a + 1) * (y - x + 1) <= 1 << 20 for r in range(a, b + 1) for c in range(x, y + 1) if (r, c) != (a, x)}
            for m, row, ix in _walk(xml):
                kind, inner = _attribute(m[3], "t"), m[4] or ""
                if kind not in ("s", "inlineStr", "str") or _FORMULA.search(inner) or (row, ix) in hidden:
                    continue
                value = _VALUE.search(inner)
                text = _text(inner) if kind == "inlineStr" else None if value is None else shared[int(value[1])] if kind == "s" else unescape(value[1])
                if text is not None:
                    yield sheet, row, ix, text


def changed(content: bytes, values: dict[tuple[str, int, int], str]) -> bytes:
    """The workbook with the texts of (sheet, row_id, ix) replaced; each changed cell keeps its style and holds its text itself."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        parts = {part: name for name, part in _sheets(z)}
        for item in z.infolist():
            data = z.read(item.filename)
            if item.filename in parts:
                sheet, xml, pieces, at = parts[item.filename], data.decode("utf-8-sig"), [], 0
                for m, row, ix in _walk(xml):
                    value = values.get((sheet, row, ix))
                    if value is not None:
                        style = _attribute(m[3], "s")
                        pieces += (xml[at : m.start()], _cell(m[2], row, ix, value, style))
                        at = m.end()
                data = "".join([*pieces, xml[at:]]).encode()
            to.writestr(item, data)
    return out.getvalue()


def _cell(prefix: str, row: int, ix: int, value: str, style: str | None = None) -> str:
    styled = f' s="{style}"' if style else ""
    return f'<{prefix}c r="{_letters(ix)}{row + 1}"{styled} t="inlineStr"><{prefix}is><{prefix}t xml:space="preserve">{escape(_ILLEGAL.sub("", value))}</{prefix}t></{prefix}is></{prefix}c>'


_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def new_workbook(cells: list[tuple[str, int, int, str]]) -> bytes:
    """A workbook of cells (sheet, row_id, ix, value); null values are left out."""
    sheets: dict[str, dict[int, dict[int, str]]] = {}
    for sheet, row, ix, value in cells:
        if value is not None:
            sheets.setdefault(sheet, {}).setdefault(row, {})[ix] = value
    out, numbers = io.BytesIO(), range(1, max(1, len(sheets)) + 1)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_KIND}.worksheet+xml"/>' for i in numbers)
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_KIND}.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        named = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(numbers, sheets or ["Sheet1"]))
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_RELATIONS}"><sheets>{named}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{_RELATIONS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers)
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')
        for i, rows in zip(numbers, list(sheets.values()) or [{}]):
            body = "".join(f'<row r="{r + 1}">{"".join(_cell("", r, c, v) for c, v in sorted(row.items()))}</row>' for r, row in sorted(rows.items()))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def workbook_cells(files: DataFrame) -> DataFrame:
    """CELLS and error of workbooks(path, content); a row in which only error is set for one that can't be read."""
    names = ["path", "sheet", "row_id", "ix", "value", "error"]

    def run(frames):
        for f in frames:
            for path, raw in zip(f["path"], f["content"], strict=True):
                try:
                    out = [(path, *c, None) for c in cells_of(bytes(raw))]
                except Exception as e:
                    out = [(path, None, None, None, None, str(e) or type(e).__name__)]
                for i in range(0, len(out), 50_000):
                    yield pd.DataFrame(out[i : i + 50_000], columns=names).astype({"row_id": "Int64", "ix": "Int32"})

    return files.select("path", "content").mapInPandas(run, CELLS + ", error string")


def changed_workbooks(files: DataFrame, values: DataFrame) -> DataFrame:
    """path, content: workbooks(path, content) with the texts of values(path, sheet, row_id, ix, value) in place of theirs. A file is one group, as it was one to read."""

    def run(key, left, right):
        new = dict(zip(zip(right["sheet"], right["row_id"], right["ix"], strict=True), right["value"], strict=True))
        return pd.DataFrame({"path": [key[0]] * len(left), "content": [changed(bytes(c), new) for c in left["content"]]})

    return files.select("path", "content").groupBy("path").cogroup(values.select("path", "sheet", "row_id", "ix", "value").groupBy("path")).applyInPandas(run, "path string, content binary")


# ---- the format "workbook" ----
def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        from pyarrow import fs

        store, place = _store(self.path)
        if store.get_file_info(place).type == fs.FileType.Directory:
            names = [i.path for i in store.get_file_info(fs.FileSelector(place, recursive=True))]
        else:
            names = [place]
        root = self.path[: len(self.path) - len(place)] if self.path.endswith(place) else ""
        return [_File(root + n) for n in sorted(names) if n.lower().endswith((".xlsx", ".xlsm")) and "/_staged-" not in n]

    def read(self, partition):
        store, place = _store(partition.path)
        with store.open_input_stream(place) as f:
            content = f.read()
        for cell in cells_of(content):
            yield (partition.path, *cell)


class _Written(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator):
        rows = [(r["sheet"] or "Sheet1", r["row_id"], r["ix"], r["value"]) for r in iterator]
        if not rows:
            return _Written(None)
        store, place = _store(f"{self.path}/_staged-{self.job}")
        store.create_dir(place, recursive=True)
        name = f"part-{uuid.uuid4().hex}.xlsx"
        with store.open_output_stream(f"{place}/{name}") as out:
            out.write(new_workbook(rows))
        return _Written(name)

    def commit(self, messages):
        from pyarrow import fs

        store, place = _store(self.path)
        store.create_dir(place, recursive=True)
        if self.overwrite:
            for i in store.get_file_info(fs.FileSelector(place)):
                if i.type == fs.FileType.File:
                    store.delete_file(i.path)
        for m in messages:
            if m is not None and m.name:
                store.move(f"{place}/_staged-{self.job}/{m.name}", f"{place}/{m.name}")
        self.abort(messages)

    def abort(self, messages):
        from pyarrow import fs

        store, place = _store(f"{self.path}/_staged-{self.job}")
        if store.get_file_info(place).type == fs.FileType.Directory:
            store.delete_dir(place)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)
