"""Workbooks: round trips, merged cells, cells that stay as they are, and the folder job over them."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from veilspark.plans.folder import mask_folder
from veilspark.sources import files as fs
from veilspark.sources import workbooks as wb

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
SHARED = f'<sst {MAIN}><si><t>full_name</t></si><si><r><t>Ann</t></r><r><t xml:space="preserve"> &amp; Bob</t></r><rPh sb="0" eb="1"><t>x</t></rPh></si><si><t>note</t></si><si><t/></si><si><t>hidden</t></si></sst>'
FIRST = f"""<?xml version="1.0"?><worksheet {MAIN}><sheetData>
<row r="1"><c r="A1" s="2" t="s"><v>0</v></c><c r="B1" t="s"><v>4</v></c><c r="C1" t="s"><v>2</v></c></row>
<row r="2"><c r="A2" s="7" t="s"><v>1</v></c><c r="C2"><v>4.5</v></c><c r="D2" t="str"><f>A2&amp;"x"</f><v>Annx</v></c><c r="AB2" t="b"><v>1</v></c></row>
<row><c t="inlineStr"><is><t>Eve &lt;3</t></is></c><c s="1"/><c t="s"><v>2</v></c></row>
</sheetData><mergeCells count="1"><mergeCell ref="A1:B1"/></mergeCells></worksheet>"""
SECOND = f'<x:worksheet xmlns:x="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><x:sheetData><x:row r="1"><x:c r="A1" t="inlineStr"><x:is><x:t>e-mail</x:t></x:is></x:c></x:row><x:row r="5"><x:c r="A5" t="inlineStr"><x:is><x:t>ann@example.org</x:t></x:is></x:c></x:row></x:sheetData></x:worksheet>'


def book():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} {REL}><sheets><sheet name="One &amp; all" sheetId="1" r:id="rId7"/><sheet name="Two" sheetId="2" r:id="rId8"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId8" Target="/xl/worksheets/b.xml"/><Relationship Id="rId7" Target="worksheets/a.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", SHARED)
        z.writestr("xl/worksheets/a.xml", FIRST)
        z.writestr("xl/worksheets/b.xml", SECOND)
        z.writestr("xl/styles.xml", "<styles/>")
    return out.getvalue()


OWN = [("One & all", 0, 0, "full_name"), ("One & all", 0, 2, "note"), ("One & all", 1, 0, "Ann & Bob"), ("One & all", 2, 0, "Eve <3"), ("One & all", 2, 2, "note"), ("Two", 0, 0, "e-mail"), ("Two", 4, 0, "ann@example.org")]


def test_texts_and_nothing_else():
    """Numbers, truth values, formulas and covered cells are no texts; unnamed cells follow those before."""
    assert list(wb.cells_of(book())) == OWN


def test_only_changed_cells_are_rewritten():
    got = wb.changed(book(), {("One & all", 1, 0): "<PERSON_1>", ("Two", 4, 0): "a\x01&b"})
    assert list(wb.cells_of(got)) == [(s, r, c, "<PERSON_1>" if (s, r) == ("One & all", 1) else "a&b" if r == 4 else v) for s, r, c, v in OWN]
    with zipfile.ZipFile(io.BytesIO(got)) as z:
        first = z.read("xl/worksheets/a.xml").decode()
        assert z.read("xl/styles.xml") == b"<styles/>" and '<c r="A2" s="7" t="inlineStr">' in first
        assert first.replace('<c r="A2" s="7" t="inlineStr"><is><t xml:space="preserve">&lt;PERSON_1&gt;</t></is></c>', '<c r="A2" s="7" t="s"><v>1</v></c>') == FIRST


def test_round_trip_of_many_rows(spark, tmp_path):
    """100,000 rows through the format "workbook"; a task that fails leaves nothing."""
    wb.register(spark)
    rng = random.Random(1)
    words = ["a & b", "<tag>", ' "quoted" ', "王小明", "line\nend", "=1+1", "x" * 50]
    value = F.element_at(F.array(*map(F.lit, words)), (F.col("id") % len(words) + 1).cast("int"))
    cells = spark.range(200_000).select(F.lit(None).cast("string").alias("path"), F.when(F.col("id") % 5 == 0, "S 2").otherwise("S&1").alias("sheet"), F.floor(F.col("id") / 2).alias("row_id"), (F.col("id") % 2 + 25).cast("int").alias("ix"), F.concat(value, F.col("id").cast("string")).alias("value"))
    out = str(tmp_path / "books")
    cells.repartition(2, "sheet").write.format("workbook").mode("append").save(out)
    back = spark.read.format("workbook").load(out).select("sheet", "row_id", "ix", "value")
    want = cells.select("sheet", "row_id", "ix", "value")
    assert back.count() == 200_000 and back.exceptAll(want).count() == 0 and rng
    assert not [p for p in (tmp_path / "books").iterdir() if not p.name.startswith("part-")]
    bad = F.udf(lambda x: 1 // (x - 150_000) and None or "v", "string")
    with pytest.raises(Exception, match="ZeroDivision"):
        spark.range(200_000).repartition(3).select(F.lit(None).cast("string").alias("path"), F.lit("s").alias("sheet"), F.col("id").alias("row_id"), F.lit(0).alias("ix"), bad("id").alias("value")).write.format("workbook").mode("append").save(str(tmp_path / "broken"))
    assert not (tmp_path / "broken").exists() or not list((tmp_path / "broken").iterdir())


def test_the_folder_job_masks_workbooks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/book.xlsx").write_bytes(book())
    (tmp_path / "in/torn.xlsx").write_bytes(b"PK no archive")
    (tmp_path / "in/venv").mkdir()
    (tmp_path / "in/venv/config.txt").write_text("mail a@b.org")
    (tmp_path / "in/data.bin").write_bytes(b"\x00\x01")
    results, tags = mask_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = {r["path"].rpartition("/")[2]: r for r in results.collect()}
    assert got["book.xlsx"]["hits"] == 3 and got["book.xlsx"]["error"] is None and got["torn.xlsx"]["error"]
    masked = {(s, r, c): v for s, r, c, v in wb.cells_of((tmp_path / "out/book.xlsx").read_bytes())}
    for name in ("torn.xlsx", "venv/config.txt", "data.bin"):
        assert (tmp_path / "out" / name).read_bytes() == (tmp_path / "in" / name).read_bytes()
    back = {r["tag"]: r["value"] for r in tags.collect()}
    assert [back.get(masked[s, r, c], masked[s, r, c]) for s, r, c, _ in OWN] == [v for *_, v in OWN]
    assert masked["One & all", 1, 0].startswith("<PERSON_") and masked["Two", 4, 0] == "<EMAIL_ADDRESS_1>" and masked["One & all", 0, 0] == "full_name"


def test_each_table_has_its_own_encoding(spark, tmp_path):
    """A table whose first 70 KB are plain ASCII, beside ones of other encodings, delimiters and columns."""
    names = ["a" * 10] * 7_000 + ["王小明"]
    (tmp_path / "big.csv").write_bytes(("name,city\n" + "".join(f"{n},x\n" for n in names)).encode("cp950"))
    (tmp_path / "semi.csv").write_bytes("﻿name;phone\n李四;02\n".encode())
    (tmp_path / "utf.csv").write_bytes("city,name\n台北,王五\n".encode())
    (tmp_path / "lost.csv").write_bytes(b"name,city\nok\xff\xff,y\n")
    got = fs.read_delimited(spark, str(tmp_path))
    rows = {(r["name"], r["city"], r["phone"]) for r in got.collect()}
    assert rows == {("a" * 10, "x", None), ("王小明", "x", None), ("李四", None, "02"), ("王五", "台北", None), ("ok��", "y", None)} and got.count() == 7_004
