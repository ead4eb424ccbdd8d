"""The folder job, tables and file formats, over real files."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veilspark.config import EngineConfig
from veilspark.operators import boxes, evaluate, scan, tables
from veilspark.plans.folder import mask_folder
from veilspark.sources import files as fs


def put(path: Path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_a_folder_is_masked(spark, tmp_path):
    root = tmp_path / "in"
    put(root / "a.txt", "mail ann@example.org")
    put(root / "b.log", "信箱 ann@example.org 電話 0912345678".encode("cp950"))
    put(root / "sub/c.py", "x = 1\n# ann@example.org ghp_abcdefghijklmnopqrstuv1234\n")
    put(root / "plain.md", "nothing")
    put(root / "t.csv", "id;name;note\n1;Ann Lee;\"a; \"\"b\"\"\"\n2;Bob;=A1\n3;;x\n")
    put(root / "u.tsv", "姓名\te-mail\n王小明\tann@example.org\n".encode("cp950"))
    put(root / "bad.txt", b"\xff\xfe\xfa\x81")
    put(root / "pic.png", b"\x89PNG")
    put(root / "skip.bin", b"x")
    put(root / "old_masked.txt", "ann@example.org")
    put(root / ".git/config.txt", "ann@example.org")
    results, tags = mask_folder(spark, str(root))
    got = {Path(r["path"].removeprefix("file:")).relative_to(root).as_posix(): r for r in results.collect()}
    assert set(got) == {"a.txt", "b.log", "sub/c.py", "plain.md", "t.csv", "u.tsv", "bad.txt", "pic.png"}
    assert {k: r["risk"] for k, r in got.items()} == {"a.txt": "中", "b.log": "中", "sub/c.py": "高", "plain.md": "無", "t.csv": "中", "u.tsv": "中", "bad.txt": "錯誤", "pic.png": "錯誤"}
    assert {k for k, r in got.items() if r["output"] is None} == {"bad.txt", "pic.png"}
    out = tmp_path / "in_masked"
    names = {r["value"]: r["tag"] for r in tags.collect()}
    mail = names["ann@example.org"]
    assert (out / "a.txt").read_text() == f"mail {mail}"
    assert (out / "b.log").read_bytes().decode("cp950") == f"信箱 {mail} 電話 {names['0912345678']}"
    assert mail in (out / "sub/c.py").read_text() and "ghp_" not in (out / "sub/c.py").read_text()
    assert (out / "plain.md").read_text() == "nothing"
    table = (out / "t.csv").read_bytes()
    assert table.startswith(b"\xef\xbb\xbf") and table.decode("utf-8-sig") == f"id;name;note\n1;{names['Ann Lee']};\"a; \"\"b\"\"\"\n2;{names['Bob']};=A1\n3;;x\n"
    assert (out / "u.tsv").read_bytes().decode("utf-8-sig") == f"姓名\te-mail\n{names['王小明']}\t{mail}\n"
    assert fs.output_folder([str(out)], str(root)) == f"{out}_2"
    lines = [r["line"] for r in scan.report(results).collect()]
    assert lines[-1] == "dangerous 5, safe 1, failed 2" and lines[0].startswith("[高]")
    assert [r["risk"] for r in scan.by_risk(results).collect()] == ["高"] + ["中"] * 4 + ["錯誤"] * 2 + ["無"]


@pytest.mark.parametrize("folder", ["/", "", "/x/y_masked"])
def test_folders_that_are_not_scanned(folder):
    with pytest.raises(ValueError):
        fs.output_folder([], folder)


def test_delimited_tables_of_any_encoding(spark, tmp_path):
    put(tmp_path / "big5.csv", "姓名|電話\n王小明|02|x\n".replace("|x", "").encode("cp950"))
    put(tmp_path / "bom.csv", "﻿a;b\n1;2\n")
    put(tmp_path / "one.csv", "only\nvalue, with comma\n")
    df = fs.read_delimited(spark, str(tmp_path / "big5.csv"))
    assert df.columns == ["姓名", "電話"] and [tuple(r) for r in df.collect()] == [("王小明", "02")]
    df = fs.read_delimited(spark, str(tmp_path / "bom.csv"))
    assert df.columns == ["a", "b"] and [tuple(r) for r in df.collect()] == [("1", "2")]
    assert fs.sniff_delimiter("x") == "," and fs.sniff_delimiter("a\tb\nc\td\n") == "\t"
    fs.write_delimited(spark.createDataFrame([("a,b", 'c"d')], "x string, y string"), str(tmp_path / "out.csv"))
    assert [tuple(r) for r in fs.read_delimited(spark, str(tmp_path / "out.csv"), ",").collect()] == [("a,b", 'c"d')]


def test_columns_are_decided_and_masked(spark):
    rows = [(i, f"p{i}", "ann@example.org" if i % 2 else "bob@example.org 10.0.0.1", "hello", None) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, full_name string, col string, word string, empty string")
    got = {r["name"]: (r["label"], r["reason"]) for r in tables.decided(df).collect()}
    assert got == {"id": (None, None), "full_name": ("PERSON", "header"), "col": ("EMAIL", "content (6 cells)"), "word": (None, None), "empty": (None, None)}
    own = EngineConfig(header_rules=(("^word$", "WORDS"),))
    masked, tags, report = tables.mask_table(df, own, order="id")
    assert {(r["name"], r["label"], r["cells"]) for r in report.collect()} == {("col", "EMAIL", 6), ("word", "WORDS", 6)}
    assert [(r["col"], r["word"]) for r in masked.orderBy("id").collect()][:2] == [("<EMAIL_1>", "<WORDS_1>"), ("<EMAIL_2>", "<WORDS_1>")]
    same, tags, report = tables.mask_columns(df, {})
    assert same is df and tags.count() == report.count() == 0


def test_lists_and_maps_as_files(spark, tmp_path):
    lines = "﻿PERSON\tAnn Lee\n# comment\n\nbad label\tx\nEMAIL\t\nperson\tBob\njust a value\n"
    (tmp_path / "known.txt").write_text(lines)
    text = spark.read.text(str(tmp_path / "known.txt"))
    assert sorted(map(tuple, fs.known_entities(text).collect())) == [("PERSON", "Ann Lee"), ("PERSON", "Bob")]
    assert ("just a value", None) in {(r["value"], r["label"]) for r in fs.entity_lines(text).collect()}
    (tmp_path / "map.txt").write_text("<EMAIL_3>\ta@b.org\nodd\tx\n<A_1>\n")
    assert {(r["tag"], r["label"], r["n"], r["value"]) for r in fs.read_map(spark, str(tmp_path / "map.txt")).collect()} == {("<EMAIL_3>", "EMAIL", 3, "a@b.org"), ("odd", None, None, "x"), ("<A_1>", "A", 1, "")}
    (tmp_path / "list").mkdir()
    (tmp_path / "list/good.json").write_text(json.dumps([{"value": "v", "note": "n"}, {"note": "no value"}]))
    (tmp_path / "list/bad.json").write_text("[{broken")
    assert [r["value"] for r in fs.read_list(spark, str(tmp_path / "list"), "value string, note string").collect()] == ["v"]
    assert [Path(r["path"]).name for r in fs.unreadable(spark, str(tmp_path / "list"), "value string, note string").collect()] == ["bad.json"]
    for v, value in enumerate(("old", "new")):
        fs.write_list(spark.createDataFrame([(value,)], "value string"), str(tmp_path / "versions"), v)
    assert [r["value"] for r in fs.newest_list(spark, str(tmp_path / "versions"), "value string").collect()] == ["new"]


def test_gold_answers(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"article": "ab ab", "answer": [["ab", "X"], ["ab", "Y"]]}, indent=1))
    docs, gold = fs.read_gold(spark, str(tmp_path / "g.json"))
    got = evaluate.expected_positions(gold, docs).collect()
    assert sorted((r["ord"], r["start"], r["label"]) for r in got) == [(0, 0, "X"), (1, 3, "Y")]


def test_small_ones(spark):
    cases = spark.createDataFrame([(1, ["EMAIL"], 0.5), (1, ["X"], 0.0), (2, [], 1.0)], "scale int, detected array<string>, cer double")
    assert evaluate.average_cer(cases).first()[0] == 0.5
    assert {(r["label"], r["1"], r["2"]) for r in evaluate.by_scale(cases, ["EMAIL", "TW_ID"]).collect()} == {("EMAIL", "PASS", "MISS"), ("TW_ID", "MISS", "MISS")}
    assert [r["r"] for r in spark.createDataFrame([("EMAIL",), ("PERSON",)], "l string").select(boxes.reason(F.col("l")).alias("r")).collect()] == ["rule", "model"]
    entries = spark.createDataFrame([("f", 0, "X_1"), ("f", 1, "X_2")], "output_name string, page int, tag string")
    crops = spark.createDataFrame([("f", 0, "X_1", bytearray(b"ab"))], "output_name string, page int, tag string, crop binary")
    assert {r["tag"]: r["crop_b64"] for r in boxes.with_crops(entries, crops).collect()} == {"X_1": "YWI=", "X_2": None}
