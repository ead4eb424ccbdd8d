"""Sources and sinks: folders of files, texts of unknown encoding, delimited tables, maps, lists and gold answers."""

from __future__ import annotations

import csv
import io
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CODE_EXTENSIONS, MEDIA_EXTENSIONS, OUTPUT_SUFFIX, SKIPPED_FOLDERS, TABLE_EXTENSIONS, TEXT_EXTENSIONS
from ..functions.scalars import stripped
from ..operators.codec import imported_map
from ..operators.scan import extension, file_kind


#: Bytes in which the first line of a table is looked for, to tell which files have the same columns.
HEAD = 65_536
_CELLS = ["path", "delimiter", "row_id", "ix", "name", "value", "error"]


def list_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, kind, length, modified, content of the supported files: no skipped or already masked folder, no masked file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    inner = F.regexp_replace("path", "^.*?" + quoted(folder.rstrip("/").rpartition("/")[2]) + "/", "")
    return scannable(found, inner).withColumn("kind", file_kind(F.col("path"))).orderBy("path")


def quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def scannable(files: DataFrame, inner: Column) -> DataFrame:
    """The files(path, ...) that a scan takes; inner: the path below the folder."""
    parts = F.split(inner, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    skip = F.exists(folders, lambda p: p.isin(*SKIPPED_FOLDERS) | p.rlike(f"{OUTPUT_SUFFIX}(_[0-9]+)?$"))
    stem = F.regexp_replace(F.element_at(parts, -1), "(?<=.)\\.[^.]+$", "")
    return files.where(~skip & ~stem.endswith(OUTPUT_SUFFIX) & extension(F.col("path")).isin(*CODE_EXTENSIONS, *MEDIA_EXTENSIONS, *TEXT_EXTENSIONS, *TABLE_EXTENSIONS))


def output_folder(existing: list[str], folder: str) -> str:
    """A name beside the folder that is not taken."""
    base, n = folder.rstrip("/") + OUTPUT_SUFFIX, 1
    if folder.rstrip("/") in ("", "/") or folder.rstrip("/").endswith(OUTPUT_SUFFIX):
        raise ValueError("the root and masked folders are not scanned")
    while (base if n == 1 else f"{base}_{n}") in existing:
        n += 1
    return base if n == 1 else f"{base}_{n}"


def decoded(content: Column, encodings: tuple[str, ...] = ("utf-8", "cp950", "big5"), errors: str = "error") -> Column:
    """struct<text, encoding, error>: the first encoding that fits, a byte-order mark before all. errors: "error" gives an
    error instead of a text, "ignore" and "replace" decode UTF-8 with losses."""

    @F.pandas_udf("struct<text:string,encoding:string,error:string>")
    def run(raws: pd.Series) -> pd.DataFrame:
        def one(raw):
            if raw is None:
                return None, None, "no content"
            for e in ("utf-8-sig",) if raw.startswith(b"\xef\xbb\xbf") else encodings:
                try:
                    return raw.decode(e), e, None
                except UnicodeDecodeError:
                    continue
            if errors != "error":
                return raw.decode("utf-8", errors), "utf-8", None
            return None, None, "unknown encoding"

        return pd.DataFrame([one(r) for r in raws], columns=["text", "encoding", "error"])

    return run(content)


def read_texts(files: DataFrame, errors: str = "error") -> DataFrame:
    """files with text, encoding and error."""
    return files.withColumn("__d", decoded(F.col("content"), errors=errors)).select(*files.columns, "__d.*")


def text_bytes(texts: DataFrame) -> DataFrame:
    """path, content: texts(path, text, encoding) in the encoding that each came in."""

    def run(frames):
        for f in frames:
            content = [None if t is None else t.encode(e or "utf-8", "replace") for t, e in zip(f["text"], f["encoding"], strict=True)]
            yield pd.DataFrame({"path": f["path"], "content": content})

    return texts.select("path", "text", "encoding").mapInPandas(run, "path string, content binary")


def sniff_delimiter(head: str) -> str:
    """Of , ; tab and |, what the standard library's sniffer sees in the first 4096 characters; a comma if it sees nothing."""
    try:
        return csv.Sniffer().sniff(head[:4096], delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def table_shapes(files: DataFrame) -> DataFrame:
    """path, encoding, delimiter of delimited files(path, content): each file's own, from all of its bytes (of which Spark reads 2 GB at most)."""

    def run(frames):
        for f in frames:
            found = [(p, *decode_table(bytes(raw))) for p, raw in zip(f["path"], f["content"], strict=True)]
            yield pd.DataFrame([(p, e, "\t" if p.lower().endswith(".tsv") else sniff_delimiter(t)) for p, t, e in found], columns=["path", "encoding", "delimiter"])

    return files.select("path", "content").mapInPandas(run, "path string, encoding string, delimiter string")


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None) -> DataFrame:
    """A wide table of the files at path, all columns as text; each file's first row names its columns, and columns of one name are one.

    Each file has its own encoding (UTF-8, else cp950, else UTF-8 with replacements) and delimiter, where none is given.
    UTF-8 is read by Spark; what it has no decoder for goes cell by cell and becomes wide again, by header.
    """
    files = spark.read.format("binaryFile").load(path)
    shapes = [(r["path"], encoding or r["encoding"], delimiter or r["delimiter"]) for r in table_shapes(files).orderBy("path").collect()]  # a row a file
    wide = []
    for cut in dict.fromkeys(d for _, e, d in shapes if e == "utf-8-sig"):
        for mine in _same_header(spark, [p for p, e, d in shapes if (e, d) == ("utf-8-sig", cut)]):
            df = spark.read.csv(mine, sep=cut, header=True, inferSchema=False, multiLine=True, quote='"', escape='"', enforceSchema=False, encoding="UTF-8")
            wide.append(df.withColumnsRenamed({c: c.removeprefix("\ufeff") for c in df.columns[:1]}))
    for cut in dict.fromkeys(d for _, e, d in shapes if e != "utf-8-sig"):
        cells = delimited_cells(files.where(F.col("path").isin([p for p, e, d in shapes if e != "utf-8-sig" and d == cut])), cut)
        headers = cells.where("row_id = 0").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ix", "value"))).alias("h")).collect()  # a row a file
        for names in dict.fromkeys(tuple(x["value"] for x in r["h"]) for r in headers):
            mine = cells.where(F.col("path").isin([r["path"] for r in headers if tuple(x["value"] for x in r["h"]) == names]))
            of = [F.max(F.when(F.col("ix") == i, F.col("value"))).alias(n) for i, n in enumerate(names)]
            wide.append(mine.where("row_id > 0").groupBy("path", "row_id").agg(*of).drop("path", "row_id"))
    if not wide:
        return spark.read.csv(path, header=True)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), wide)


def _same_header(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    """The paths in groups of one first line: Spark's reader takes the names of one file for all."""
    heads: dict[str, list[str]] = {}
    lines = spark.read.format("binaryFile").load(paths).select("path", F.split(F.substring("content", 1, HEAD).cast("string"), "\\r\\n|\\r|\\n", 2)[0].alias("h"))
    for r in lines.orderBy("path").collect():  # a line a file
        heads.setdefault((r["h"] or "").removeprefix("\ufeff"), []).append(r["path"])
    return list(heads.values())


def decode_table(raw: bytes) -> tuple[str, str]:
    """(text, encoding): UTF-8 with or without a byte-order mark, then cp950, else UTF-8 with replacements."""
    for e in ("utf-8-sig", "cp950"):
        try:
            return raw.decode(e), e
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace"), "utf-8"


def delimited_cells(files: DataFrame, delimiter: str | None = None) -> DataFrame:
    """path, delimiter, row_id, ix, name, value, error: all cells of delimited files(path, content), each with its own
    encoding and, unless one is given, delimiter; a row of one file in which only error is set if it can't be read. row_id 0 holds the header."""

    def run(frames):
        for f in frames:
            for path, raw in zip(f["path"], f["content"], strict=True):
                out = []
                try:
                    text, _ = decode_table(bytes(raw))
                    cut = delimiter or ("\t" if path.lower().endswith(".tsv") else sniff_delimiter(text))
                    names = []
                    for n, row in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=cut)):
                        names = row if n == 0 else names
                        out += [(path, cut, n, i, names[i] if i < len(names) else "", v, None) for i, v in enumerate(row)]
                        if len(out) > 50_000:
                            yield pd.DataFrame(out, columns=_CELLS)
                            out = []
                except Exception as e:
                    out = [(path, None, None, None, None, None, str(e) or type(e).__name__)]
                yield pd.DataFrame(out, columns=_CELLS).astype({"row_id": "Int64", "ix": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, delimiter string, row_id long, ix int, name string, value string, error string")


def delimited_bytes(cells: DataFrame) -> DataFrame:
    """path, content: cells(path, delimiter, row_id, ix, value) as delimited files again, in UTF-8 with a byte-order mark. A file is one group, as it was one to read."""

    def run(key, f):
        out = io.StringIO(newline="")
        rows = f.sort_values(["row_id", "ix"])
        writer = csv.writer(out, delimiter=rows["delimiter"].iloc[0], lineterminator="\n")
        for _, row in rows.groupby("row_id", sort=False):
            writer.writerow(row["value"])
        return pd.DataFrame({"path": [key[0]], "content": [out.getvalue().encode("utf-8-sig")]})

    return cells.groupBy("path").applyInPandas(run, "path string, content binary")


def write_delimited(df: DataFrame, path: str, delimiter: str = ",") -> None:
    df.write.mode("overwrite").csv(path, sep=delimiter, header=True, quote='"', escape='"')


def write_files(files: DataFrame) -> DataFrame:
    """path and error (null if it was written) of files(path, content): each under its own name. Executors write them, through
    Arrow's file systems; a file that exists is replaced, so a task that runs again does no harm. Call an action once."""

    def run(frames):
        from pyarrow import fs

        for f in frames:
            errors = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    store, place = fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    with store.open_output_stream(place) as out:
                        out.write(content)
                    errors.append(None)
                except Exception as e:
                    errors.append(str(e) or type(e).__name__)
            yield pd.DataFrame({"path": f["path"], "error": errors})

    return files.select("path", "content").mapInPandas(run, "path string, error string")


def write_texts(df: DataFrame, path: str, column: str = "masked") -> None:
    df.select(column).write.mode("overwrite").text(path)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """A tag map: Parquet, or lines of tag and value between which is a tab."""
    if path.endswith((".txt", ".tsv")):
        lines = spark.read.text(path).where(F.col("value") != "")
        cut = F.split("value", "\t", 2)
        return imported_map(lines.select(cut[0].alias("tag"), F.coalesce(F.get(cut, F.lit(1)), F.lit("")).alias("value")).where("tag <> ''"))
    return spark.read.parquet(path)


def write_map(tags: DataFrame, path: str) -> None:
    tags.write.mode("overwrite").parquet(path)


def read_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A list kept as JSON, an array or a record a line; what can't be read goes to no row."""
    marked = spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").option("multiLine", "true").json(path)
    return marked.where(F.col("_corrupt_record").isNull() & F.col("value").isNotNull()).drop("_corrupt_record")


def unreadable(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """path and record of what read_list leaves out, to be set aside."""
    whole = spark.read.text(path, wholetext=True)
    return whole.where(F.from_json("value", f"array<struct<{schema}>>").isNull()).select(F.input_file_name().alias("path"), F.col("value").alias("record"))


def write_list(items: DataFrame, path: str, version: int) -> None:
    """A list as a new version beside the earlier ones, <path>/v=<version>, so that a failed write harms none of them."""
    items.write.mode("error").json(f"{path}/v={version}")


def newest_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The latest version that write_list has finished."""
    marked = spark.read.schema(schema + ", v long").json(path)
    top = marked.agg(F.max("v")).first()[0]
    return marked.where(F.col("v") == F.lit(top)).drop("v")


def known_entities(lines: DataFrame) -> DataFrame:
    """label, value of lines(value) "LABEL<tab>value"; blanks, comments and malformed lines are left out."""
    line = F.regexp_replace(F.col("value"), "^\\x{feff}", "")
    cut = F.split(line, "\t", 2)
    label, value = F.upper(stripped(cut[0])), stripped(F.get(cut, F.lit(1)))
    good = (stripped(line) != "") & ~stripped(line).startswith("#") & label.rlike("^[A-Z_]+$") & (F.coalesce(value, F.lit("")) != "")
    return lines.where(good).select(label.alias("label"), value.alias("value")).distinct()


def entity_lines(lines: DataFrame) -> DataFrame:
    """value, label (null if none is given) of lines(value): "LABEL<tab>value" or a value a line."""
    line = stripped(F.regexp_replace(F.col("value"), "^\\x{feff}", ""))
    cut = F.split(line, "\t", 2)
    label, rest = F.upper(stripped(cut[0])), stripped(F.get(cut, F.lit(1)))
    named = label.rlike("^[A-Z_]+$") & (F.coalesce(rest, F.lit("")) != "")
    return lines.where((line != "") & ~line.startswith("#")).select(F.when(named, rest).otherwise(line).alias("value"), F.when(named, label).alias("label"))


def read_gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(articles(doc_id, text), gold(doc_id, ord, value, label)) of JSON files of an article and its answers."""
    raw = spark.read.schema("article string, answer array<array<string>>").option("multiLine", "true").json(path)
    docs = raw.withColumn("doc_id", F.monotonically_increasing_id())
    gold = docs.select("doc_id", F.posexplode("answer").alias("ord", "a")).select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("a")[0].alias("value"), F.col("a")[1].alias("label"))
    return docs.select("doc_id", F.col("article").alias("text")), gold


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").csv(path, sep="\t", header=True)
