"""The folder job: every supported file masked with one map and written under its own name, and a result for each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.scalars import header_type, is_candidate, is_code, stripped
from ..operators import codec, scan
from ..operators.detect import detect
from ..operators.tables import column_votes
from ..session import kept
from ..sources import files as fs
from ..sources import workbooks as wb


def mask_texts(files: DataFrame, tags: DataFrame, config: EngineConfig, lists: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(contents(path, content), spans(path, label), map) of files(path, kind, text, encoding): program code by its suffix, the rest by its look."""
    code = F.when(F.col("kind") == "code", True)
    docs = files.select(F.col("path").alias("doc_id"), "text", "encoding", code.alias("by_suffix"))
    docs = docs.withColumn("is_code", F.coalesce("by_suffix", is_code(F.col("text")), F.lit(False))).drop("by_suffix")
    found = kept(detect(docs, config, **lists))
    masked, full = codec.mask(found, tags)
    contents = fs.text_bytes(masked.select(F.col("doc_id").alias("path"), F.coalesce("masked", "text").alias("text"), "encoding"))
    spans = found.select(F.col("doc_id").alias("path"), F.explode_outer("spans").alias("m")).where("m is not null").select("path", F.col("m.label").alias("label"))
    return contents, spans, full


def mask_cells(cells: DataFrame, tags: DataFrame, config: EngineConfig, lists: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(path, row_id, ix, tag of masked cells; spans; map) of cells(path, row_id, ix, value), a path a table: columns that their names or most of their cells decide, masked whole."""
    column = ["path", "ix"]
    body = cells.where("row_id > 0")
    names = cells.where("row_id = 0").select(*column, header_type(F.col("value"), config.header_rules).alias("label"))
    undecided = body.join(names.where("label is not null").select(*column), column, "left_anti")
    order = Window.partitionBy(*column).orderBy(F.desc("votes"), "first")
    top = column_votes(undecided, config, ("path",), **lists).withColumn("k", F.row_number().over(order)).where("k = 1").select(*column, "label")
    decided = names.where("label is not null").unionByName(top)
    used = kept(body.where(is_candidate(F.col("value"))).join(decided, column).select("path", "row_id", "ix", "label", stripped(F.col("value")).alias("value")))
    places = used.select("label", "value", F.struct("path", "row_id").alias("o1"), F.col("ix").alias("o2"))
    full = kept(codec.extended_map(places, tags))
    one = full.groupBy("value").agg(F.max_by("tag", "n").alias("tag"))
    return used.join(one, "value").select("path", "row_id", "ix", "tag"), used.select("path", "label"), full


def mask_tables(cells: DataFrame, tags: DataFrame, config: EngineConfig, lists: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(contents, spans, map) of cells that fs.delimited_cells gives."""
    named, spans, full = mask_cells(cells, tags, config, lists)
    whole = cells.join(named, ["path", "row_id", "ix"], "left").withColumn("value", F.coalesce("tag", "value"))
    return fs.delimited_bytes(whole), spans, full


def mask_workbooks(files: DataFrame, cells: DataFrame, tags: DataFrame, config: EngineConfig, lists: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(contents, spans, map) of workbooks(path, content) and their cells: each sheet is a table of its own, and only masked cells are rewritten."""
    tables = cells.withColumn("path", F.to_json(F.struct("path", "sheet"))).withColumn("name", F.lit(""))
    named, spans, full = mask_cells(tables, tags, config, lists)
    back = lambda df: df.withColumn("__p", F.from_json("path", "path string, sheet string")).withColumn("path", F.col("__p.path")).withColumn("sheet", F.col("__p.sheet")).drop("__p")
    return wb.changed_workbooks(files, back(named).withColumnRenamed("tag", "value")), back(spans).select("path", "label"), full


def mask_folder(spark: SparkSession, folder: str, out: str | None = None, config: EngineConfig | None = None, tags: DataFrame | None = None, recursive: bool = True, existing: tuple[str, ...] = (), **lists) -> tuple[DataFrame, DataFrame]:
    """(results, map): a replica of the whole folder with its texts, tables and workbooks masked, and all other files as they are.

    results: path, output (null for a file with an error, which is copied as it is), kind, hits, labels, error, risk. A file that can't be read or
    written has its error there and stops no other. Files and folders whose names begin with . or _ are none to Spark. Without `out` the replica is named beside the folder, by
    output_folder(existing, folder). Images need readers that are not installed here: they are errors.
    """
    config = config or EngineConfig()
    out = out or fs.output_folder(list(existing), folder)
    tags = codec.empty_map(spark) if tags is None else tags
    found = kept(fs.list_files(spark, folder, recursive))
    texts = kept(fs.read_texts(found.where(F.col("kind").isin("code", "text"))))
    cells = kept(fs.delimited_cells(found.where((F.col("kind") == "table") & F.lower("path").rlike("\\.(csv|tsv)$"))))
    written, spans, tags = mask_texts(texts.where("error is null"), tags, config, lists)
    table_files, table_spans, tags = mask_tables(cells.where("error is null"), tags, config, lists)
    books = found.where(F.lower("path").rlike("\\.xls[xm]$"))
    book_cells = kept(wb.workbook_cells(books))
    read = books.join(book_cells.where("error is not null").select("path"), "path", "left_anti")
    book_files, book_spans, tags = mask_workbooks(read, book_cells.where("error is null"), tags, config, lists)
    spans = spans.unionByName(table_spans).unionByName(book_spans)
    other = book_cells.where("error is not null").select("path", "error").unionByName(found.where(F.col("kind") == "media").select("path", F.lit("no reader for this kind of file").alias("error")))
    errors = texts.where("error is not null").select("path", "error").unionByName(cells.where("error is not null").select("path", "error")).unionByName(other)
    inner = F.regexp_replace("path", "^.*?" + fs.quoted(folder.rstrip("/").rpartition("/")[2]) + "/", "")
    target = F.concat(F.lit(out.rstrip("/") + "/"), inner)
    masked = written.unionByName(table_files).unionByName(book_files)
    everything = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    rest = everything.join(masked.select("path"), "path", "left_anti")  # copied as they are, supported or not
    contents = kept(masked.unionByName(rest).select("path", target.alias("output"), "content"))
    sent = kept(fs.write_files(contents.select(F.col("output").alias("path"), "content"))).select(F.col("path").alias("output"), F.col("error").alias("lost"))
    files = found.select("path", "kind").withColumn("output", target).join(errors, "path", "left").join(sent, "output", "left")
    files = files.select("path", "kind", "output", F.coalesce("error", "lost").alias("error"))
    results = scan.results(files.select("path", "kind", "error"), spans)
    outputs = files.select("path", F.when(F.col("error").isNull(), F.col("output")).alias("output"))
    return results.join(outputs, "path"), tags
