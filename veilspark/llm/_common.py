"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT = "spark.checkpoint.dir"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Folders of local sessions that set none, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may lack it."""
    found = spark.conf.get(CHECKPOINT, None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT} must name a folder that all executors share")
        application = spark.sparkContext.applicationId
        found = _LOCAL[application] = _LOCAL.get(application) or tempfile.mkdtemp(prefix="veilspark-")
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: lineage ends here, and a lost executor repeats nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veilspark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, **what: Column) -> tuple[DataFrame, dict]:
    """saved(df) and aggregates of its rows, taken while it is written."""
    if not what:
        return saved(df, name), {}
    seen = Observation()
    out = saved(df.observe(seen, *(c.alias(k) for k, c in what.items())), name)
    return out, seen.get


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by saved(), when nothing that is still to run reads it."""
    spark = df.sparkSession
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if "/veilspark/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            with contextlib.suppress(Exception):
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def before(sums: DataFrame, keys: list[str], at: str, n: str, name: str, width: int = 1024) -> DataFrame:
    """sums(keys, at, n) with name: the sum of n over smaller places `at` (whole numbers) of the same keys.

    Places are summed by groups of `width` first, so that no task orders more than a group or the groups' sums.
    """
    top = F.floor(F.col(at) / width).cast("long")
    grouped = sums.withColumn("__top", top)
    earlier = Window.partitionBy
    tops = grouped.groupBy(*keys, "__top").agg(F.sum(n).alias("__n"))
    order = earlier(*keys, F.floor(F.col("__top") / width)).orderBy("__top").rowsBetween(Window.unboundedPreceding, -1)
    highest = tops.groupBy(*keys, F.floor(F.col("__top") / width).alias("__high")).agg(F.sum("__n").alias("__h"))
    lead = earlier(*keys, F.lit(0)).orderBy("__high").rowsBetween(Window.unboundedPreceding, -1)
    highest = highest.select(*keys, "__high", F.coalesce(F.sum("__h").over(lead), F.lit(0)).alias("__first"))
    tops = tops.select(*keys, "__top", F.floor(F.col("__top") / width).alias("__high"), F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__second"))
    tops = tops.join(highest, [*keys, "__high"]).select(*keys, "__top", (F.col("__first") + F.col("__second")).alias("__base"))
    inside = earlier(*keys, "__top").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    own = grouped.withColumn("__own", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return own.join(tops, [*keys, "__top"]).withColumn(name, F.col("__base") + F.col("__own")).drop("__top", "__own", "__base")


def text_batches(docs: DataFrame, rows: int = 1000) -> DataFrame:
    """docs, whose rows Spark sends to Python in batches of at most `rows`: its default of 10,000 texts can be more than a worker holds.

    The setting is the session's; one that the user has chosen stays.
    """
    conf = docs.sparkSession.conf
    if conf.get(BATCH) == "10000":
        conf.set(BATCH, str(rows))
    return docs


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying its texts; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text; one longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def without(docs: DataFrame, added: list[str]) -> DataFrame:
    """docs without the columns that an operator adds itself, so that a table which has them already is no clash."""
    return docs.drop(*added)


def held_out(doc_id, parts: int, part: int):
    """Whether crc32 of doc_id, as text, leaves `part` when divided by `parts`."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))
