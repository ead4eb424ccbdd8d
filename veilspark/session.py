"""What operators need of the session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """df computed once: a checkpoint in the folder that the cluster shares. Only a local session may lack one: it caches.

    Rows get numbers before this, which must not change when an executor is lost; a cache could be computed anew.
    """
    if df.sparkSession.conf.get("spark.checkpoint.dir", None):
        return df.checkpoint()
    if not df.sparkSession.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return df.persist()


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that later expressions refer to and don't take over: Spark can't plan a Python function over nested lambdas."""
    return df.withColumn(name, F.when(F.monotonically_increasing_id() >= 0, value))


#: Rows of a batch for Python: its default of 10,000 texts, with what is made of each, can be more than a worker holds.
ROWS, BATCH = 500, "spark.sql.execution.arrow.maxRecordsPerBatch"


def batched(df: DataFrame) -> DataFrame:
    """df, whose texts Spark sends to Python in batches of ROWS at most. The setting is the session's; one that the user has chosen stays."""
    conf = df.sparkSession.conf
    if conf.get(BATCH) == "10000":
        conf.set(BATCH, str(ROWS))
    return df


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """df dealt to so many partitions, for work that costs far more than moving its rows; None: as it is read."""
    return df if partitions is None or df.isStreaming else df.repartition(partitions)


def ranked(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """row_number() over (partition by group order by order), without a task that holds a whole group.

    Rows are sorted over all partitions; each counts its own, and the counts of the partitions before it are added.
    """
    keys = [f"__k{i}" for i in range(len(order))]
    named = df.select("*", *(o.alias(k) for o, k in zip(order, keys, strict=True)))
    placed = kept(named.repartitionByRange(group, *keys).select("*", F.spark_partition_id().alias("__p")))
    counts = placed.groupBy(group, "__p").agg(F.count("*").alias("__n"))
    before = counts.select(group, "__p", F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    local = placed.withColumn("__r", F.row_number().over(Window.partitionBy(group, "__p").orderBy(*keys)))
    return local.join(before, [group, "__p"]).withColumn(name, (F.col("__r") + F.col("__before")).cast("long")).drop(*keys, "__p", "__r", "__before")
