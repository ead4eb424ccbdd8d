"""Reports that merge: what batches found, as sketches that add up.

A batch becomes a row for each of its groups: exact counts, a HyperLogLog sketch of the distinct values and a KLL sketch of
their lengths. Rows of any batches merge to the report of all of them at once, over all subsets of the groups, without a look back at what
was found. A batch that is kept twice counts twice in `n`: write each under its own name, as fold() does, which replaces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2**LG_K cells of a sketch of distinct values: a standard error of about 1.04 / sqrt(2**LG_K), 1.6 %.
LG_K = 12
GROUPS = ("label", "source", "risk")


def sketched(spans: DataFrame, *groups: str, lg_k: int = LG_K) -> DataFrame:
    """groups, n, values (of spans.value) and lengths: one row a group of spans. Null values count in n alone."""
    size = F.length("value").cast("long")
    return spans.groupBy(*(groups or GROUPS)).agg(F.count("*").alias("n"), F.hll_sketch_agg("value", lg_k).alias("values"), F.kll_sketch_agg_bigint(size).alias("lengths"))


def merged_report(sketches: DataFrame, *groups: str, shares: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """groups (null where all of them are taken together), level (grouping_id), n, n_values (estimated) and length_<share> of rows of sketched(), by cube."""
    found = sketches.cube(*(groups or GROUPS)).agg(F.grouping_id().alias("level"), F.sum("n").alias("n"), F.hll_union_agg("values").alias("values"), F.kll_merge_agg_bigint("lengths").alias("lengths"))
    quantiles = [F.kll_sketch_get_quantile_bigint("lengths", F.lit(s)).alias(f"length_{round(100 * s)}") for s in shares]
    return found.select(*(groups or GROUPS), "level", "n", F.hll_sketch_estimate("values").alias("n_values"), *quantiles)


def fold(spans: DataFrame, path: str, batch: str, *groups: str) -> None:
    """Keep a batch's sketches under its name; one that runs again replaces what it kept before."""
    sketched(spans, *groups).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def folded(spark: SparkSession, path: str) -> DataFrame:
    """All batches that fold() has kept."""
    return spark.read.parquet(path)
