"""Counters, timing statistics, histograms and job totals as grouped aggregations, and their text exposition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Upper bounds of the histogram's buckets, in seconds.
BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def timing_stats(observed: DataFrame, by: list[str], value: str) -> DataFrame:
    return observed.groupBy(*by).agg(F.count(value).alias("count"), F.sum(value).alias("total_seconds"), F.avg(value).alias("avg_seconds"), F.min(value).alias("min_seconds"), F.max(value).alias("max_seconds"))


def histogram(observed: DataFrame, by: list[str], value: str, buckets: list[float] | None = None) -> DataFrame:
    """(by, le, count): cumulative counts, the last bucket being +Inf. One pass; a row a bucket comes out of each group."""
    bounds = buckets or BUCKETS
    sums = observed.groupBy(*by).agg(*(F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"b{i}") for i, b in enumerate(bounds)), F.count(value).alias("inf"))
    cells = F.array(*(F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)), F.struct(F.lit("+Inf").alias("le"), F.col("inf").alias("count")))
    return sums.select(*by, F.explode(cells).alias("x")).select(*by, "x.le", "x.count")


def counters(observed: DataFrame, by: list[str], amount: str | None = None) -> DataFrame:
    return observed.groupBy(*by).agg((F.sum(amount) if amount else F.count("*")).alias("value"))


def exposition(stats: DataFrame, name: str, labels: list[str], value: str = "value") -> DataFrame:
    """Lines in the Prometheus text format."""
    pairs = F.concat_ws(",", *(F.concat(F.lit(f'{x}="'), F.col(x).cast("string"), F.lit('"')) for x in labels))
    return stats.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))


def job_totals(results: DataFrame, by: list[str]) -> DataFrame:
    """Sums of a job's file results. A file that was indexed counts as added and as modified alike."""
    indexed = F.when(F.col("indexed"), 1).otherwise(0)
    return results.groupBy(*by).agg(
        F.count("*").alias("files_seen"),
        F.sum(indexed).alias("files_added"),
        F.sum(indexed).alias("files_modified"),
        F.sum(F.coalesce("chunks_added", F.lit(0))).alias("chunks_added"),
        F.sum(F.coalesce("chunks_deleted", F.lit(0))).alias("chunks_deleted"),
    )
