"""Running numbers over whole tables and large groups, without a window that holds a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigfield.runtime import cut


def running(df: DataFrame, order: list[str], by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """Rows with ``upto``, the sum of the weights (1 without one) of a group's rows up to this one in the order of the
    columns ``order``, and ``total``, the group's sum. Rows with equal columns share their places in any order.

    The rows are dealt by ranges of group and order. Each range is summed by itself; what the ranges before it hold
    is added from a table with one row for each range and group in it."""
    by = by or []
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    weighted = df.withColumn("_w", F.lit(1).cast("long") if weight is None else weight.cast("long"))
    dealt = cut(weighted.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*by, "_part").agg(F.sum("_w").alias("_sum"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = sums.withColumns({"_before": F.coalesce(F.sum("_sum").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("_sum").over(group)}).drop("_sum")
    here = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    named = before.withColumnsRenamed({c: f"_by{k}" for k, c in enumerate(by)}).withColumnRenamed("_part", "_of")
    same = F.col("_part") == F.col("_of")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    joined = dealt.withColumn("_here", F.sum("_w").over(here)).join(named, same)
    return joined.select(*df.columns, (F.col("_here") + F.col("_before")).alias("upto"), "total")
