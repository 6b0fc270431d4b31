"""Running sums and dense ordinals without a single-task window."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged


def with_running(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """df with name, the sum of value over the rows before in the given order. Rows are dealt by ranges of the order and
    written; a sum a partition, a row each, is summed up over the partitions."""
    part = f"_part_{uuid.uuid4().hex[:8]}"
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(df.withColumn(f"{part}_v", value).repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(part).agg(F.sum(f"{part}_v").alias("v"))
    before = sums.select(part, (F.sum("v").over(Window.orderBy(part)) - F.col("v")).alias(f"{part}_n"))  # a row a partition
    local = F.sum(f"{part}_v").over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(f"{part}_v")
    return dealt.withColumn(f"{part}_i", local).join(F.broadcast(before), part).withColumn(name, F.col(f"{part}_i") + F.col(f"{part}_n")).drop(part, f"{part}_i", f"{part}_n", f"{part}_v")


def with_ordinal(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with name, 0, 1, ... in the given order."""
    return with_running(df, order, F.lit(1).cast("long"), name).withColumn(name, F.col(name).cast("long"))
