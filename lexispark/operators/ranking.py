"""Ranks over a whole table without moving it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``row_number() over (order by ...)`` by range partitions and the counts before each.

    The order must be total; a hot leading key is split by the following ones.
    """
    ranged = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    ranked = ranged.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    ranked = materialise(ranked, "ranked")
    counts = ranked.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("__b", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = ranked.join(F.broadcast(before.select("__p", "__b")), "__p")  # a row a partition
    return out.withColumn(name, (F.col("__r") + F.col("__b")).cast("long")).drop("__p", "__r", "__b")
