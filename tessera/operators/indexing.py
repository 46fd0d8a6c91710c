"""Dense positions in a global order, without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, partitions


def dense_index(df: DataFrame, order: list[str], within: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: positions from 0 by ``order`` in each group of ``within``.

    Rows are dealt by ranges of (within, order) and kept, so that range numbers hold; each range
    counts its rows of each group, and a row's position is what ranges before hold plus its
    place in its own. Only the counts (groups x ranges rows) meet. Rows equal in ``order`` are
    put in any order.
    """
    ranged = cut(df.repartitionByRange(partitions(df.sparkSession), *within, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*within, "_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*within).orderBy("_range")) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy(*within, "_range").orderBy(*order)) - 1
    return ranged.withColumn("_place", place).join(before, [*within, "_range"]).withColumn(name, (F.col("_before") + F.col("_place")).cast("long")).drop("_place", "_before", "_range")
