"""Dense numbers in a global order without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholargraph.plans.cutpoints import written


def dense_numbers(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with ``name`` 0, 1, 2, ... in the order of unique keys ``order``.

    Rows are sorted by range; each partition numbers its own and adds the counts of those before. Only
    the partitions' counts, one row each, meet in one place.
    """
    at = written(df.orderBy(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ordered")
    counts = at.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__b"))
    return at.join(F.broadcast(before), "__p").withColumn(name, F.col("__i") + F.col("__b")).drop("__p", "__i", "__b")
