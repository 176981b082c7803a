"""Contiguous ranges of a sorted frame: the base of exact ranks and running totals.

A window over a whole group would sort the group in one task. Here Spark's range
partitioning sorts across tasks; each range then needs only the totals of the
ranges before it, of which there are as many as partitions.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracerisk.sources.shared import materialize


def in_ranges(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """The rows with `chunk`, the number of the range of `order` that holds them.

    Written once, because the range bounds are sampled: all readers must see the
    same ones. Rows equal in `order` share a chunk.
    """
    return materialize(df.repartitionByRange(*order).withColumn("chunk", F.spark_partition_id()))
