"""Global order without a single task that sees all rows: range partitions, and offsets between them.

The range-partitioned rows are written before they are numbered, so a task that is run again numbers the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.plans.lineage import cut


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    return cut(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_part", F.spark_partition_id())


def with_running_sum(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each row in ``order`` (a total order of the rows).

    The windows see one partition of the range each; the offsets are one row a partition.
    """
    rows = _ranged(df, order)
    sums = rows.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("_part", F.coalesce(before, F.lit(0)).alias("_offset"))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(out, F.coalesce(inside, F.lit(0))).join(offsets, "_part").withColumn(out, (F.col(out) + F.col("_offset")).cast("long")).drop("_part", "_offset")


def with_dense_number(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with 0, 1, 2, ... in ``order``."""
    return with_running_sum(df.withColumn("_one", F.lit(1)), order, "_one", out).drop("_one")
