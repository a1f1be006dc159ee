"""Running totals and places in an order, however large a group is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder, if it has one."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df


def running_total(df: DataFrame, group: str, order: list[Column], value: str | Column, out: str) -> DataFrame:
    """df with the total of value over the rows of its group up to and with each, in an order.

    Rows are dealt by ranges of (group, order), so a large group is many tasks'. Each range's total
    of a group is a row; what stands before a range is summed from those, of which a group has as
    many as ranges. Rows that are equal in the order's columns get their places as they come.
    """
    taken = {c.lower() for c in df.columns}
    part, before = (next(n + "_" * k for k in range(99) if (n + "_" * k).lower() not in taken) for n in ("part", "before"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = kept(df.repartitionByRange(parts, F.col(group), *order).withColumn(part, F.spark_partition_id()))
    value = F.col(value) if isinstance(value, str) else value
    sums = rows.groupBy(group, part).agg(F.sum(value).alias("sum_"))
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col(group).alias("of_group"), F.col(part).alias("of_part"), F.coalesce(F.sum("sum_").over(earlier), F.lit(0)).alias(before))
    here = Window.partitionBy(group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(out, F.sum(value).over(here))
    rows = rows.join(offsets, F.col(group).eqNullSafe(F.col("of_group")) & (F.col(part) == F.col("of_part")))
    return rows.withColumn(out, F.col(out) + F.col(before)).drop("of_group", "of_part", part, before)
