"""Running numbers over a global order, without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_running_number(df: DataFrame, order: list, name: str, start: int = 0, per_group: list | None = None) -> DataFrame:
    """Number the rows of ``df`` by ``order``, a unique order, from ``start``.

    Rows are range-partitioned by the order; each partition is numbered on its
    own, and the sizes of those before it (one row a partition) are added.
    """
    if per_group:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*per_group).orderBy(*order)) - 1 + start)
    part = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).persist()
    sizes = part.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1 + start
    return part.withColumn("__own", own).join(F.broadcast(offsets), "__part").withColumn(name, (F.col("__own") + F.col("__base")).cast("long")).drop("__part", "__own", "__base")
