"""Row numbers in a sorted order, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonecast.session import checkpointed


def numbered(spark: SparkSession, rows: DataFrame, order: Sequence[str], group: str | None = None, name: str = "pos") -> DataFrame:
    """Add `name`, the 0-based number of each row in `order` (nulls first) among the rows of its `group` (no nulls).

    `rows` should be a stored table. It is dealt out by range of (group, order,
    place in the table), so neither a hot group nor many equal rows meet in one
    task; rows equal in `order` keep the order of the table. What is summed to
    turn numbers inside a partition into numbers of the group has one row per
    partition and group.
    """
    keys = [*([group] if group else []), *order, "_place"]
    placed = rows.withColumn("_place", F.monotonically_increasing_id())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_place")
    stored = checkpointed(spark, dealt.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33)))
    by = [*([group] if group else []), "_part"]
    runs = stored.groupBy(*by).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*([group] if group else [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(*by, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return stored.join(starts, by).withColumn(name, F.col("_row") + F.col("_shift")).drop("_row", "_part", "_shift")
