"""Offline feature store: Parquet partitioned by year and month."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _month_number(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts)


class OfflineStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def write(self, df: DataFrame, ts: str = "timestamp") -> None:
        """Replace each month that `df` touches; other months stay.

        The rebalance hint lets the adaptive planner split a month that holds
        most rows and merge small ones, so files come out of even size.
        """
        dated = df.withColumns({"year": F.year(ts), "month": F.month(ts)})
        (
            dated.hint("rebalance", "year", "month")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("year", "month")
            .parquet(self.path)
        )

    def table(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(self, start: str | Column, end: str | Column, zones: Sequence[str] | None = None,
             ordered: bool = True) -> DataFrame:
        """Rows from `start` to `end` (both included), of the given zones, by time.

        Month predicates are stated next to the time predicates: only those prune
        partitions, and the time predicates are pushed into the files that remain.
        """
        low, high = (F.to_timestamp_ntz(F.lit(b)) if isinstance(b, str) else b for b in (start, end))
        month = F.col("year") * 12 + F.col("month")
        rows = self.table().where(month.between(_month_number(low), _month_number(high)))
        rows = rows.where(F.col("timestamp").between(low, high))
        if zones:
            rows = rows.where(F.col("zone").isin(list(zones)))
        rows = rows.drop("year", "month")
        return rows.orderBy("timestamp") if ordered else rows

    def modified(self) -> dict[tuple[int, int], list[str]]:
        """(year, month) of the partitions with the names of their files, from the listing: no data file is opened."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())

        def values(folder, name: str) -> list[tuple[int, object]]:
            found = [s.getPath() for s in system.listStatus(folder) if s.isDirectory()]
            return [(int(f.getName().split("=")[1]), f) for f in found if f.getName().startswith(f"{name}=")]

        if not system.exists(root):
            return {}
        months = sorted(((year, month, inside) for year, folder in values(root, "year") for month, inside in values(folder, "month")), key=lambda e: e[:2])
        return {(y, m): sorted(s.getPath().getName() for s in system.listStatus(inside)) for y, m, inside in months}

    def months(self) -> list[tuple[int, int]]:
        """(year, month) of the partitions, oldest first."""
        return list(self.modified())

    def snapshot(self, hours: int = 24) -> DataFrame:
        """Rows of the last `hours` hours before the newest row of the whole store.

        The newest month is known from the listing, so only its files are read to
        find the newest timestamp, and only those of the months in reach after it.
        """
        stored = self.table()
        for year, month in reversed(self.months()):
            newest = stored.where((F.col("year") == year) & (F.col("month") == month)).agg(F.max("timestamp")).first()[0]
            if newest is not None:
                break
        else:
            return stored.drop("year", "month")
        cutoff = newest - timedelta(hours=int(hours))
        reach = F.col("year") * 12 + F.col("month") >= cutoff.year * 12 + cutoff.month
        return stored.where(reach & (F.col("timestamp") >= F.lit(cutoff).cast("timestamp_ntz"))).drop("year", "month")

    def partitions(self) -> DataFrame:
        """Rows and size in KB of each month."""
        files = self.table().select(
            "year", "month", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")
        )
        per_file = files.groupBy("year", "month", "file").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
        return (
            per_file.groupBy("year", "month")
            .agg(F.sum("n").alias("n_rows"), F.round(F.sum("size") / 1024, 1).alias("size_kb"))
            .withColumn("partition", F.concat(F.lit("year="), "year", F.lit("/month="), F.lpad(F.col("month").cast("string"), 2, "0")))
            .orderBy("year", "month")
        )
