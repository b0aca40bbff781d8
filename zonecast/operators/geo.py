"""Zone encodings, neighbour demand, points of interest, share and rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonecast import fixed_values as fv
from zonecast.sources.dimensions import neighbour_table, poi_table, zone_table


def add_zone_code(df: DataFrame, numeric: bool = False) -> DataFrame:
    """Integer code of the zone: its rank as text from 0, or zone number - 1 with `numeric`.

    The rank is taken over the distinct zones, not over the rows.
    """
    if numeric:
        return df.withColumn("zone_encoded", F.col("zone").cast("long") - 1)
    # One row per zone: at most as many as the zone dimension has.
    rank = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("zone")) - 1
    codes = df.select("zone").distinct().withColumn("zone_encoded", rank.cast("long"))
    return df.join(codes, "zone", "left")


def add_zone_cluster(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Cluster name and one 0/1 column per cluster."""
    named = df.join(zone_table(spark).select("zone", "zone_cluster"), "zone", "left")
    flags = {
        f"cluster_{c}": F.coalesce(F.col("zone_cluster") == c, F.lit(False)).cast("long") for c in fv.CLUSTERS
    }
    return named.withColumns(flags)


def add_neighbour_demand(spark: SparkSession, df: DataFrame, target: str = "demand",
                         neighbours: dict[str, list[str]] | None = None) -> DataFrame:
    """Mean over the listed neighbours of their mean demand at the same timestamp.

    Neighbours absent at a timestamp are skipped; null when none is present.
    """
    means = df.groupBy("timestamp", F.col("zone").alias("neighbour")).agg(F.avg(target).alias("_mean"))
    around = (
        means.join(neighbour_table(spark, neighbours), "neighbour")
        .groupBy("timestamp", "zone")
        .agg(F.avg("_mean").alias("adj_zone_demand"))
    )
    return df.join(around, ["timestamp", "zone"], "left")


def add_poi(spark: SparkSession, df: DataFrame) -> DataFrame:
    """One column per point of interest; 0 for zones outside its reach."""
    joined = df.join(poi_table(spark), "zone", "left")
    return joined.fillna(0.0, subset=[f"poi_{p}" for p in fv.POINTS_OF_INTEREST])


def add_share_and_rank(df: DataFrame, target: str = "demand") -> DataFrame:
    """Share of the timestamp's total demand, and descending rank (ties share the lowest rank).

    Equal values at a timestamp are combined before anything is sorted, and the
    result joins back, so a timestamp with very many rows stays spread out.
    """
    at_time = Window.partitionBy("timestamp")
    above = at_time.orderBy(F.col(target).desc()).rowsBetween(Window.unboundedPreceding, -1)
    counted = df.where(F.col(target).isNotNull()).groupBy("timestamp", target).agg(F.count(F.lit(1)).alias("_n"))
    standing = counted.select(
        "timestamp",
        target,
        (F.col(target) / (F.sum(F.col(target) * F.col("_n")).over(at_time) + 1e-6)).alias("demand_share"),
        (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).cast("double").alias("demand_rank"),
    )
    return df.join(standing, ["timestamp", target], "left")


def add_geo(spark: SparkSession, df: DataFrame, target: str = "demand") -> DataFrame:
    """All spatial features."""
    out = add_zone_cluster(spark, add_zone_code(df))
    out = add_neighbour_demand(spark, out, target)
    return add_share_and_rank(add_poi(spark, out), target)
