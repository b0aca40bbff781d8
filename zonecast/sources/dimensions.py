"""Small fixed tables as DataFrames, and the size check that lets them be broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast import fixed_values as fv

# A table made from at most this many driver-side rows may be broadcast.
BROADCAST_ROWS = 10_000


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows held by the driver as a table; broadcast only when few, else left to the planner."""
    df = spark.createDataFrame(list(rows), schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def zone_table(spark: SparkSession) -> DataFrame:
    """zone, lat, lon, zone_cluster."""
    rows = [(zone, lat, lon, fv.ZONE_CLUSTERS[zone]) for zone, (lat, lon) in fv.ZONE_CENTRES.items()]
    return small_table(spark, rows, "zone string, lat double, lon double, zone_cluster string")


def neighbour_table(spark: SparkSession, neighbours: dict[str, list[str]] | None = None) -> DataFrame:
    """Directed edges: zone, neighbour."""
    graph = fv.NEIGHBOURS if neighbours is None else neighbours
    rows = [(zone, other) for zone, others in graph.items() for other in others]
    return small_table(spark, rows, "zone string, neighbour string")


def poi_table(spark: SparkSession) -> DataFrame:
    """One row per zone, one `poi_` column per point of interest."""
    rows = []
    for zone in fv.ZONES:
        weights = []
        for home, weight in fv.POINTS_OF_INTEREST.values():
            if zone == home:
                weights.append(weight)
            elif zone in fv.NEIGHBOURS[home]:
                weights.append(weight * fv.POI_NEIGHBOUR_SHARE)
            else:
                weights.append(0.0)
        rows.append((zone, *weights))
    columns = ", ".join(f"poi_{name} double" for name in fv.POINTS_OF_INTEREST)
    return small_table(spark, rows, f"zone string, {columns}")
