"""Readers for the raw tables, with explicit schemas where they are fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from zonecast.schema import EVENTS, RIDES


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{folder.rstrip('/')}/events.parquet")


def read_rides(spark: SparkSession, path: str) -> DataFrame:
    """A stored rides table: one row per zone and hour."""
    return spark.read.schema(RIDES).parquet(path)
