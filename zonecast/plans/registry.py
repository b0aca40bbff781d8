"""Named queries: each runs on a folder of tables, most with the equal SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.operators import panel as pn
from zonecast.session import checkpointed
from zonecast.sources import tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows where there is one."""

    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def rides(spark: SparkSession, folder: str) -> DataFrame:
    return pn.demand_panel(spark, tables.events(spark, folder))


def stored_rides(spark: SparkSession, folder: str) -> DataFrame:
    """The panel written once, for queries that read it in several branches: the events are scanned once."""
    return checkpointed(spark, rides(spark, folder))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return pn.scored_panel(rides(spark, folder))


def rounded(value: Column | str, places: int = 6) -> Column:
    """Rounded double without a negative zero."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column.cast("double"), places) + F.lit(0.0)


def tidy(df: DataFrame, places: int = 6) -> DataFrame:
    """Whole numbers as bigint, fractions rounded, so results compare across engines."""
    out = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("double", "float"):
            out.append(rounded(column, places).alias(name))
        elif kind in ("int", "smallint", "tinyint") or kind.startswith("decimal"):
            out.append(column.cast("bigint").alias(name))
        elif kind == "timestamp":
            out.append(column.cast("timestamp_ntz").alias(name))
        else:
            out.append(column.alias(name))
    return df.select(*out)
