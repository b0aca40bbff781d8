"""Queries that use the panel in several branches read the events once."""

import re

import pytest
from conftest import TESTDATA

from zonecast.plans import analysis, explaining, features, storage  # noqa: F401
from zonecast.plans.registry import QUERIES

ONCE = [
    "fourier_features", "temporal_features", "geo_features", "adjacency_demand", "panel_spine", "feature_columns", "drop_nulls",
    "target_correlation", "correlation_matrix", "moving_average_7d", "pdp", "ice", "pdp_2d", "counterfactuals",
]


def scans(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"FileScan parquet [^\n]*events\.parquet", plan))


@pytest.mark.parametrize("name", ONCE)
def test_events_are_not_read_by_the_rest_of_the_query(spark, monkeypatch, name):
    """All scans are counted: those of the frames written on the way and those of the returned plan."""
    seen = []
    from pyspark.sql.classic.dataframe import DataFrame
    from pyspark.sql.readwriter import DataFrameWriter

    write = DataFrameWriter.parquet

    def counted(self, *args, **kwargs):
        seen.append(scans(self._df))
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", counted)
    out = QUERIES[name](spark, TESTDATA)
    assert isinstance(out, DataFrame)
    assert sum(seen) + scans(out) == 1
