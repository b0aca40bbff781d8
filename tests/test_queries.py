"""Registered queries against DuckDB. By default a part of them; ALL_QUERIES=1 runs all."""

import os

import pytest
from check_queries import compare, connect
from conftest import TESTDATA

import __spark_entry__ as entry

PART = """
scan_rides offline_read online_write materialize drift_log_sink calendar_features holiday_flag fourier_features lag_features lag_features_gappy
rolling_features velocity_features zone_encode poi_proximity adjacency_demand demand_share demand_rank event_interval_join demand_factors
sequence_windows regression_metrics revenue_backtest ab_summary leaderboard champion_gate psi target_drift drift_full_report calibration_curve
temperature row_index walk_forward_folds walk_forward_hours sliding_folds purged_folds split_positional moving_average_7d demand_histogram
skewness weather_profile acf request_validate request_impute predict_with_reuse reuse_rate parse_json_events stream_sliding_1h
sink_stream_parquet stream_late_data stream_online_query pdp ice_centred shap_sample importance_report shuffle_columns voting
""".split()
ORACLES = entry.oracle_sql()
CHOSEN = sorted(ORACLES) if os.environ.get("ALL_QUERIES") else PART


@pytest.fixture(scope="module")
def duck():
    return connect(TESTDATA)


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, TESTDATA).toPandas()
    assert compare(got, duck.execute(ORACLES[name]).df()) == ""


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 14_400


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())
