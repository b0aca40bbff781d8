import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from zonecast.session import build_session  # noqa: E402

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def frame(zones: int, hours: int, seed: int = 42) -> pd.DataFrame:
    """Panel of whole-number demand, one row per zone and hour."""
    rng = np.random.default_rng(seed)
    times = pd.date_range("2024-01-01", periods=hours, freq="h")
    rows = pd.DataFrame([(t, str(z)) for z in range(1, zones + 1) for t in times], columns=["timestamp", "zone"])
    n = len(rows)
    rows["demand"] = np.maximum(1, rng.lognormal(2.5, 0.4, n).astype(int))
    rows["weather"] = rng.choice(["clear", "rain", "cloudy"], n)
    rows["temperature_c"] = rng.normal(12, 5, n)
    rows["precipitation_mm"] = rng.exponential(1, n)
    rows["is_event"] = False
    return rows


SCHEMA = (
    "timestamp timestamp_ntz, zone string, demand bigint, weather string, temperature_c double, precipitation_mm double, is_event boolean"
)


@pytest.fixture(scope="session")
def sample_pdf():
    return frame(5, 200)


@pytest.fixture(scope="session")
def sample(spark, sample_pdf):
    return spark.createDataFrame(sample_pdf, SCHEMA).cache()
