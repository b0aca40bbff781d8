"""Trials side by side: the same results, and ended trials whose jobs end."""

import threading
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from zonecast.operators import ensemble as en
from zonecast.operators import folds as fd
from zonecast.operators import modeling as mo
from zonecast.operators import selecting as se
from zonecast.operators import trials as tl


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 300
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.normal(size=n), "zone": "1", "timestamp": pd.date_range("2024-01-01", periods=n, freq="h")})
    pdf["demand"] = 10 + 3 * pdf.a + rng.normal(0, 0.2, n)
    return fd.row_index(spark.createDataFrame(pdf).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))).cache()


def plan(n):
    return fd.walk_forward(n, 2, 5, 40, 100)


def test_search_gives_the_same_table_side_by_side(data):
    one, three = (se.parameter_search(data, plan, ["a", "b"], trials=4, fixed={"maxIter": 2, "maxDepth": 2}, parallel=p) for p in (1, 3))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, three.collect()))


def test_folds_give_the_same_table_side_by_side(data):
    make = lambda: mo.Booster("gbt_l1", {"maxIter": 2, "maxDepth": 2})
    one, two = (en.cross_validate(make, data, plan, ["a", "b"], parallel=p) for p in (1, 2))
    assert [tuple(r) for r in one.collect()] == [tuple(r) for r in two.collect()]


def slow(spark, seconds):
    """A job of as many seconds."""
    def wait(rows):
        for batch in rows:
            end = time.time() + seconds
            while time.time() < end:
                time.sleep(0.05)
            yield batch

    return spark.range(0, 1, 1, 1).mapInArrow(wait, "id bigint").count()


def test_the_gate_ends_the_running_jobs_of_a_trial(spark):
    search, ahead = tl.Search(spark, folds=4, warmup_trials=1, warmup_folds=0), threading.Event()

    def run_fold(trial, fold):
        if trial == 1 and fold == 2:
            ahead.set()
            slow(spark, 60)  # in the middle of a job when trial 0 brings in its first fold
        if trial == 0 and fold == 1:
            ahead.wait(30)
            time.sleep(1)
        return float(trial + fold)

    began = time.time()
    first, second = search.run(2, run_fold, parallel=2)
    assert time.time() - began < 30
    assert not first.stopped and len(first.means) == 4 and second.stopped and second.means == [2.0]
    for _ in range(50):
        active = [j for j in spark.sparkContext.statusTracker().getJobIdsForGroup(search.group(1))
                  if spark.sparkContext.statusTracker().getJobInfo(j).status == "RUNNING"]
        if not active:
            break
        time.sleep(0.1)
    assert active == []


def test_one_after_the_other_the_gate_is_that_of_the_median(spark):
    errors = {0: [1, 1, 1], 1: [3, 3, 3], 2: [2, 2, 2], 3: [0, 9, 9]}
    done = tl.Search(spark, folds=3, warmup_trials=2, warmup_folds=1).run(4, lambda t, f: float(errors[t][f - 1]))
    assert [(t.stopped, len(t.means)) for t in done] == [(False, 3), (False, 3), (False, 3), (True, 2)]


def test_a_failing_fit_is_reported_and_cancels_the_others(spark):
    def fail():
        time.sleep(1)
        raise ValueError("no rows")

    began = time.time()
    with pytest.raises(ValueError, match="no rows"):
        tl.side_by_side(spark, [lambda: slow(spark, 60), fail], 2)
    assert time.time() - began < 30
