"""Fits side by side: trials from a bounded thread pool, each a job group in a fair scheduling pool.

Spark runs jobs of different threads at the same time; a fit of few rows leaves
most executors idle, so several fits share them. What is fitted and in which
order results are listed does not depend on the number of threads. Set
`spark.scheduler.mode` to FAIR, or the jobs of one trial are put before another's.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from statistics import median
from typing import TypeVar

from pyspark.sql import SparkSession

Result = TypeVar("Result")


def side_by_side(spark: SparkSession, calls: Sequence[Callable[[], Result]], parallel: int, label: str = "fit") -> list[Result]:
    """The results of the calls in their order, at most `parallel` of them running. One that fails cancels the others."""
    context = spark.sparkContext
    own = f"{label}-{uuid.uuid4().hex[:8]}"
    failed = threading.Event()

    def run(i: int) -> Result:
        if failed.is_set():
            raise RuntimeError("another fit has failed")
        context.setJobGroup(f"{own}-{i}", f"{label} {i}", interruptOnCancel=True)
        context.setLocalProperty("spark.scheduler.pool", f"{own}-{i}")
        try:
            return calls[i]()
        except Exception:
            if not failed.is_set():
                failed.set()
                for other in range(len(calls)):
                    if other != i:
                        context.cancelJobGroup(f"{own}-{other}")
            raise

    if parallel <= 1:
        return [call() for call in calls]
    with ThreadPoolExecutor(parallel) as pool:
        futures = [pool.submit(run, i) for i in range(len(calls))]
        errors = [f.exception() for f in futures if f.exception() is not None]
        if errors:
            # The first cause, not the cancellations that it brought about.
            raise next((e for e in errors if "cancel" not in str(e).lower() and "another fit" not in str(e)), errors[0])
        return [f.result() for f in futures]


@dataclass
class Trial:
    means: list[float] = field(default_factory=list)
    running: bool = False
    stopped: bool = False


class Search:
    """Trials over folds; a running mean of errors worse than the median of the earlier trials at that fold ends a trial.

    The gate looks at a trial whenever it or an earlier one has finished a fold, so
    a trial can be ended in the middle of a fit: its job group is cancelled. The
    first `warmup_trials` are never ended, nor is any before `warmup_folds` folds
    or in its last one.
    """

    def __init__(self, spark: SparkSession, folds: int, warmup_trials: int = 10, warmup_folds: int = 2):
        self.context, self.folds = spark.sparkContext, folds
        self.warmup_trials, self.warmup_folds = warmup_trials, warmup_folds
        self.own = f"search-{uuid.uuid4().hex[:8]}"
        self.lock = threading.Lock()
        self.trials: list[Trial] = []

    def group(self, number: int) -> str:
        return f"{self.own}-{number}"

    def _falls_behind(self, number: int) -> bool:
        own = self.trials[number]
        fold = len(own.means)
        earlier = [t.means[fold - 1] for t in self.trials[:number] if len(t.means) >= fold]
        return number >= self.warmup_trials and self.warmup_folds < fold < self.folds and bool(earlier) and own.means[-1] > median(earlier)

    def _gate(self, number: int) -> None:
        """After a result of trial `number`: end it and later ones that fall behind."""
        for n in range(number, len(self.trials)):
            trial = self.trials[n]
            if (trial.running or n == number) and not trial.stopped and trial.means and self._falls_behind(n):
                trial.stopped = True
                if n != number:
                    self.context.cancelJobGroup(self.group(n))

    def _run(self, number: int, run_fold: Callable[[int, int], float], grouped: bool) -> None:
        trial = self.trials[number]
        if grouped:
            self.context.setJobGroup(self.group(number), f"trial {number}", interruptOnCancel=True)
            self.context.setLocalProperty("spark.scheduler.pool", self.group(number))
        trial.running = True
        errors: list[float] = []
        try:
            for fold in range(1, self.folds + 1):
                errors.append(run_fold(number, fold))
                with self.lock:
                    if trial.stopped:
                        return
                    trial.means.append(sum(errors) / len(errors))
                    self._gate(number)
                    if trial.stopped:
                        return
        except Exception:
            if not trial.stopped:
                raise
        finally:
            trial.running = False

    def run(self, trials: int, run_fold: Callable[[int, int], float], parallel: int = 1) -> list[Trial]:
        """`run_fold(trial, fold)` gives the error of a fold (from 1); trials in their order."""
        self.trials = [Trial() for _ in range(trials)]
        if parallel <= 1:
            for n in range(trials):
                self._run(n, run_fold, False)
        else:
            with ThreadPoolExecutor(parallel) as pool:
                for done in [pool.submit(self._run, n, run_fold, True) for n in range(trials)]:
                    done.result()
        return self.trials
