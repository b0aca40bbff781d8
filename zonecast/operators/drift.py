"""Distribution drift between a reference and a current frame, and the monitoring run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonecast.functions import measures as ms
from zonecast.operators.ordering import prefix_sums, quantiles, quantiles_of_counts
from zonecast.session import checkpointed

FLOOR_SHARE = 1e-6


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value) rows of the given columns, nulls and NaN dropped."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    rows = df.select(F.explode(pairs).alias("_pair")).select("_pair.feature", "_pair.value")
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value"))


def both_sides(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, is_ref) rows of both frames."""
    ref = long_values(reference, columns).withColumn("is_ref", F.lit(True))
    cur = long_values(current, columns).withColumn("is_ref", F.lit(False))
    return ref.unionByName(cur)


def _index(pairs: Sequence[tuple[str, str]]) -> Column:
    """Sum of (actual - expected) ln(actual / expected) over (expected, actual) shares, 0 raised to 1e-6."""
    terms = []
    for expected, actual in pairs:
        e, a = (f"if({share} = 0, {FLOOR_SHARE}D, {share})" for share in (expected, actual))
        terms.append(f"({a} - {e}) * ln({a} / {e})")
    return F.expr(" + ".join(terms))


class ReferenceProfile:
    """What drift checks need to know of a reference, so that they read the current rows only.

    `values`: (feature, value, n), the rows of each value; two profiles add up to
    that of both. `bins`: per feature the quantile edges, the rows in each bin and
    in all. Index and distance are those of the reference itself.
    """

    def __init__(self, values: DataFrame, bins: DataFrame, n_bins: int):
        self.values, self.bins, self.n_bins = values, bins, n_bins

    @classmethod
    def of(cls, reference: DataFrame, columns: Sequence[str] | None = None, bins: int = 10) -> "ReferenceProfile":
        flat = long_values(reference, columns or numeric_columns(reference))
        return cls.of_counts(flat.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")), bins)

    @classmethod
    def of_counts(cls, values: DataFrame, bins: int = 10) -> "ReferenceProfile":
        edges = quantiles_of_counts(values, "value", [i / bins for i in range(bins + 1)], ["feature"], "edges").drop("n")
        placed = values.join(F.broadcast(edges), "feature")  # one row per column of the frame
        sums = [F.sum(F.when(F.expr(condition), F.col("n")).otherwise(0)).alias(f"b{i}") for i, condition in enumerate(_in_bins(bins))]
        counted = placed.groupBy("feature").agg(F.first("edges").alias("edges"), F.sum("n").alias("n_ref"), *sums)
        return cls(values, counted.select("feature", "edges", "n_ref", F.array(*[f"b{i}" for i in range(bins)]).alias("counts")), bins)

    def plus(self, other: "ReferenceProfile") -> "ReferenceProfile":
        """The profile of both references together."""
        both = self.values.unionByName(other.values).groupBy("feature", "value").agg(F.sum("n").alias("n"))
        return ReferenceProfile.of_counts(both, self.n_bins)

    def save(self, path: str) -> None:
        values = checkpointed(self.values.sparkSession, self.values)
        ReferenceProfile.of_counts(values, self.n_bins).bins.write.parquet(f"{path}/bins")
        # Last: a profile without values is not finished.
        values.repartition("feature").write.partitionBy("feature").parquet(f"{path}/values")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ReferenceProfile":
        bins = spark.read.parquet(f"{path}/bins")
        kinds = "value double, n bigint, feature string"
        first = bins.select(F.size("counts")).first()
        return cls(spark.read.schema(kinds).parquet(f"{path}/values").select("feature", "value", "n"), bins, first[0] if first else 10)

    def columns(self) -> list[str]:
        return [r["feature"] for r in self.bins.select("feature").collect()]  # one row per column


def _in_bins(bins: int, open_ends: bool = False) -> list[str]:
    """SQL for each bin whether `value` lies in it, by the array `edges`: [a, b), the last one [a, b], the outer two wider by 1e-6 or open."""
    out = []
    for i in range(bins):
        low = f"value >= edges[{i}]" if i else "true" if open_ends else "value >= edges[0] - 1e-6D"
        high = f"value < edges[{i + 1}]" if i < bins - 1 else "true" if open_ends else f"value <= edges[{bins}] + 1e-6D"
        out.append(f"{low} AND {high}")
    return out


def psi_against(profile: ReferenceProfile, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`psi_by_feature` with the reference's stored counts; only the current rows are read."""
    bins = profile.n_bins
    rows = long_values(current, columns).join(F.broadcast(profile.bins.select("feature", "edges")), "feature")
    sums = [F.sum(F.expr(f"CAST({condition} AS BIGINT)")).alias(f"cur{i}") for i, condition in enumerate(_in_bins(bins))]
    counted = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("n_cur"), *sums).join(profile.bins.drop("edges"), "feature").where("n_ref > 0")
    index = _index([(f"(counts[{i}] / n_ref)", f"(cur{i} / n_cur)") for i in range(bins)])
    return counted.select("feature", "n_ref", "n_cur", index.alias("psi"))


def psi_by_feature(reference: DataFrame | ReferenceProfile, current: DataFrame, columns: Sequence[str], bins: int = 10,
                   open_ends: bool = False) -> DataFrame:
    """Population stability index per feature: feature, n_ref, n_cur, psi.

    Bin edges are the reference's quantiles, the outer two moved out by 1e-6. A
    bin is [a, b), the last one [a, b]. Values outside count in the size but in
    no bin, unless `open_ends` puts them into the outer bins.
    """
    if isinstance(reference, ReferenceProfile):
        return psi_against(reference, current, columns)
    ref = long_values(reference, columns)
    edges = quantiles(ref, "value", [i / bins for i in range(bins + 1)], ["feature"], "edges").drop("n")
    # One row per column of the frame, so the width of the schema bounds it.
    rows = both_sides(reference, current, columns).join(F.broadcast(edges), "feature")

    sums = [F.expr("sum(CAST(is_ref AS BIGINT)) AS n_ref"), F.expr("sum(CAST(NOT is_ref AS BIGINT)) AS n_cur")]
    for i, condition in enumerate(_in_bins(bins, open_ends)):
        sums.append(F.expr(f"sum(CAST({condition} AND is_ref AS BIGINT)) AS ref{i}"))
        sums.append(F.expr(f"sum(CAST({condition} AND NOT is_ref AS BIGINT)) AS cur{i}"))
    counted = rows.groupBy("feature").agg(*sums).where("n_ref > 0 and n_cur > 0")
    index = _index([(f"(ref{i} / n_ref)", f"(cur{i} / n_cur)") for i in range(bins)])
    return counted.select("feature", "n_ref", "n_cur", index.alias("psi"))


def ks_by_feature(reference: DataFrame | ReferenceProfile, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per feature."""
    if isinstance(reference, ReferenceProfile):
        ref = reference.values.where(F.col("feature").isin(list(columns))).select("feature", "value", F.col("n").alias("r"), F.lit(0).cast("long").alias("c"))
        cur = long_values(current, columns).select("feature", "value", F.lit(0).cast("long").alias("r"), F.lit(1).cast("long").alias("c"))
        counts = ref.unionByName(cur).groupBy("feature", "value").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    else:
        counts = both_sides(reference, current, columns).groupBy("feature", "value").agg(
            F.sum(F.col("is_ref").cast("long")).alias("r"), F.sum((~F.col("is_ref")).cast("long")).alias("c")
        )
    placed = prefix_sums(counts, "value", ["r", "c"], ["feature"])
    gap = F.expr("max(abs((r_before + r) / r_total - (c_before + c) / c_total))")
    return placed.where("r_total > 0 and c_total > 0").groupBy("feature").agg(gap.alias("ks"))


def feature_drift(reference: DataFrame | ReferenceProfile, current: DataFrame, columns: Sequence[str] | None = None,
                  threshold: float = 0.2, least_rows: int = 10) -> DataFrame:
    """PSI and status of every numeric column both frames have."""
    known = reference.columns() if isinstance(reference, ReferenceProfile) else numeric_columns(reference)
    shared = columns or [c for c in known if c in current.columns]
    found = psi_by_feature(reference, current, shared).where(
        (F.col("n_ref") >= least_rows) & (F.col("n_cur") >= least_rows)
    )
    return found.select(
        "feature", F.round("psi", 4).alias("psi"), ms.drift_status(F.col("psi"), threshold).alias("status")
    )


def target_drift(reference: DataFrame | ReferenceProfile, current: DataFrame, target: str = "demand") -> DataFrame:
    psi = psi_by_feature(reference, current, [target])
    ks = ks_by_feature(reference, current, [target])
    return psi.join(ks, "feature").select(
        F.round("psi", 4).alias("psi"), F.round("ks", 4).alias("ks"), ms.drift_status(F.col("psi")).alias("status")
    )


def performance(df: DataFrame, y: str = "demand", p: str = "pred", limit: float = 0.2) -> DataFrame:
    error = F.col(y) - F.col(p)
    raw = df.agg(
        F.avg(ms.relative_error(F.col(y), F.col(p))).alias("mape"), F.sqrt(F.avg(error * error)).alias("rmse")
    )
    return raw.select(
        F.round("mape", 4).alias("mape"), F.round("rmse", 4).alias("rmse"), (F.col("mape") > limit).alias("alert")
    )


def drift_run(reference: DataFrame | ReferenceProfile, current: DataFrame, scored: DataFrame | None = None,
              columns: Sequence[str] | None = None, threshold: float = 0.2, mape_limit: float = 0.2) -> DataFrame:
    """One monitoring run as one row: counts, drifted and warned features, performance, alert, advice."""
    checks = feature_drift(reference, current, columns, threshold)

    def named(status: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("status") == status, F.col("feature"))))

    detail = F.map_from_entries(F.collect_list(F.struct("feature", F.struct("psi", "status"))))
    run = checks.agg(
        F.count(F.lit(1)).alias("n_features_checked"),
        named("drift").alias("drifted_features"),
        named("warn").alias("warned_features"),
        detail.alias("feature_drift"),
    )
    if scored is not None:
        whole = performance(scored, limit=mape_limit).select(F.struct("mape", "rmse", "alert").alias("performance"))
        run = run.withColumn("performance", whole.scalar())
    else:
        empty = F.lit(None).cast("struct<mape:double,rmse:double,alert:boolean>")
        run = run.withColumn("performance", empty)
    alert = (F.size("drifted_features") > 0) | F.coalesce(F.col("performance.alert"), F.lit(False))
    advice = (
        F.when(F.col("alert"), "RETRAIN MODEL — significant drift detected")
        .when(F.size("warned_features") > 0, "MONITOR — slight drift in some features")
        .otherwise("OK — distributions stable")
    )
    return run.withColumn("alert", alert).withColumn("recommendation", advice)


def category_psi(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """PSI over the category shares of text columns."""
    def rows(df: DataFrame, is_ref: bool) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns])
        flat = df.select(F.explode(pairs).alias("_pair")).select("_pair.feature", "_pair.value")
        return flat.where("value is not null").withColumn("is_ref", F.lit(is_ref))

    counts = rows(reference, True).unionByName(rows(current, False)).groupBy("feature", "value").agg(
        F.sum(F.col("is_ref").cast("long")).alias("r"), F.sum((~F.col("is_ref")).cast("long")).alias("c")
    )
    totals = counts.groupBy("feature").agg(F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur"))
    shares = counts.join(totals, "feature").where("n_ref > 0 and n_cur > 0")
    term = _index([("(r / n_ref)", "(c / n_cur)")])
    return shares.groupBy("feature").agg(F.sum(term).alias("psi"))


def full_report(reference: DataFrame, current: DataFrame, numeric: Sequence[str], categories: Sequence[str],
                y: str = "demand", p: str = "pred") -> DataFrame:
    """Long report (section, name, metric, value): drift per column, regression quality per side."""
    psi = psi_by_feature(reference, current, numeric).join(ks_by_feature(reference, current, numeric), "feature")
    numbers = psi.select(
        F.lit("numeric_drift").alias("section"), F.col("feature").alias("name"),
        F.explode(F.create_map(F.lit("psi"), F.col("psi"), F.lit("ks"), F.col("ks"))).alias("metric", "value"),
    )
    texts = category_psi(reference, current, categories).select(
        F.lit("category_drift").alias("section"), F.col("feature").alias("name"), F.lit("psi").alias("metric"),
        F.col("psi").alias("value"),
    )
    error = F.col(y) - F.col(p)
    sides = reference.select(y, p, F.lit("reference").alias("name")).unionByName(
        current.select(y, p, F.lit("current").alias("name"))
    )
    quality = sides.groupBy("name").agg(
        F.avg(error).alias("mean_error"), F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(ms.relative_error(F.col(y), F.col(p))).alias("mape"),
    )
    metric_map = F.create_map(*[part for m in ("mean_error", "mae", "rmse", "mape") for part in (F.lit(m), F.col(m))])
    errors = quality.select(F.lit("regression").alias("section"), "name", F.explode(metric_map).alias("metric", "value"))
    return numbers.unionByName(texts).unionByName(errors)


def retrain_gate(run: DataFrame, has_reference: bool = True, most_drifted: int = 3) -> DataFrame:
    """Train when there is no reference, when the run raised an alert, or when many features drifted."""
    if not has_reference:
        return run.select(F.lit(True).alias("train"))
    return run.select((F.col("alert") | (F.size("drifted_features") > most_drifted)).alias("train"))


LOG_SCHEMA = (
    "run_at timestamp, n_features_checked bigint, drifted_features array<string>, warned_features array<string>, "
    "feature_drift map<string, struct<psi: double, status: string>>, "
    "performance struct<mape: double, rmse: double, alert: boolean>, alert boolean, recommendation string"
)


def append_log(run: DataFrame, path: str, run_at: Column | None = None) -> None:
    """Append the run to the JSON-lines log."""
    stamped = run.withColumn("run_at", F.current_timestamp() if run_at is None else run_at)
    stamped.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path)


def drift_trend(log: DataFrame, feature: str, last_runs: int = 10) -> DataFrame:
    """PSI of one feature over the last runs; runs without the feature are left out after the cut."""
    recent = log.orderBy(F.desc("run_at")).limit(last_runs)
    return (
        recent.select("run_at", F.element_at("feature_drift", F.lit(feature))["psi"].alias("psi"))
        .where("psi is not null")
        .orderBy("run_at")
    )
