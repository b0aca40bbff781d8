"""Queries on evaluation, pricing, drift, calibration, folds and exploration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast import fixed_values as fv
from zonecast.operators import calibrate as cal
from zonecast.operators import drift as dr
from zonecast.operators import evaluate as ev
from zonecast.operators import explore as eda
from zonecast.operators import folds as fd
from zonecast.operators import panel as pn
from zonecast.operators import pricing as pr
from zonecast.operators import temporal as tp
from zonecast.plans import sql as q
from zonecast.plans.features import KEYS, all_features, pick
from zonecast.plans.registry import query, rides, rounded, scored, tidy
from zonecast.plans.storage import CUT, DRIFT_COLUMNS, SIDES, sides
from zonecast.session import checkpointed, new_dir

# Evaluation ---------------------------------------------------------------------


@query("regression_metrics", q.with_scored(f"SELECT {q.metrics(prefix='all_')} FROM scored"))
def regression_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(ev.metrics(scored(spark, folder), prefix="all", places=7), 7)


@query("pinball_loss", q.with_scored(f"SELECT {q.r('avg(greatest(0.5 * (demand - pred), -0.5 * (demand - pred)))')} AS pinball FROM scored"))
def pinball_loss(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(ev.pinball_loss(scored(spark, folder), 0.5))


@query("winkler_score", q.with_scored(
    f"SELECT {q.r('''avg(pred * 1.2 - pred * 0.8 + CASE WHEN demand < pred * 0.8 THEN 20.0 * (pred * 0.8 - demand) WHEN demand > pred * 1.2 THEN 20.0 * (demand - pred * 1.2) ELSE 0 END)''')} AS winkler FROM scored"
))
def winkler_score(spark: SparkSession, folder: str) -> DataFrame:
    banded = scored(spark, folder).withColumns({"low": F.col("pred") * 0.8, "high": F.col("pred") * 1.2})
    return tidy(ev.winkler_score(banded, "low", "high", 0.1))


@query("metrics_by_zone", q.with_scored(f"SELECT zone, {q.metrics()}, count(*) AS n_samples FROM scored GROUP BY zone"))
def metrics_by_zone(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(ev.metrics_by(scored(spark, folder), ["zone"], places=7), 7)


@query("metrics_by_hour", q.with_scored(f"SELECT hour(timestamp) AS hour, {q.metrics()}, count(*) AS n_samples FROM scored GROUP BY 1"))
def metrics_by_hour(spark: SparkSession, folder: str) -> DataFrame:
    with_hour = scored(spark, folder).withColumn("hour", F.hour("timestamp").cast("bigint"))
    return tidy(ev.metrics_by(with_hour, ["hour"], places=7), 7)


PRICED = q.SCORED + f""",
baseline AS (SELECT zone, median(demand) AS b FROM scored GROUP BY zone),
priced AS (SELECT s.*, b, {q.surge('demand', 'b')} AS sa, {q.surge('greatest(pred, 0.0)', 'b')} AS sp
           FROM scored s JOIN baseline ON baseline.zone = s.zone)"""


@query("revenue_backtest", f"""WITH {PRICED} SELECT {q.r('sum(demand * 8.0::DOUBLE * sa)', 2)} AS total_revenue_perfect_eur,
{q.r('sum(demand * 8.0::DOUBLE * sp)', 2)} AS total_revenue_model_eur,
{q.r('sum(demand * sp) / sum(demand * sa)', 4)} AS revenue_efficiency,
{q.r('sum(demand * 8.0::DOUBLE * sa) - sum(demand * 8.0::DOUBLE * sp)', 2)} AS revenue_loss_eur,
{q.r('avg(sa)', 3)} AS mean_surge_actual, {q.r('avg(sp)', 3)} AS mean_surge_pred FROM priced""")
def revenue_backtest(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(ev.revenue_backtest(scored(spark, folder)), 4)


@query("zone_baseline", q.with_rides("SELECT zone, CAST(median(demand) AS DOUBLE) AS baseline FROM rides GROUP BY zone"))
def zone_baseline(spark: SparkSession, folder: str) -> DataFrame:
    return pr.zone_baseline(rides(spark, folder))


@query("baseline_join", q.with_rides("""SELECT r.timestamp AS timestamp, r.zone AS zone, demand, coalesce(CAST(b AS DOUBLE), 10.0::DOUBLE) AS baseline
FROM rides r LEFT JOIN (SELECT zone, median(demand) AS b FROM rides WHERE zone <> '20' GROUP BY zone) m ON m.zone = r.zone"""))
def baseline_join(spark: SparkSession, folder: str) -> DataFrame:
    """Zone 20 has no learned baseline and gets the default."""
    panel = rides(spark, folder)
    known = pr.zone_baseline(panel.where("zone <> '20'"))
    return pr.with_baseline(panel, known).select(*KEYS, "demand", "baseline")


@query("surge_multiplier", f"WITH {PRICED} SELECT timestamp, zone, demand, sa AS surge_multiplier FROM priced")
def surge_multiplier(spark: SparkSession, folder: str) -> DataFrame:
    df = scored(spark, folder)
    out = pr.price(pr.with_baseline(df, pr.zone_baseline(df)), "demand")
    return out.select(*KEYS, "demand", "surge_multiplier")


@query("price", f"""WITH {PRICED} SELECT timestamp, zone, 8.0::DOUBLE AS base_price, sp AS surge_multiplier,
{q.r('8.0 * sp', 2)} AS final_price, {q.r('pred / (b + 1e-3)', 3)} AS demand_ratio FROM priced""")
def price(spark: SparkSession, folder: str) -> DataFrame:
    df = scored(spark, folder)
    out = pr.price(pr.with_baseline(df, pr.zone_baseline(df)), "pred")
    return tidy(out.select(*KEYS, "base_price", "surge_multiplier", "final_price", "demand_ratio"))


BUCKET = "(('0x' || substr(md5(zone), 1, 8))::BIGINT % 100)"
ROUTED = q.SCORED + f""",
ba AS (SELECT zone, median(demand) AS b FROM scored GROUP BY zone),
bb AS (SELECT zone, avg(demand) AS b FROM scored GROUP BY zone),
routed AS (SELECT timestamp, zone, variant, b, pred, {q.surge('pred', 'b')} AS s FROM
  (SELECT s.timestamp, s.zone AS zone, pred, CASE WHEN {BUCKET.replace('zone', 's.zone')} < 50 THEN 'A' ELSE 'B' END AS variant,
          CASE WHEN {BUCKET.replace('zone', 's.zone')} < 50 THEN ba.b ELSE bb.b END AS b
   FROM scored s JOIN ba ON ba.zone = s.zone JOIN bb ON bb.zone = s.zone))"""


def routed(spark: SparkSession, folder: str) -> DataFrame:
    """Variant A prices from the median, variant B from the mean of the zone's demand."""
    df = scored(spark, folder)
    means = df.groupBy("zone").agg(F.avg("demand").alias("mean_demand"))
    both = pr.with_baseline(df, pr.zone_baseline(df)).withColumnRenamed("baseline", "median_demand").join(means, "zone")
    return pr.ab_route(both, "pred", F.col("median_demand"), F.col("mean_demand"))


@query("ab_route", f"""WITH {ROUTED} SELECT timestamp, zone, variant, s AS surge_multiplier, {q.r('8.0 * s', 2)} AS final_price,
{q.r('pred / (b + 1e-3)', 3)} AS demand_ratio FROM routed""")
def ab_route(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(routed(spark, folder).select(*KEYS, "variant", "surge_multiplier", "final_price", "demand_ratio"))


@query("ab_summary", f"""WITH {ROUTED} SELECT variant, count(*) AS n_requests, {q.r('avg(8.0 * s)', 2)} AS mean_price,
{q.r('avg(s)', 2)} AS mean_surge, {q.r('avg(CASE WHEN s > 1 THEN 1.0 ELSE 0.0 END)', 3)} AS pct_surged FROM routed GROUP BY variant""")
def ab_summary(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(pr.ab_summary(routed(spark, folder)), 4)


MODELS = {"seasonal": "pred", "naive": "l1", "mean": "m24"}
MODEL_SCORES = q.RIDES + f""",
base AS (SELECT *, coalesce(CAST(lag(demand, 24) OVER w AS DOUBLE), avg(demand) OVER t) AS pred, CAST(lag(demand, 1) OVER w AS DOUBLE) AS l1,
         avg(demand) OVER t AS m24 FROM rides
         WINDOW w AS ({q.BY_ZONE}), t AS ({q.BY_ZONE} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
model_scores AS ({' UNION ALL '.join(f"SELECT '{m}' AS model, {q.metrics(p=c)} FROM base WHERE l1 IS NOT NULL" for m, c in MODELS.items())})"""


def model_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of three simple forecasts: a day ago, an hour ago, mean of the last day."""
    from zonecast.operators.history import over_history

    def columns(w):
        recent = F.avg("demand").over(w.rowsBetween(-24, -1))
        return {
            "pred": F.coalesce(F.lag("demand", 24).over(w).cast("double"), recent),
            "l1": F.lag("demand", 1).over(w).cast("double"), "m24": recent,
        }

    base = over_history(rides(spark, folder), columns, 24, dense=True).where("l1 is not null")
    forecasts = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("p")) for m, c in MODELS.items()])
    flat = base.select("demand", F.explode(forecasts).alias("f")).select("demand", "f.model", "f.p")
    return ev.metrics_by(flat, ["model"], p="p", places=7).drop("n_samples")


def _mark(metric: str) -> str:
    best = f"{'max' if metric == 'r2' else 'min'}({metric}) OVER ()"
    close = f" WHEN {metric} <= {best} * 1.05 THEN 'close'" if metric in ev.LOWER_IS_BETTER else ""
    return f"CASE WHEN {metric} = {best} THEN 'best'{close} ELSE '' END AS {metric}_mark"


@query("leaderboard", f"""WITH {MODEL_SCORES} SELECT *, row_number() OVER (ORDER BY mape, model) AS rank,
{', '.join(_mark(m) for m in ev.RANKED_METRICS)} FROM model_scores""")
def leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(ev.leaderboard(model_scores(spark, folder)), 7)


@query("best_model", f"WITH {MODEL_SCORES} SELECT arg_min(model, mape) AS model, min(mape) AS mape FROM model_scores")
def best_model(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(ev.best_model(model_scores(spark, folder)), 7)


@query("champion_gate", f"""WITH {MODEL_SCORES},
old AS (SELECT min(mape) AS m FROM model_scores WHERE model = 'naive'),
new AS (SELECT arg_min(model, mape) AS model, min(mape) AS m FROM model_scores WHERE model <> 'naive')
SELECT new.model AS challenger, new.m AS new_mape, old.m AS champion_mape, {q.r('(old.m - new.m) / old.m', 7)} AS improvement,
(old.m - new.m) / old.m > 0.01 AS promote FROM old, new""")
def champion_gate(spark: SparkSession, folder: str) -> DataFrame:
    scores = model_scores(spark, folder)
    return tidy(ev.champion_gate(scores.where("model = 'naive'"), scores.where("model <> 'naive'")), 7)


# Drift --------------------------------------------------------------------------

DRIFT = f"WITH {q.RIDES}, {SIDES}, {q.psi('reference', 'current_rows', DRIFT_COLUMNS)}"


@query("psi", DRIFT + f" SELECT feature, n_ref, n_cur, {q.r('psi')} AS psi FROM psi")
def psi(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(dr.psi_by_feature(*sides(checkpointed(spark, rides(spark, folder))), DRIFT_COLUMNS))


STATUS = "CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.2 THEN 'warn' ELSE 'drift' END"
FEATURE_SIDES = f"""
exact AS (SELECT timestamp, {', '.join(f"round({f}, 9) AS {f}" for f in q.ALL_FEATURES)} FROM features),
reference AS (SELECT * FROM exact WHERE timestamp < TIMESTAMP '{CUT}'),
current_rows AS (SELECT * FROM exact WHERE timestamp >= TIMESTAMP '{CUT}')"""
SHARED = q.ALL_FEATURES


@query("feature_drift", f"""WITH {q.FEATURES}, {FEATURE_SIDES}, {q.psi('reference', 'current_rows', SHARED)}
SELECT feature, {q.r('psi', 4)} AS psi, {STATUS} AS status FROM psi WHERE n_ref >= 10 AND n_cur >= 10""")
def feature_drift(spark: SparkSession, folder: str) -> DataFrame:
    """All features, constant ones with an index of 0. Rounded to 9 places: many values sit exactly on a bin edge, where the last
    bits of a deviation would decide the bin.
    """
    table = checkpointed(spark, pick(all_features(spark, folder), SHARED, 9))
    return tidy(dr.feature_drift(*sides(table), SHARED), 4)


@query("drift_status", DRIFT + f" SELECT feature, {STATUS} AS status FROM psi")
def drift_status(spark: SparkSession, folder: str) -> DataFrame:
    return dr.feature_drift(*sides(checkpointed(spark, rides(spark, folder))), DRIFT_COLUMNS).select("feature", "status")


@query("target_drift", f"""WITH {q.RIDES}, {SIDES}, {q.psi('reference', 'current_rows', ['demand'])}, {q.ks('reference', 'current_rows', ['demand'])}
SELECT {q.r('psi', 4)} AS psi, {q.r('ks', 4)} AS ks, {STATUS} AS status FROM psi JOIN ks ON ks.feature = psi.feature""")
def target_drift(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(dr.target_drift(*sides(rides(spark, folder))), 4)


@query("performance_check", q.with_scored(
    f"SELECT {q.r('avg(abs((demand - pred) / (abs(demand) + 1.0)))', 4)} AS mape, {q.r('sqrt(avg((demand - pred) * (demand - pred)))', 4)} AS rmse, "
    "avg(abs((demand - pred) / (abs(demand) + 1.0))) > 0.2 AS alert FROM scored"
))
def performance_check(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(dr.performance(scored(spark, folder)), 4)


SCORED_SIDES = f"""
reference AS (SELECT * FROM scored WHERE timestamp < TIMESTAMP '{CUT}'),
current_rows AS (SELECT * FROM scored WHERE timestamp >= TIMESTAMP '{CUT}')"""

RUN_SQL = f"""WITH {q.SCORED}, {SCORED_SIDES}, {q.psi('reference', 'current_rows', DRIFT_COLUMNS)},
perf AS (SELECT avg(abs((demand - pred) / (abs(demand) + 1.0))) AS mape FROM current_rows),
run AS (SELECT count(*) AS n_features_checked,
        coalesce(string_agg(CASE WHEN psi >= 0.2 THEN feature END, ',' ORDER BY feature), '') AS drifted,
        coalesce(string_agg(CASE WHEN psi >= 0.1 AND psi < 0.2 THEN feature END, ',' ORDER BY feature), '') AS warned,
        count(*) FILTER (psi >= 0.2) AS n_drifted FROM psi),
whole AS (SELECT run.*, {q.r('mape', 4)} AS mape, n_drifted > 0 OR mape > 0.2 AS alert FROM run, perf)"""


def drift_once(spark: SparkSession, folder: str) -> DataFrame:
    table = checkpointed(spark, scored(spark, folder))
    reference, current = sides(table)
    return dr.drift_run(reference, current, current, DRIFT_COLUMNS)


@query("drift_run", RUN_SQL + """ SELECT n_features_checked, drifted, warned, mape, alert,
CASE WHEN alert THEN 'RETRAIN MODEL — significant drift detected' WHEN warned <> '' THEN 'MONITOR — slight drift in some features'
     ELSE 'OK — distributions stable' END AS recommendation FROM whole""")
def drift_run(spark: SparkSession, folder: str) -> DataFrame:
    return drift_once(spark, folder).select(
        "n_features_checked", F.array_join("drifted_features", ",").alias("drifted"),
        F.array_join("warned_features", ",").alias("warned"), rounded("performance.mape", 4).alias("mape"), "alert", "recommendation",
    )


@query("retrain_gate", RUN_SQL + " SELECT alert OR n_drifted > 3 AS train FROM whole")
def retrain_gate(spark: SparkSession, folder: str) -> DataFrame:
    return dr.retrain_gate(drift_once(spark, folder))


def _category(column: str) -> str:
    return f"""SELECT 'category_drift' AS section, '{column}' AS name, 'psi' AS metric, sum((a - e) * ln(a / e)) AS value FROM (
SELECT greatest(count(*) FILTER (timestamp < TIMESTAMP '{CUT}') / (SELECT count(*) FROM reference), 1e-6) AS e,
       greatest(count(*) FILTER (timestamp >= TIMESTAMP '{CUT}') / (SELECT count(*) FROM current_rows), 1e-6) AS a
FROM scored GROUP BY {column})"""


ERRORS = {
    "mean_error": "avg(demand - pred)", "mae": "avg(abs(demand - pred))", "rmse": "sqrt(avg((demand - pred) * (demand - pred)))",
    "mape": "avg(abs((demand - pred) / (abs(demand) + 1.0)))",
}


@query("drift_full_report", f"""WITH {q.SCORED}, {SCORED_SIDES}, {q.psi('reference', 'current_rows', DRIFT_COLUMNS)},
{q.ks('reference', 'current_rows', DRIFT_COLUMNS)}, report AS (
SELECT 'numeric_drift' AS section, feature AS name, 'psi' AS metric, psi AS value FROM psi
UNION ALL SELECT 'numeric_drift', feature, 'ks', ks FROM ks UNION ALL {_category('weather')} UNION ALL {_category('zone')} UNION ALL """
       + " UNION ALL ".join(
           f"SELECT 'regression', '{n}', '{m}', {e} FROM {t}"
           for n, t in (("reference", "reference"), ("current", "current_rows")) for m, e in ERRORS.items()
       ) + f") SELECT section, name, metric, {q.r('value')} AS value FROM report")
def drift_full_report(spark: SparkSession, folder: str) -> DataFrame:
    table = checkpointed(spark, scored(spark, folder))
    return tidy(dr.full_report(*sides(table), DRIFT_COLUMNS, ["weather", "zone"]))


# Calibration --------------------------------------------------------------------


@query("calibration_curve", f"""WITH {q.SCORED},
edge_list AS (SELECT list_distinct(quantile_cont(pred, [{', '.join(repr(i / 20) for i in range(21))}])) AS e FROM scored),
placed AS (SELECT pred, demand, greatest(len(list_filter(e, lambda x: x < pred)), 1) AS bin FROM scored, edge_list)
SELECT CAST(bin AS BIGINT) AS bin, {q.r('avg(pred)')} AS mean_pred, {q.r('avg(demand)')} AS mean_actual, count(*) AS count,
{q.r('avg(pred) - avg(demand)')} AS bias FROM placed GROUP BY bin""")
def calibration_curve(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(cal.calibration_curve(scored(spark, folder)))


@query("temperature", q.with_scored(
    f"SELECT {q.r('least(greatest(sum(pred * pred) / sum(pred * demand), 0.1), 10.0)')} AS temperature FROM scored"
))
def temperature(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(cal.temperature(scored(spark, folder)))


# The fitted level of a prediction is the largest, over starts at or before it, of the smallest mean from there to an end at or after it.
ISOTONIC = f"""WITH {q.SCORED}, points AS (SELECT pred, sum(demand)::DOUBLE AS s, count(*) AS n, row_number() OVER (ORDER BY pred) AS i FROM scored GROUP BY pred),
sums AS (SELECT pred, i, sum(s) OVER (ORDER BY i) AS cs, sum(n) OVER (ORDER BY i) AS cn, s, n FROM points),
spans AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS m FROM sums a JOIN sums b ON a.i <= b.i),
least_ends AS (SELECT a, b AS i, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM spans),
levels AS (SELECT i, max(m) AS level FROM least_ends GROUP BY i)"""


@query("isotonic", ISOTONIC + f" SELECT timestamp, zone, demand, {q.r('x.pred')} AS pred, {q.r('level')} AS calibrated FROM scored x JOIN points p ON p.pred = x.pred JOIN levels l ON l.i = p.i")
def isotonic(spark: SparkSession, folder: str) -> DataFrame:
    df = scored(spark, folder)
    return tidy(cal.Isotonic().fit(df).transform(df).select(*KEYS, "demand", "pred", "calibrated"))


@query("isotonic_blocks", ISOTONIC + f" SELECT {q.r('min(pred)')} AS low, {q.r('max(pred)')} AS high, {q.r('level')} AS mean FROM levels JOIN points USING (i) GROUP BY round(level, 9), level")
def isotonic_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of the non-decreasing map, pooled in parts and merged at their borders."""
    return tidy(cal.isotonic_blocks(scored(spark, folder)))


@query("drift_from_profile", f"""WITH {q.RIDES}, {SIDES}, {q.psi('reference', 'current_rows', DRIFT_COLUMNS)}, {q.ks('reference', 'current_rows', DRIFT_COLUMNS)}
SELECT psi.feature AS feature, n_ref, n_cur, {q.r('psi')} AS psi, {q.r('ks')} AS ks FROM psi JOIN ks ON ks.feature = psi.feature""")
def drift_from_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Drift of the current rows against a stored profile of the reference, itself added up from two halves."""
    reference, current = sides(checkpointed(spark, rides(spark, folder)))
    odd = F.col("zone").cast("int") % 2 == 1
    path = new_dir(spark, "profile")
    dr.ReferenceProfile.of(reference.where(odd), DRIFT_COLUMNS).plus(dr.ReferenceProfile.of(reference.where(~odd), DRIFT_COLUMNS)).save(path)
    profile = dr.ReferenceProfile.load(spark, path)
    return tidy(dr.psi_by_feature(profile, current, DRIFT_COLUMNS).join(dr.ks_by_feature(profile, current, DRIFT_COLUMNS), "feature"))


@query("platt")
def platt(spark: SparkSession, folder: str) -> DataFrame:
    df = scored(spark, folder)
    return cal.Sigmoid().fit(df).transform(df).select(*KEYS, "demand", "pred", "calibrated")


@query("compare_calibrators")
def compare_calibrators(spark: SparkSession, folder: str) -> DataFrame:
    return cal.compare_calibrators(checkpointed(spark, scored(spark, folder)))


# Folds --------------------------------------------------------------------------

INDEXED = q.RIDES + ", indexed AS (SELECT timestamp, zone, demand, row_number() OVER (ORDER BY timestamp, zone) - 1 AS row_id FROM rides), " \
    "total AS (SELECT count(*) AS n FROM rides)"


@query("row_index", f"WITH {INDEXED} SELECT timestamp, zone, row_id FROM indexed")
def row_index(spark: SparkSession, folder: str) -> DataFrame:
    return fd.row_index(rides(spark, folder)).select(*KEYS, "row_id")


def fold_sql(bounds: str, train: str, source: str = INDEXED) -> str:
    return f"""WITH {source}, bounds AS ({bounds}),
used AS (SELECT fold, 'train' AS role, row_id FROM indexed JOIN bounds ON {train}
         UNION ALL SELECT fold, 'val', row_id FROM indexed JOIN bounds ON row_id >= vs AND row_id < ve)
SELECT fold, role, count(*) AS n_rows, min(row_id) AS first_row, max(row_id) AS last_row FROM used GROUP BY fold, role"""


def indexed(spark: SparkSession, folder: str) -> DataFrame:
    return fd.row_index(rides(spark, folder).select(*KEYS, "demand"))


def assigned(df: DataFrame, plan: fd.Plan) -> DataFrame:
    return tidy(fd.fold_sizes(fd.assign(df, plan)))


@query("walk_forward_folds", fold_sql(
    "SELECT f + 1 AS fold, 2000 + (n - 2000 - 24 - 5 * 1000) * f // 4 AS te, 2000 + (n - 2000 - 24 - 5 * 1000) * f // 4 + 24 AS vs, "
    "least(2000 + (n - 2000 - 24 - 5 * 1000) * f // 4 + 1024, n) AS ve FROM total, range(5) t(f)", "row_id < te"
))
def walk_forward_folds(spark: SparkSession, folder: str) -> DataFrame:
    return assigned(indexed(spark, folder), lambda n: fd.walk_forward(n, 5, 24, 1000, 2000))


@query("walk_forward_hours", fold_sql(
    "SELECT f + 1 AS fold, 200 + (n - 200 - 24 - 4 * 48) * f // 3 AS te, 200 + (n - 200 - 24 - 4 * 48) * f // 3 + 24 AS vs, "
    "least(200 + (n - 200 - 24 - 4 * 48) * f // 3 + 72, n) AS ve FROM total, range(4) t(f)", "row_id < te",
    q.RIDES + ", indexed AS (SELECT timestamp, dense_rank() OVER (ORDER BY timestamp) - 1 AS row_id FROM rides), "
    "total AS (SELECT count(DISTINCT timestamp) AS n FROM rides)",
))
def walk_forward_hours(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes and gap counted in hours instead of rows."""
    df = fd.time_index(rides(spark, folder).select(*KEYS, "demand"))
    return tidy(fd.fold_sizes(fd.assign(df, lambda n: fd.walk_forward(n, 4, 24, 48, 200), fd.step_count(df))))


@query("sliding_folds", fold_sql(
    "SELECT f + 1 AS fold, f * ((n - 5000 - 24 - 1000) // 5) AS ts, f * ((n - 5000 - 24 - 1000) // 5) + 5000 AS te, "
    "f * ((n - 5000 - 24 - 1000) // 5) + 5024 AS vs, f * ((n - 5000 - 24 - 1000) // 5) + 6024 AS ve FROM total, range(5) t(f) "
    "WHERE f * ((n - 5000 - 24 - 1000) // 5) + 6024 <= n", "row_id >= ts AND row_id < te"
))
def sliding_folds(spark: SparkSession, folder: str) -> DataFrame:
    return assigned(indexed(spark, folder), lambda n: fd.sliding(n, 5, 5000, 1000, 24))


PURGED = ("SELECT f + 1 AS fold, greatest(0, f * (n // 5) - 24) AS ps, least(n, f * (n // 5) + n // 5 + CAST(floor((n // 5) * 0.01) AS BIGINT)) AS pe, "
          "f * (n // 5) AS vs, f * (n // 5) + n // 5 AS ve FROM total, range(5) t(f)")


@query("purged_folds", fold_sql(PURGED, "row_id < ps OR row_id >= pe"))
def purged_folds(spark: SparkSession, folder: str) -> DataFrame:
    return assigned(indexed(spark, folder), lambda n: fd.purged(n, 5, 24, 0.01))


@query("fold_assign", f"""WITH {INDEXED}, bounds AS ({PURGED})
SELECT timestamp, zone, row_id, fold, 'val' AS role FROM indexed JOIN bounds ON row_id >= vs AND row_id < ve
UNION ALL SELECT timestamp, zone, row_id, fold, 'train' FROM indexed JOIN bounds ON row_id < ps OR row_id >= pe""")
def fold_assign(spark: SparkSession, folder: str) -> DataFrame:
    df = indexed(spark, folder)
    return tidy(fd.assign(df, lambda n: fd.purged(n, 5, 24, 0.01)).select(*KEYS, "row_id", "fold", "role"))


@query("purged_train_union", f"""WITH {INDEXED}, bounds AS ({PURGED})
SELECT fold, row_id FROM indexed JOIN bounds ON row_id < ps UNION ALL SELECT fold, row_id FROM indexed JOIN bounds ON row_id >= pe""")
def purged_train_union(spark: SparkSession, folder: str) -> DataFrame:
    df = indexed(spark, folder)
    return tidy(fd.assign(df, lambda n: fd.purged(n, 5, 24, 0.01)).where("role = 'train'").select("fold", "row_id"))


@query("split_by_date", q.with_rides("""SELECT CASE WHEN timestamp < TIMESTAMP '2024-01-20' THEN 'train' WHEN timestamp < TIMESTAMP '2024-01-25'
THEN 'val' ELSE 'test' END AS part, count(*) AS n_rows, CAST(sum(demand) AS BIGINT) AS total FROM rides GROUP BY 1"""))
def split_by_date(spark: SparkSession, folder: str) -> DataFrame:
    parts = fd.split_by_date(rides(spark, folder), "2024-01-20", "2024-01-25")
    whole = None
    for name, df in parts.items():
        labelled = df.select(F.lit(name).alias("part"), "demand")
        whole = labelled if whole is None else whole.unionByName(labelled)
    return whole.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("demand").alias("total"))


@query("split_positional", q.with_rides("""SELECT part, count(*) AS n_rows, min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM (
SELECT timestamp, CASE WHEN b < floor(n * 0.70::DOUBLE) THEN 'train' WHEN b < floor(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS part FROM (
SELECT timestamp, rank() OVER (ORDER BY timestamp) - 1 AS b, count(*) OVER () AS n FROM rides)) GROUP BY part"""))
def split_positional(spark: SparkSession, folder: str) -> DataFrame:
    return fd.split_report(fd.split_positional(rides(spark, folder).select(*KEYS)))


def _summary(metric: str) -> str:
    parts = {
        "count": f"count({metric})", "mean": f"avg({metric})", "std": f"stddev_samp({metric})", "min": f"min({metric})",
        "p25": f"quantile_cont({metric}, 0.25)", "p50": f"quantile_cont({metric}, 0.5)", "p75": f"quantile_cont({metric}, 0.75)", "max": f"max({metric})",
    }
    return f"SELECT '{metric}' AS metric, " + ", ".join(f"{q.r(e, 4)} AS {n}" for n, e in parts.items()) + " FROM per_fold"


@query("cv_summary", f"""WITH {q.SCORED}, indexed AS (SELECT *, row_number() OVER (ORDER BY timestamp, zone) - 1 AS row_id FROM scored),
total AS (SELECT count(*) AS n FROM scored), bounds AS ({PURGED}),
per_fold AS (SELECT fold, {q.metrics()} FROM indexed JOIN bounds ON row_id >= vs AND row_id < ve GROUP BY fold)
""" + " UNION ALL ".join(_summary(m) for m in ("rmse", "mape", "mae")))
def cv_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of the seasonal forecast on the validation rows of purged folds."""
    df = fd.row_index(scored(spark, folder))
    val = fd.assign(df, lambda n: fd.purged(n, 5, 24, 0.01)).where("role = 'val'")
    return tidy(fd.cv_summary(ev.metrics_by(val, ["fold"], places=7), ["rmse", "mape", "mae"]), 4)


# Exploration --------------------------------------------------------------------


@query("dataset_summary", q.with_rides(
    "SELECT count(*) AS n_rows, count(DISTINCT zone) AS n_zones, date_trunc('day', min(timestamp))::TIMESTAMP AS first_day, date_trunc('day', max(timestamp))::TIMESTAMP AS last_day FROM rides"
))
def dataset_summary(spark: SparkSession, folder: str) -> DataFrame:
    out = eda.dataset_summary(rides(spark, folder))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_day", "last_day")})


@query("describe", q.with_rides("SELECT feature, count(*) AS count, " + ", ".join(
    f"{q.r(e, 2)} AS {n}" for n, e in {
        "mean": "avg(value)", "std": "stddev_samp(value)", "min": "min(value)", "p25": "quantile_cont(value, 0.25)",
        "p50": "quantile_cont(value, 0.5)", "p75": "quantile_cont(value, 0.75)", "max": "max(value)",
    }.items()
) + " FROM " + q.unpivot("rides", ["demand", "temperature_c", "wind_speed_kmh"]) + " GROUP BY feature"))
def describe(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(eda.describe(rides(spark, folder), ["demand", "temperature_c", "wind_speed_kmh"]), 2)


@query("demand_heatmap", q.with_rides("SELECT isodow(timestamp) - 1 AS day_of_week, " + ", ".join(
    q.r(f"avg(demand) FILTER (hour(timestamp) = {h})") + f" AS h{h:02d}" for h in range(24)
) + " FROM rides GROUP BY 1"))
def demand_heatmap(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(eda.heatmap(rides(spark, folder)))


@query("zone_profile", q.with_rides(
    f"SELECT zone, {q.r('avg(demand)', 2)} AS mean, {q.r('stddev_samp(demand)', 2)} AS std, max(demand) AS max FROM rides GROUP BY zone"
))
def zone_profile(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(eda.zone_profile(rides(spark, folder)), 2)


@query("weather_profile", q.with_rides(
    f"SELECT weather, {q.r('avg(demand)', 2)} AS mean, {q.r('median(demand)', 2)} AS median, count(*) AS count FROM rides GROUP BY weather"
))
def weather_profile(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(eda.weather_profile(rides(spark, folder)), 2)


@query("daily_total", q.with_rides("SELECT date_trunc('day', timestamp)::TIMESTAMP AS day, CAST(sum(demand) AS BIGINT) AS demand FROM rides GROUP BY 1"))
def daily_total(spark: SparkSession, folder: str) -> DataFrame:
    return eda.daily_total(rides(spark, folder)).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("moving_average_7d", q.with_rides(f"""SELECT day, demand, {q.r('CASE WHEN count(*) OVER w = 7 THEN avg(demand) OVER w END')} AS moving_average FROM (
SELECT date_trunc('day', timestamp)::TIMESTAMP AS day, CAST(sum(demand) AS BIGINT) AS demand FROM rides GROUP BY 1)
WINDOW w AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"""))
def moving_average_7d(spark: SparkSession, folder: str) -> DataFrame:
    out = eda.moving_average(checkpointed(spark, eda.daily_total(rides(spark, folder))))
    return tidy(out.withColumn("day", F.col("day").cast("timestamp_ntz")))


@query("event_lift", q.with_rides(f"""SELECT count(*) FILTER (is_event) AS n_event, count(*) FILTER (NOT is_event) AS n_other,
{q.r('avg(demand) FILTER (is_event)')} AS mean_event, {q.r('avg(demand) FILTER (NOT is_event)')} AS mean_other,
{q.r('avg(demand) FILTER (is_event) / avg(demand) FILTER (NOT is_event)')} AS lift FROM rides"""))
def event_lift(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(eda.event_lift(rides(spark, folder)))


@query("demand_histogram", q.with_rides(" UNION ALL ".join(f"""SELECT '{name}' AS scale, CAST(b AS BIGINT) AS bin, {q.r('lo + b * (hi - lo) / 50')} AS left_edge,
{q.r('lo + (b + 1) * (hi - lo) / 50')} AS right_edge, (SELECT count(*) FROM rides WHERE least(floor(({x} - lo) / (hi - lo) * 50), 49) = b) AS n
FROM range(50) t(b), (SELECT min({x}) AS lo, max({x}) AS hi FROM rides)""" for name, x in (("demand", "demand::DOUBLE"), ("log1p", "ln(1 + demand::DOUBLE)")))))
def demand_histogram(spark: SparkSession, folder: str) -> DataFrame:
    panel = rides(spark, folder)
    both = [
        eda.histogram(panel, value).withColumn("scale", F.lit(name))
        for name, value in (("demand", F.col("demand")), ("log1p", F.log1p("demand")))
    ]
    return tidy(both[0].unionByName(both[1]))


@query("skewness", q.with_rides(f"SELECT {q.r('skewness(demand)')} AS demand_skew, {q.r('skewness(ln(1 + demand))')} AS log_skew FROM rides"))
def skewness(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(eda.adjusted_skewness(rides(spark, folder), {"demand_skew": F.col("demand"), "log_skew": F.log1p("demand")}))


def _correlations(names: list[str]) -> str:
    return q.with_features(" UNION ALL ".join(f"SELECT '{n}' AS feature, CASE WHEN min({n}) < max({n}) THEN {q.r(f'abs(corr({n}, demand))')} END AS abs_corr FROM features" for n in names))


@query("target_correlation", _correlations(q.ALL_FEATURES))
def target_correlation(spark: SparkSession, folder: str) -> DataFrame:
    """Every feature; one that is constant in the data has none."""
    return tidy(eda.target_correlation(all_features(spark, folder), q.ALL_FEATURES))


@query("lag_correlation", _correlations(list(q.lags())))
def lag_correlation(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(eda.target_correlation(tp.add_lags(rides(spark, folder), dense=True), list(q.lags())))


MATRIX = ["demand_lag_1h", "demand_lag_24h", "demand_roll3h_mean", "demand_roll24h_mean", "adj_zone_demand", "demand_share", "demand_rank",
          "temperature_c", "wind_speed_kmh", "hour"]


@query("correlation_matrix", q.with_features(" UNION ALL ".join(
    f'SELECT \'{a}\' AS "row", \'{b}\' AS "col", {q.r(f"corr({a}, {b})")} AS corr FROM features' for a in MATRIX for b in MATRIX
)))
def correlation_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(eda.correlation_matrix(all_features(spark, folder), MATRIX))


@query("acf", f"""WITH {q.RIDES}, series AS (SELECT zone, timestamp, demand::DOUBLE AS x, avg(demand) OVER (PARTITION BY zone) AS m FROM rides),
numbered AS (SELECT zone, x - m AS d, row_number() OVER ({q.BY_ZONE}) AS i FROM series),
spread AS (SELECT zone, sum(d * d) AS v FROM numbered GROUP BY zone),
cross_sums AS (SELECT a.zone AS zone, k, sum(a.d * b.d) AS c FROM numbered a, range(49) t(k), numbered b WHERE b.zone = a.zone AND b.i = a.i - k GROUP BY a.zone, k)
SELECT c.zone AS zone, CAST(k AS BIGINT) AS lag, {q.r('c / v')} AS acf FROM cross_sums c JOIN spread s ON s.zone = c.zone""")
def acf(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(eda.autocorrelation(rides(spark, folder), 48, dense=True))


@query("pacf")
def pacf(spark: SparkSession, folder: str) -> DataFrame:
    return eda.partial_autocorrelation(eda.autocorrelation(rides(spark, folder), 48, dense=True))
