"""Queries on model explanation. A linear formula stands for the model, so SQL can state most results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast import fixed_values as fv
from zonecast.operators import anchors as an
from zonecast.operators import explain as ex
from zonecast.operators import modeling as mo
from zonecast.operators import selecting as se
from zonecast.operators import temporal as tp
from zonecast.operators.history import over_history
from zonecast.plans import sql as q
from zonecast.plans.features import KEYS
from zonecast.plans.registry import query, rides, tidy
from zonecast.session import checkpointed

WEIGHTS = {"demand_lag_1h": 0.3, "demand_lag_24h": 0.45, "demand_roll24h_mean": 0.2, "temperature_c": 0.01, "hour": -0.02}
MODEL = mo.Formula(WEIGHTS, 0.5)
NAMES = list(WEIGHTS)
MODEL_SQL = "(0.5::DOUBLE + " + " + ".join(f"{w}::DOUBLE * {c}" for c, w in WEIGHTS.items()) + ")"

INPUT = q.RIDES + f""",
wide AS (SELECT timestamp, zone, demand, weather, temperature_c, CAST(hour(timestamp) AS DOUBLE) AS hour, CAST(lag(demand, 1) OVER ({q.BY_ZONE}) AS DOUBLE) AS demand_lag_1h,
CAST(lag(demand, 24) OVER ({q.BY_ZONE}) AS DOUBLE) AS demand_lag_24h, avg(demand) OVER ({q.BY_ZONE} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS demand_roll24h_mean FROM rides),
x AS MATERIALIZED (SELECT * FROM wide WHERE demand_lag_24h IS NOT NULL)"""


def inputs(spark: SparkSession, folder: str) -> DataFrame:
    def columns(w):
        return {
            "demand_lag_1h": F.lag("demand", 1).over(w).cast("double"), "demand_lag_24h": F.lag("demand", 24).over(w).cast("double"),
            "demand_roll24h_mean": F.avg("demand").over(w.rowsBetween(-24, -1)),
        }

    wide = over_history(rides(spark, folder), columns, 24, dense=True).where("demand_lag_24h is not null")
    return wide.select(*KEYS, "demand", "weather", F.hour("timestamp").cast("double").alias("hour"), *[n for n in NAMES if n != "hour"])


def stored_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """The inputs written once: grids, edges and ranges read them again."""
    return checkpointed(spark, inputs(spark, folder))


def _grid(feature: str, points: int, low: float, high: float) -> str:
    return f"""(SELECT CAST(i AS BIGINT) AS i, lo + i * (hi - lo) / {points - 1} AS v FROM range({points}) t(i),
(SELECT quantile_cont({feature}, {low}) AS lo, quantile_cont({feature}, {high}) AS hi FROM x))"""


def _at(**values: str) -> str:
    text = MODEL_SQL
    for name, value in values.items():
        text = text.replace(f" {name} ", f" {value} ").replace(f" {name})", f" {value})")
    return text


PDP_FEATURE, PDP_POINTS = "temperature_c", 50


@query("pdp", f"""WITH {INPUT}, g AS {_grid(PDP_FEATURE, PDP_POINTS, 0.05, 0.95)}
SELECT i AS grid_id, {q.r('v')} AS grid_value, {q.r(f'avg({_at(temperature_c="v")})')} AS avg_pred FROM x, g GROUP BY i, v""")
def pdp(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(ex.pdp(stored_inputs(spark, folder), PDP_FEATURE, MODEL, PDP_POINTS))


@query("pdp_grid_join", f"""WITH {INPUT}, g AS {_grid(PDP_FEATURE, 5, 0.05, 0.95)}
SELECT timestamp, zone, i AS grid_id, {q.r('v')} AS grid_value, {q.r(_at(temperature_c="v"))} AS prediction FROM x, g""")
def pdp_grid_join(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(ex.over_grid(stored_inputs(spark, folder), PDP_FEATURE, MODEL, 5, KEYS))


@query("ice", f"""WITH {INPUT}, g AS {_grid('demand_lag_24h', 10, 0.05, 0.95)}
SELECT timestamp, zone, i AS grid_id, {q.r('v')} AS grid_value, {q.r(_at(demand_lag_24h="v"), 9)} AS prediction FROM x, g""")
def ice(spark: SparkSession, folder: str) -> DataFrame:
    out = ex.ice(stored_inputs(spark, folder), "demand_lag_24h", MODEL, points=10)
    return tidy(out.withColumn("grid_value", F.round("grid_value", 6)), 9)


CENTRED = f"""WITH {INPUT}, g AS {_grid('demand_lag_24h', 10, 0.05, 0.95)},
curves AS (SELECT timestamp, zone, i, v, {_at(demand_lag_24h="v")} AS p FROM x, g),
centred AS (SELECT *, p - first_value(p) OVER (PARTITION BY timestamp, zone ORDER BY i) AS c FROM curves)"""


@query("ice_centred", CENTRED + f" SELECT timestamp, zone, i AS grid_id, {q.r('c')} AS centred FROM centred")
def ice_centred(spark: SparkSession, folder: str) -> DataFrame:
    curves = ex.ice(stored_inputs(spark, folder), "demand_lag_24h", MODEL, points=10)
    return tidy(ex.ice_centred(curves).select(*KEYS, "grid_id", "centred"))


@query("ice_mean", CENTRED + f" SELECT i AS grid_id, {q.r('v')} AS grid_value, {q.r('avg(c)')} AS avg_centred FROM centred GROUP BY i, v")
def ice_mean(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(ex.mean_centred(ex.ice_centred(ex.ice(stored_inputs(spark, folder), "demand_lag_24h", MODEL, points=10))))


@query("pdp_2d", f"""WITH {INPUT}, g AS {_grid('temperature_c', 20, 0.1, 0.9)}, h AS {_grid('hour', 20, 0.1, 0.9)},
means AS (SELECT {', '.join(f'avg({n}) AS {n}' for n in NAMES)} FROM x)
SELECT g.i AS i, h.i AS j, {q.r('g.v')} AS v1, {q.r('h.v')} AS v2, {q.r(_at(temperature_c="g.v", hour="h.v"))} AS avg_pred FROM means, g, h""")
def pdp_2d(spark: SparkSession, folder: str) -> DataFrame:
    """The SQL uses that the mean of a linear score is the score of the means."""
    return tidy(ex.pdp_2d(stored_inputs(spark, folder), "temperature_c", "hour", MODEL, 20))


# Against a single background row of column means, a linear score's attribution
# is weight * (value - mean), whatever the order of the features.
SHAP = INPUT + f""",
means AS (SELECT {', '.join(f'avg({n}) AS m_{n}' for n in NAMES)} FROM x),
shap AS ({' UNION ALL '.join(f"SELECT timestamp, zone, '{n}' AS feature, {w}::DOUBLE * ({n} - m_{n}) AS attribution, {n} AS value FROM x, means" for n, w in WEIGHTS.items())}),
totals AS (SELECT timestamp, zone, {MODEL_SQL} AS prediction, 0.5::DOUBLE + {' + '.join(f'{w}::DOUBLE * m_{n}' for n, w in WEIGHTS.items())} AS base_value FROM x, means)"""


def mean_background(df: DataFrame) -> Column:
    return df.agg(F.array(F.struct(*[F.avg(n).alias(n) for n in NAMES])).alias("rows")).scalar()


def attributions(spark: SparkSession, folder: str) -> DataFrame:
    df = inputs(spark, folder)
    return ex.shapley(df, NAMES, MODEL, background=mean_background(df))


@query("shap_sample", f"""WITH {SHAP} SELECT s.timestamp AS timestamp, s.zone AS zone, feature, {q.r('attribution', 9)} AS attribution, {q.r('base_value', 9)} AS base_value,
{q.r('prediction', 9)} AS prediction FROM shap s JOIN totals t ON t.timestamp = s.timestamp AND t.zone = s.zone""")
def shap_sample(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(attributions(spark, folder), 9)


@query("shap_drawn")
def shap_drawn(spark: SparkSession, folder: str) -> DataFrame:
    """Attributions against background rows drawn from the data."""
    return ex.shapley(inputs(spark, folder), NAMES, MODEL, draws=4)


@query("shap_global", f"WITH {SHAP} SELECT feature, {q.r('avg(abs(attribution))')} AS importance FROM shap GROUP BY feature")
def shap_global(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(ex.global_importance(attributions(spark, folder)))


@query("shap_by_group", f"WITH {SHAP} SELECT zone, " + ", ".join(
    f"{q.r(f'''avg(attribution) FILTER (feature = '{n}')''')} AS {n}" for n in NAMES
) + " FROM shap GROUP BY zone")
def shap_by_group(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(ex.importance_by_group(attributions(spark, folder), "zone", NAMES))


TOP = "row_number() OVER (PARTITION BY timestamp, zone ORDER BY round(abs(attribution), 9) DESC, feature)"


def steady(df: DataFrame) -> DataFrame:
    """Attributions rounded to 9 places, so equal ones tie in every engine."""
    return df.withColumn("attribution", F.round("attribution", 9))


@query("top_contributors", f"WITH {SHAP} SELECT timestamp, zone, feature, {q.r('attribution')} AS attribution, {TOP} AS rank FROM shap QUALIFY rank <= 3")
def top_contributors(spark: SparkSession, folder: str) -> DataFrame:
    out = ex.top_contributors(steady(attributions(spark, folder)), n=3)
    return tidy(out.select(*KEYS, "feature", "attribution", "rank"))


@query("shap_local", f"""WITH {SHAP} SELECT s.timestamp AS timestamp, s.zone AS zone, {q.r('base_value', 2)} AS base_value, {q.r('prediction', 2)} AS prediction,
{TOP.replace('timestamp, zone', 's.timestamp, s.zone')} AS rank, feature, {q.r('attribution', 3)} AS attribution
FROM shap s JOIN totals t ON t.timestamp = s.timestamp AND t.zone = s.zone WHERE s.zone = '11' AND s.timestamp = TIMESTAMP '2024-01-15 18:00:00'""")
def shap_local(spark: SparkSession, folder: str) -> DataFrame:
    row = (F.col("zone") == "11") & (F.col("timestamp") == F.to_timestamp_ntz(F.lit("2024-01-15 18:00:00")))
    return tidy(ex.local_explanation(steady(attributions(spark, folder)), row))


@query("shap_dependence", f"""WITH {SHAP} SELECT s.timestamp AS timestamp, s.zone AS zone, feature, {q.r('value')} AS value, {q.r('attribution')} AS attribution,
{q.r('x.temperature_c')} AS interaction_value FROM shap s JOIN x ON x.timestamp = s.timestamp AND x.zone = s.zone WHERE feature IN ('demand_lag_24h', 'hour')""")
def shap_dependence(spark: SparkSession, folder: str) -> DataFrame:
    df = inputs(spark, folder)
    found = ex.shapley(df, NAMES, MODEL, background=mean_background(df))
    return tidy(ex.dependence(found, df, ["demand_lag_24h", "hour"], "temperature_c"))


CORR = " UNION ALL ".join(f"SELECT '{n}' AS feature, corr({n}, demand) AS score FROM x" for n in NAMES)
AGREEMENT = f"""WITH {SHAP}, global_scores AS (SELECT feature, avg(abs(attribution)) AS score FROM shap GROUP BY feature), local_scores AS ({CORR}),
g AS (SELECT row_number() OVER (ORDER BY abs(score) DESC, feature) AS rank, feature, score FROM global_scores QUALIFY rank <= 3),
l AS (SELECT row_number() OVER (ORDER BY abs(score) DESC, feature) AS rank, feature, score FROM local_scores QUALIFY rank <= 3)"""


def two_scores(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Attribution against plain correlation with the demand."""
    from zonecast.operators import explore as eda

    df = inputs(spark, folder)
    first = ex.global_importance(ex.shapley(df, NAMES, MODEL, background=mean_background(df))).withColumnRenamed("importance", "score")
    second = eda.target_correlation(df, NAMES).withColumnRenamed("abs_corr", "score")
    return first, second


@query("explanation_agreement", AGREEMENT + f""" SELECT g.rank AS rank, g.feature AS global_feature, {q.r('g.score')} AS global_score, l.feature AS local_feature,
{q.r('abs(l.score)')} AS local_score, {q.r('''(SELECT count(*) FROM g JOIN l ON l.feature = g.feature) / (SELECT count(*) FROM (SELECT feature FROM g UNION SELECT feature FROM l))''', 3)} AS jaccard
FROM g JOIN l ON l.rank = g.rank""")
def explanation_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(ex.agreement(*two_scores(spark, folder), n=3))


@query("topn_overlap", AGREEMENT + f""" SELECT (SELECT count(*) FROM (SELECT feature FROM g INTERSECT SELECT feature FROM l)) AS intersection_size,
(SELECT count(*) FROM (SELECT feature FROM g UNION SELECT feature FROM l)) AS union_size,
{q.r('''(SELECT count(*) FROM (SELECT feature FROM g INTERSECT SELECT feature FROM l)) / (SELECT count(*) FROM (SELECT feature FROM g UNION SELECT feature FROM l))''')} AS jaccard""")
def topn_overlap(spark: SparkSession, folder: str) -> DataFrame:
    first, second = two_scores(spark, folder)
    return tidy(ex.set_overlap(se.top_features(first, "score", 3), se.top_features(second, "score", 3)))


@query("top_features", AGREEMENT + f" SELECT feature, {q.r('score')} AS score FROM g")
def top_features(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(se.top_features(two_scores(spark, folder)[0], "score", 3))


@query("lime_batch")
def lime_batch(spark: SparkSession, folder: str) -> DataFrame:
    return ex.lime(stored_inputs(spark, folder), NAMES, MODEL, draws=50)


def best_row(df: DataFrame) -> dict[str, float]:
    """The inputs of the row with the highest score."""
    return MODEL(df).agg(F.max_by(F.struct(*NAMES), F.struct("prediction", *KEYS)).alias("r")).first()["r"].asDict()


@query("anchor_rules")
def anchor_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The rule for the row with the highest score, by perturbation."""
    df = stored_inputs(spark, folder)
    return an.anchor(df, NAMES, MODEL, best_row(df))


@query("anchor_rules_counted")
def anchor_rules_counted(spark: SparkSession, folder: str) -> DataFrame:
    """The rule for the same row, counted on the rows themselves."""
    df = stored_inputs(spark, folder)
    return ex.anchor(df, NAMES, MODEL, best_row(df))


@query("counterfactuals")
def counterfactuals(spark: SparkSession, folder: str) -> DataFrame:
    return ex.counterfactuals(stored_inputs(spark, folder), NAMES, MODEL, (3.0, 6.0), n=3, vary=["demand_lag_24h", "temperature_c", "hour"], tries=40)
