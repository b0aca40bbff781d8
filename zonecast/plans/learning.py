"""Queries on models, ensembles, feature selection and the jobs around them.

The boosters run with few, shallow trees here; the operators take full sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.operators import categories as ct
from zonecast.operators import dropout as dp
from zonecast.operators import ensemble as en
from zonecast.operators import folds as fd
from zonecast.operators import modeling as mo
from zonecast.operators import neighbours as nb
from zonecast.operators import selecting as se
from zonecast.operators import tree_shap as ts
from zonecast.plans import explaining as xp
from zonecast.plans import scoring as sp
from zonecast.plans import sql as q
from zonecast.plans import training as tr
from zonecast.plans.features import KEYS
from zonecast.plans.registry import query, rides, tidy
from zonecast.session import checkpointed, new_dir
from zonecast.sources.models import ModelRegistry

SMALL = {"maxIter": 5, "maxDepth": 4, "stepSize": 0.3}
NAMES = xp.NAMES
#: Those that a request carries.
REQUEST_NAMES = ["demand_lag_1h", "demand_lag_24h", "demand_roll24h_mean", "temperature_c", "hour"]


def table(spark: SparkSession, folder: str) -> DataFrame:
    """Lags, mean, temperature, hour and weather, stored with row numbers and the positional split."""
    return checkpointed(spark, fd.row_index(fd.split_positional(xp.inputs(spark, folder))))


def parts(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(df.where(F.col("part") == p) for p in ("train", "val", "test"))


def bases() -> list[mo.Booster]:
    return [mo.Booster(kind, SMALL) for kind in ("gbt_l1", "gbt_alt")]


def shown(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, "demand", "prediction")


def fitted(spark: SparkSession, folder: str, kind: str, names: list[str]) -> tuple[mo.Booster, DataFrame]:
    train, val, test = parts(table(spark, folder))
    rows = train.withColumn("is_val", F.lit(False)).unionByName(val.withColumn("is_val", F.lit(True)))
    return mo.Booster(kind, SMALL).fit(rows, names, validation="is_val"), test


@query("fit_gbt_l1")
def fit_gbt_l1(spark: SparkSession, folder: str) -> DataFrame:
    model, test = fitted(spark, folder, "gbt_l1", NAMES)
    return shown(model.predict(test))


@query("fit_gbt_alt")
def fit_gbt_alt(spark: SparkSession, folder: str) -> DataFrame:
    model, test = fitted(spark, folder, "gbt_alt", NAMES)
    return shown(model.predict(test))


@query("fit_gbt_categorical")
def fit_gbt_categorical(spark: SparkSession, folder: str) -> DataFrame:
    """Zone and weather go in as text."""
    model, test = fitted(spark, folder, "gbt_categorical", [*NAMES, "zone", "weather"])
    return shown(model.predict(test))


@query("model_importance")
def model_importance(spark: SparkSession, folder: str) -> DataFrame:
    return fitted(spark, folder, "gbt_l1", NAMES)[0].importance(spark)


@query("model_save_load")
def model_save_load(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of a saved and reloaded model next to those of the original."""
    model, test = fitted(spark, folder, "gbt_l1", NAMES)
    path = new_dir(spark, "model")
    model.save(path)
    again = mo.Booster.load(path, "gbt_l1", NAMES)
    return again.predict(model.predict(test, "before"), "after").select(*KEYS, "before", "after")


@query("champion_predict_batch", f"WITH {sp.REQUESTS_SQL} SELECT timestamp, panel_zone, 'voting-v2' AS model_version, true AS as_promoted, true AS ordered FROM valid")
def champion_predict_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Requests scored by the model that the registry names: the second promotion, an ensemble, as it was before it was stored."""
    registry = ModelRegistry(spark, new_dir(spark, "registry"))
    train = table(spark, folder).where("part = 'train'")
    models = [m.fit(train, REQUEST_NAMES) for m in bases()]
    voting = en.Voting(models).fit(train, REQUEST_NAMES, fitted=models)
    for name, mape, model in (("gbt_l1", 20.0, models[0]), ("voting", 15.0, voting), ("gbt_alt", 14.9, models[1])):
        registry.promote(model, name, mape, lambda old, new=mape: old is None or (old.mape - new) / old.mape > 0.01)
    requests = sp.valid_features(spark, folder)
    scored = voting.predict(tr.predict_with_champion(spark, requests, registry.root).withColumnRenamed("prediction", "stored"), "before")
    same = F.abs(F.col("stored") - F.col("before")) <= 1e-9
    ordered = (F.col("confidence_low") <= F.col("predicted_demand")) & (F.col("predicted_demand") <= F.col("confidence_high"))
    return scored.select("timestamp", "panel_zone", "model_version", same.alias("as_promoted"), ordered.alias("ordered"))


@query("stacking")
def stacking(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder)
    train = checkpointed(spark, fd.row_index(df.where("part = 'train'").drop("row_id")))
    model = en.Stacking(bases(), n_folds=3, mode="walk_forward", gap=480, val_size=1000, min_train=2000).fit(train, NAMES)
    return shown(model.predict(df.where("part = 'test'")))


@query("stack_weights")
def stack_weights(spark: SparkSession, folder: str) -> DataFrame:
    train = checkpointed(spark, fd.row_index(table(spark, folder).where("part = 'train'").drop("row_id")))
    return en.Stacking(bases(), n_folds=2, mode="kfold").fit(train, NAMES).weights(spark)


@query("weighted_blend")
def weighted_blend(spark: SparkSession, folder: str) -> DataFrame:
    train, val, test = parts(table(spark, folder))
    return shown(en.Blending(bases()).fit(train, val, NAMES).predict(test))


FORMULAS = [mo.Formula({"demand_lag_24h": 0.9}, 0.1), mo.Formula({"demand_roll24h_mean": 1.0}), mo.Formula({"demand_lag_1h": 0.8}, -0.6)]


@query("voting", f"""WITH {xp.INPUT} SELECT timestamp, zone, demand, {q.r('''greatest((0.1::DOUBLE + 0.9::DOUBLE * demand_lag_24h + demand_roll24h_mean
+ (-0.6::DOUBLE) + 0.8::DOUBLE * demand_lag_1h) / 3, 0.0)''')} AS prediction FROM x""")
def voting(spark: SparkSession, folder: str) -> DataFrame:
    df = xp.inputs(spark, folder)
    for i, formula in enumerate(FORMULAS):
        df = df.withColumn(f"pred_{i}", formula.expression())
    return tidy(shown(en.vote(df, ["pred_0", "pred_1", "pred_2"])))


@query("cross_validate")
def cross_validate(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder)
    return en.cross_validate(lambda: mo.Booster("gbt_l1", SMALL), df, lambda n: fd.walk_forward(n, 3, 480, 1500, 3000), NAMES)


@query("hpo_search")
def hpo_search(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder)
    return se.parameter_search(
        df, lambda n: fd.walk_forward(n, 3, 480, 1500, 3000), NAMES, trials=4, warmup_trials=2, warmup_folds=1, fixed={"maxIter": 3}, most_depth=5
    )


@query("boruta")
def boruta(spark: SparkSession, folder: str) -> DataFrame:
    return se.boruta(table(spark, folder), NAMES, trials=4, trees=10)


def _bins(column: str, edges: str) -> str:
    return f"len(list_filter({edges}, lambda e: e < {column}))"


NINTHS = ", ".join(repr(i / 10) for i in range(1, 10))
MI_SQL = f"""WITH {xp.INPUT}, long AS {q.unpivot('x', NAMES)},
xe AS (SELECT feature, list_distinct(quantile_cont(value, [{NINTHS}])) AS e FROM long GROUP BY feature),
ye AS (SELECT list_distinct(quantile_cont(demand, [{NINTHS}])) AS e FROM x),
binned AS ({' UNION ALL '.join(f"SELECT '{n}' AS feature, {_bins(f'CAST({n} AS DOUBLE)', 'xe.e')} AS bx, {_bins('demand', 'ye.e')} AS b_y FROM x, xe, ye WHERE xe.feature = '{n}'" for n in NAMES)}),
mi_cells AS (SELECT feature, bx, b_y, count(*) AS n FROM binned GROUP BY feature, bx, b_y),
sized AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bx) AS nx, sum(n) OVER (PARTITION BY feature, b_y) AS ny FROM mi_cells),
mi AS (SELECT feature, greatest(sum(n / t * ln(n * t / (nx * ny))), 0.0) AS mi FROM sized GROUP BY feature)"""


@query("mutual_information", MI_SQL + f" SELECT feature, {q.r('mi')} AS mi FROM mi")
def mutual_information(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(se.mutual_information(checkpointed(spark, xp.inputs(spark, folder)), NAMES))


SELECT_SQL = MI_SQL.replace(f"WITH {xp.INPUT}", f"WITH {xp.SHAP}") + """,
attribution AS (SELECT feature, avg(abs(attribution)) AS importance FROM shap GROUP BY feature),
votes AS (SELECT feature FROM (SELECT feature FROM attribution ORDER BY importance DESC LIMIT 3) UNION ALL SELECT feature FROM (SELECT feature FROM mi ORDER BY mi DESC LIMIT 3)),
counted AS (SELECT a.feature AS feature, importance, count(v.feature) AS votes FROM attribution a LEFT JOIN votes v ON v.feature = a.feature GROUP BY 1, 2),
chosen AS (SELECT feature, importance, votes, CASE WHEN (SELECT count(*) FROM counted WHERE votes >= 2) < 2 THEN row_number() OVER (ORDER BY importance DESC) <= 2 ELSE votes >= 2 END AS selected FROM counted)"""


def two_votes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from zonecast.operators import explain as ex

    df = checkpointed(spark, xp.inputs(spark, folder))
    attribution = ex.global_importance(ex.shapley(df, NAMES, xp.MODEL, background=xp.mean_background(df)))
    information = se.mutual_information(df, NAMES)
    attribution, information = checkpointed(spark, attribution), checkpointed(spark, information)
    return attribution, information, se.select_features(attribution, information, None, 3, 3, 2)


@query("select_features", SELECT_SQL + " SELECT feature, votes, selected FROM chosen")
def select_features(spark: SparkSession, folder: str) -> DataFrame:
    return two_votes(spark, folder)[2]


@query("importance_report", SELECT_SQL + f""" SELECT c.feature AS feature, {q.r('importance')} AS shap_importance, {q.r('mi')} AS mi_importance, selected
FROM chosen c JOIN mi ON mi.feature = c.feature""")
def importance_report(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(se.importance_report(*two_votes(spark, folder)))


@query("mutual_information_nearest")
def mutual_information_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """By the distances to the third neighbours, without bins."""
    return tidy(nb.mutual_information(checkpointed(spark, xp.inputs(spark, folder)), NAMES))


@query("shap_tree")
def shap_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Exact attributions of a boosted model, long form."""
    model, _ = fitted(spark, folder, "gbt_l1", NAMES)
    return tidy(ts.attributions(xp.inputs(spark, folder), model), 9)


@query("shap_tree_adds_up", f"WITH {xp.INPUT} SELECT timestamp, zone, {len(NAMES)} AS n_features, true AS adds_up FROM x")
def shap_tree_adds_up(spark: SparkSession, folder: str) -> DataFrame:
    """For each row whether its exact attributions and the base value make up the model's score."""
    model, _ = fitted(spark, folder, "gbt_l1", NAMES)
    df = checkpointed(spark, xp.inputs(spark, folder))
    sums = ts.attributions(df, model).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_features"), F.sum("attribution").alias("s"), F.max("base_value").alias("b"))
    scores = model.model.transform(df).select(*KEYS, F.col("prediction").alias("p"))
    return scores.join(sums, KEYS).select(*KEYS, "n_features", (F.abs(F.col("s") + F.col("b") - F.col("p")) <= 1e-9).alias("adds_up"))


@query("shap_tree_dependence")
def shap_tree_dependence(spark: SparkSession, folder: str) -> DataFrame:
    """Points of two features, coloured by the feature that each interacts with most."""
    model, _ = fitted(spark, folder, "gbt_l1", NAMES)
    return tidy(ts.dependence(checkpointed(spark, xp.inputs(spark, folder)), model, ["demand_lag_24h", "hour"]), 9)


DROPPED = "(('0x' || substr(md5('42:' || t || ':' || i), 1, 12))::BIGINT % 1000000 < 300000)"


@query("dropout_weights", f"""WITH rounds AS (SELECT unnest(range(0, 8)) AS t), out AS (SELECT a.t AS t, b.t AS i FROM rounds a JOIN rounds b ON b.t < a.t WHERE {DROPPED.replace('t ||', 'a.t ||').replace('|| i)', '|| b.t)')}),
sizes AS (SELECT t, (SELECT count(*) FROM out o WHERE o.t = r.t) AS k FROM rounds r),
born AS (SELECT t, CASE WHEN t = 0 THEN 1.0 WHEN k = 0 THEN 0.3 ELSE 0.3 / (k + 0.3) END::DOUBLE AS w FROM sizes),
kept AS (SELECT o.i AS i, product(k::DOUBLE / (k + 0.3::DOUBLE)) AS f FROM out o JOIN sizes s ON s.t = o.t GROUP BY o.i)
SELECT t AS tree, {q.r('w * coalesce(f, 1.0)', 9)} AS weight, (SELECT count(*) FROM out o WHERE o.i = born.t) AS times_out FROM born LEFT JOIN kept ON kept.i = born.t""")
def dropout_weights(spark: SparkSession, folder: str) -> DataFrame:
    """The trees of the dropout booster with their weights and how often each was left out."""
    train = parts(table(spark, folder))[0]
    model = mo.Booster("gbt_alt", {"maxIter": 8, "maxDepth": 3, "stepSize": 0.3, "dropRate": 0.3, "seed": 42}).fit(train, NAMES)
    weights = list(model.model.stages[-1].treeWeights)
    out = [sum(i in dp.dropped(42, t, 0.3) for t in range(8)) for i in range(8)]
    return tidy(spark.createDataFrame([(i, float(w), n) for i, (w, n) in enumerate(zip(weights, out))], "tree bigint, weight double, times_out bigint"), 9)


@query("ordered_target_stats", q.with_rides(f"""SELECT timestamp, zone, weather, {q.r('(coalesce(sum(demand) OVER c, 0) + coalesce(sum(demand) OVER w / count(*) OVER w, 0.0)) / (count(*) OVER c + 1.0::DOUBLE)')} AS code
FROM (SELECT *, ('0x' || substr(md5('42|' || CAST(timestamp AS VARCHAR) || '|' || zone), 1, 15))::BIGINT AS place FROM rides)
WINDOW c AS (PARTITION BY weather ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""))
def ordered_target_stats(spark: SparkSession, folder: str) -> DataFrame:
    """The weather as the mean demand of earlier rows of that weather, in a hashed order."""
    out = ct.OrderedTargets("weather").fit_transform(checkpointed(spark, rides(spark, folder)), "code")
    return tidy(out.select(*KEYS, "weather", "code"))


@query("sample_rows")
def sample_rows(spark: SparkSession, folder: str) -> DataFrame:
    return se.sample_rows(rides(spark, folder), 2000).select(*KEYS, "demand")


@query("shuffle_columns", q.with_rides("SELECT 'demand' AS feature, CAST(demand AS DOUBLE) AS value, count(*) AS n FROM rides GROUP BY 1, 2 UNION ALL "
       "SELECT 'wind_speed_kmh', wind_speed_kmh, count(*) FROM rides GROUP BY 1, 2"))
def shuffle_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The values of the shuffled copies: exactly those of the columns."""
    out = se.shuffle_columns(rides(spark, folder), ["demand", "wind_speed_kmh"])
    names = {"demand": "shadow_demand", "wind_speed_kmh": "shadow_wind_speed_kmh"}
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(c).cast("double").alias("value")) for f, c in names.items()])
    return out.select(F.explode(pairs).alias("p")).groupBy("p.feature", "p.value").agg(F.count(F.lit(1)).alias("n"))


TINY = tr.Settings(
    booster={"maxIter": 3, "maxDepth": 3, "stepSize": 0.3}, stack_folds=2, top_attribution=12, top_information=12, least_features=6,
    kinds=("gbt_l1", "gbt_alt"),
)


@query("train_all")
def train_all(spark: SparkSession, folder: str) -> DataFrame:
    features = checkpointed(spark, tr.build_features(spark, rides(spark, folder)))
    return tr.train_all(spark, features, TINY).leaderboard


@query("retrain_job")
def retrain_job(spark: SparkSession, folder: str) -> DataFrame:
    """The last seven days arrive again; there is no reference and no champion yet."""
    panel = checkpointed(spark, rides(spark, folder))
    newest = panel.agg(F.max("timestamp").alias("t")).scalar()
    recent = panel.where(F.col("timestamp") > newest - F.expr("interval 7 days"))
    return tr.retrain(spark, panel, recent, new_dir(spark, "versions"), settings=TINY)
