"""The training and retraining jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.functions import measures as ms
from zonecast.operators import calibrate as cal
from zonecast.operators import drift as dr
from zonecast.operators import ensemble as en
from zonecast.operators import evaluate as ev
from zonecast.operators import explain as ex
from zonecast.operators import folds as fd
from zonecast.operators import geo
from zonecast.operators import modeling as mo
from zonecast.operators import neighbours as nb
from zonecast.operators import scoring as sc
from zonecast.operators import selecting as se
from zonecast.operators import temporal as tp
from zonecast.operators import tree_shap as ts
from zonecast.session import checkpointed
from zonecast.sources.models import ModelRegistry, Version


def build_features(spark: SparkSession, panel: DataFrame, lagged: bool = True, dense: bool = False) -> DataFrame:
    """All 71 features. With `lagged`, velocity, share, rank and neighbour demand use the hour
    before, so no feature knows the target's own hour. State `dense` only of a
    panel that has every hour of every zone."""
    temporal = tp.add_temporal(panel, dense=dense, lagged=lagged)
    return geo.add_geo(spark, temporal, "demand_lag_1h" if lagged else "demand")


@dataclass
class Settings:
    """Sizes of the job; the defaults are those of a full run."""

    booster: dict = field(default_factory=dict)
    stack_folds: int = 3
    attribution_draws: int = 2
    top_attribution: int = 40
    top_information: int = 40
    least_features: int = 20
    nearest_information: bool = False
    use_boruta: bool = False
    boruta_trials: int = 15
    boruta_trees: int = 100
    search_trials: int = 0
    search_folds: int = 3
    gap_rows: int = 480
    kinds: Sequence[str] = ("gbt_l1", "gbt_alt", "gbt_categorical")


@dataclass
class Result:
    leaderboard: DataFrame
    best: str
    models: dict
    features: list[str]
    selection: DataFrame
    calibration: DataFrame
    revenue: DataFrame
    importance: DataFrame


def train_all(spark: SparkSession, features: DataFrame, settings: Settings | None = None) -> Result:
    """Split, select, fit, combine, calibrate, backtest, rank and explain.

    `features` should be a stored table: every fit reads it again.
    """
    s = settings or Settings()
    names = mo.feature_columns(features)
    usable = checkpointed(spark, fd.split_positional(mo.drop_nulls(features, names)))
    train, val, test = (usable.where(F.col("part") == part) for part in ("train", "val", "test"))

    # Selection: attribution of a quick booster, mutual information, and maybe the shadow test.
    quick = mo.Booster("gbt_l1", {"maxIter": 20, "stepSize": 0.1, **s.booster}).fit(train, names)
    attribution = checkpointed(spark, ex.global_importance(ts.attributions(train, quick)))
    information = checkpointed(spark, nb.mutual_information(train, names) if s.nearest_information else se.mutual_information(train, names))
    confirmed = None
    if s.use_boruta:
        confirmed = se.boruta(train, names, trials=s.boruta_trials, trees=s.boruta_trees)
    selection = checkpointed(spark, se.select_features(
        attribution, information, confirmed, s.top_attribution, s.top_information, s.least_features
    ))
    chosen = [r["feature"] for r in selection.where("selected").orderBy("feature").select("feature").collect()]

    # Only what the fits need, with the row order the folds use.
    keep = ["timestamp", "zone", "demand", "part", *[c for c in chosen if c not in ("timestamp", "zone", "demand", "part")]]
    narrow = checkpointed(spark, fd.row_index(usable.select(*keep)))
    train, val, test = (narrow.where(F.col("part") == part) for part in ("train", "val", "test"))
    fit_rows = train.withColumn("is_val", F.lit(False)).unionByName(val.withColumn("is_val", F.lit(True)))

    ordered = checkpointed(spark, fd.row_index(train.drop("row_id")))
    n_rows = ordered.count()

    def forward(folds: int) -> dict:
        """Expanding folds in equal steps, the first after two of them, with a gap before each."""
        step = max(1, (n_rows - s.gap_rows) // (folds + 2))
        return {"gap": s.gap_rows, "val_size": step, "min_train": step}

    tuned: dict = {}
    if s.search_trials:
        trials = se.parameter_search(
            ordered, lambda n: fd.walk_forward(n, s.search_folds, **forward(s.search_folds)), chosen, trials=s.search_trials, fixed=s.booster
        )
        import json

        tuned = json.loads(trials.where("best").first()["params"])

    models: dict = {}
    for kind in s.kinds:
        params = {**s.booster, **(tuned if kind == "gbt_l1" else {})}
        models[kind] = mo.Booster(kind, params).fit(fit_rows, chosen, validation="is_val")
    bases = list(models.values())
    models["stacking"] = en.Stacking(bases, n_folds=s.stack_folds, **forward(s.stack_folds)).fit(ordered, chosen)
    models["blending"] = en.Blending(bases).fit(train, val, chosen, fitted=bases)
    models["voting"] = en.Voting(bases).fit(train, chosen, fitted=bases)

    # All models side by side on the test rows: scored once, then aggregated.
    scored = test.select("timestamp", "zone", "demand", *chosen)
    for name, model in models.items():
        scored = model.predict(scored, f"by_{name}")
    scored = checkpointed(spark, scored.select("timestamp", "zone", "demand", *[f"by_{n}" for n in models]))
    forecasts = F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"by_{n}").alias("p")) for n in models])
    flat = scored.select("demand", F.explode(forecasts).alias("f")).select("demand", "f.model", "f.p")
    scores = checkpointed(spark, flat.groupBy("model").agg(*ms.error_aggregates("demand", "p")))
    best = ev.best_model(scores).first()["model"]

    on_val = checkpointed(spark, models[best].predict(val.select("demand", *chosen), "pred").select("demand", "pred"))
    return Result(
        leaderboard=ev.leaderboard(scores),
        best=best,
        models=models,
        features=chosen,
        selection=selection,
        calibration=cal.compare_calibrators(on_val),
        revenue=ev.revenue_backtest(scored.withColumnRenamed(f"by_{best}", "pred")),
        importance=ex.global_importance(
            ts.attributions(test, models[best]) if isinstance(models[best], mo.Booster)
            else ex.shapley(test, chosen, models[best].predict, draws=s.attribution_draws)
        ),
    )


def merge(history: DataFrame, recent: DataFrame) -> DataFrame:
    """`history` with its rows of the same (timestamp, zone) replaced by those of `recent`."""
    return history.join(recent.select("timestamp", "zone").distinct(), ["timestamp", "zone"], "left_anti").unionByName(recent)


def retrain(spark: SparkSession, history: DataFrame, recent: DataFrame, versions: str, reference: DataFrame | dr.ReferenceProfile | None = None,
            settings: Settings | None = None) -> DataFrame:
    """Replace the hours that `recent` covers, rebuild features, check drift, train if needed, promote if better.

    `versions` is the folder of a `ModelRegistry`: a promotion publishes the
    challenger's model there as its newest version, the champion, and writes the
    profile of its features beside it, a `reference` for later runs
    (`champion_profile`) that reads none of the old rows. Returns one
    summary row. Only the (timestamp, zone) rows that `recent` brings are
    replaced: a late delivery of an old week leaves all other history as it is.
    """
    registry = ModelRegistry(spark, versions)
    panel = merge(history, recent)
    features = checkpointed(spark, build_features(spark, panel))
    names = mo.feature_columns(features)
    drifted, alert = 0, True
    if reference is not None:
        run = dr.drift_run(reference, features, columns=names).select(F.size("drifted_features").alias("d"), "alert").first()
        drifted, alert = run["d"], run["alert"]
        if not (alert or drifted > 3):
            return spark.createDataFrame([(False, drifted, None, None, False, None)], _SUMMARY)
    result = train_all(spark, features, settings)
    scores = checkpointed(spark, result.leaderboard.select("model", "mape"))
    best = ev.best_model(scores).first()

    def better(champion: Version | None) -> bool:
        return ev.champion_gate(_as_scores(spark, champion), scores).first()["promote"]

    found = registry.promote(result.models[best["model"]], best["model"], best["mape"], better)
    if found:
        dr.ReferenceProfile.of(features, names).save(registry.profile_path(found))
    return spark.createDataFrame([(True, drifted, best["model"], best["mape"], found is not None, found.number if found else None)], _SUMMARY)


_SUMMARY = "trained boolean, n_drifted bigint, challenger string, new_mape double, promoted boolean, version bigint"


def _as_scores(spark: SparkSession, version: Version | None) -> DataFrame:
    return spark.createDataFrame([(version.name, version.mape)] if version else [], "model string, mape double")


def champion(spark: SparkSession, versions: str) -> DataFrame:
    """The newest promoted model (model, mape); no row before the first promotion."""
    return _as_scores(spark, ModelRegistry(spark, versions).champion())


def champion_profile(spark: SparkSession, versions: str) -> dr.ReferenceProfile:
    registry = ModelRegistry(spark, versions)
    return dr.ReferenceProfile.load(spark, registry.profile_path(registry.champion()))


def predict_with_champion(spark: SparkSession, features: DataFrame, versions: str) -> DataFrame:
    """Score request features with the promoted model: columns it lacks are filled as for any request, or are 0."""
    version, model = ModelRegistry(spark, versions).load()
    whole = sc.impute(features)
    missing = {c: F.lit(0.0) for c in version.features if c not in whole.columns}
    return sc.predict(whole.withColumns(missing) if missing else whole, model.predict, version.label)
