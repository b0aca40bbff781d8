"""Feature selection: sampling, shadow columns, mutual information, votes, parameter search."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonecast.operators import folds as fd
from zonecast.operators.drift import long_values
from zonecast.operators.modeling import Booster
from zonecast.operators.ordering import bucket_of, quantiles
from zonecast.operators.trials import Search

BLOCK_ROWS = 4096


def sample_rows(df: DataFrame, n: int, keys: Sequence[str] = ("timestamp", "zone"), seed: int = 42) -> DataFrame:
    """min(n, rows) rows without replacement; the same rows however the data is partitioned."""
    order = F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))
    return df.withColumn("_order", order).orderBy("_order", *keys).limit(n).drop("_order")


def shuffle_columns(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("timestamp", "zone"),
                    seed: int = 0, prefix: str = "shadow_", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add a shuffled copy of each column, every column in an order of its own.

    Rows are first dealt into random blocks of about `block_rows` rows, then each
    column is put into hash order within its block. The copy holds exactly the
    values of the column, and all columns together need one shuffle.
    """
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    blocks = F.greatest(F.ceil(total / block_rows), F.lit(1)).cast("long")
    own = [F.col(k) for k in keys]
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(*own, F.lit(seed), F.lit("block")), blocks))

    def in_order(label: str, value: Column) -> Column:
        pair = F.struct(F.xxhash64(*own, F.lit(seed), F.lit(label)).alias("order"), value.alias("v"))
        return F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["v"])

    row = F.struct(*[F.col(c) for c in df.columns])
    packed = dealt.groupBy("_block").agg(
        in_order("rows", row).alias("row"), *[in_order(c, F.struct(F.col(c).alias("x"))).alias(f"_{i}") for i, c in enumerate(columns)]
    )
    names = ["row", *[f"_{i}" for i in range(len(columns))]]
    return packed.select(F.explode(F.arrays_zip(*names)).alias("z")).select(
        "z.row.*", *[F.col(f"z._{i}.x").alias(f"{prefix}{c}") for i, c in enumerate(columns)]
    )


def mutual_information(df: DataFrame, features: Sequence[str], target: str = "demand", bins: int = 10) -> DataFrame:
    """Mutual information of each feature with the target, in nats, over quantile bins of both.

    Nulls count as 0. Uses all rows: the cells per feature are at most bins x bins.
    """
    filled = df.select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features], target)
    shares = [i / bins for i in range(1, bins)]

    def distinct_edges(q: DataFrame, name: str) -> DataFrame:
        return q.withColumn(name, F.array_distinct(name)).drop("n")

    y_edges = distinct_edges(quantiles(filled, target, shares, name="_e"), "_e").scalar()
    x_edges = distinct_edges(quantiles(long_values(filled, features), "value", shares, ["feature"], "_xe"), "_xe")
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features])
    with_y = filled.withColumn("_ye", y_edges).select(bucket_of(target, "_ye", bins).alias("by"), F.explode(pairs).alias("p"))
    # One row of edges per column of the frame.
    rows = with_y.select("by", "p.feature", "p.value").join(F.broadcast(x_edges), "feature")
    cells = rows.groupBy("feature", bucket_of("value", "_xe", bins).alias("bx"), "by").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("feature")
    by_x, by_y = Window.partitionBy("feature", "bx"), Window.partitionBy("feature", "by")
    total = F.sum("n").over(whole)
    term = F.col("n") / total * F.ln(F.col("n") * total / (F.sum("n").over(by_x) * F.sum("n").over(by_y)))
    return cells.select("feature", term.alias("t")).groupBy("feature").agg(F.greatest(F.sum("t"), F.lit(0.0)).alias("mi"))


def boruta(df: DataFrame, features: Sequence[str], label: str = "demand", trials: int = 20, alpha: float = 0.05,
           trees: int = 100, seed: int = 42, keys: Sequence[str] = ("timestamp", "zone"), depth: int = 5) -> DataFrame:
    """Count the trials in which a feature beats the best shadow; confirmed, tentative or rejected.

    `df` is read once per trial: keep it stored or cached.
    """
    spark = df.sparkSession
    wins = dict.fromkeys(features, 0)
    rows = df.select(*keys, label, *[F.col(f).cast("double").alias(f) for f in features])
    for trial in range(trials):
        both = shuffle_columns(rows, features, keys, seed=trial)
        names = [*features, *[f"shadow_{f}" for f in features]]
        vectors = VectorAssembler(inputCols=names, outputCol="v").transform(both).select("v", label)
        forest = RandomForestRegressor(featuresCol="v", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed + trial)
        importance = forest.fit(vectors).featureImportances.toArray()
        bar = max(importance[len(features):])
        for name, value in zip(features, importance):
            wins[name] += int(value > bar)

    def verdict(count: int) -> str:
        if count >= trials * (1 - alpha):
            return "confirmed"
        return "tentative" if count >= trials * alpha else "rejected"

    found = [(f, c, verdict(c)) for f, c in wins.items()]
    return spark.createDataFrame(found, "feature string, wins bigint, verdict string").orderBy(F.desc("wins"), "feature")


def top_features(scores: DataFrame, by: str, n: int) -> DataFrame:
    return scores.orderBy(F.desc_nulls_last(by), "feature").limit(n)


def select_features(attribution: DataFrame, information: DataFrame, confirmed: DataFrame | None = None,
                    top_attribution: int = 40, top_information: int = 40, least: int = 20) -> DataFrame:
    """Features with two or more votes; with fewer than `least`, the top `least` by attribution.

    Votes: among the top by attribution, among the top by mutual information, and
    confirmed by the shadow test. Columns: feature, votes, selected.
    """
    first = top_features(attribution, "importance", top_attribution).select("feature", "importance")
    second = top_features(information, "mi", top_information).select("feature")
    votes = first.select("feature").unionAll(second)
    if confirmed is not None:
        votes = votes.unionAll(confirmed.where("verdict = 'confirmed'").select("feature"))
    counted = votes.groupBy("feature").agg(F.count(F.lit(1)).alias("votes"))
    everyone = attribution.select("feature").join(counted, "feature", "left").fillna(0, subset=["votes"])
    enough = everyone.agg(F.sum((F.col("votes") >= 2).cast("long")).alias("n")).scalar()
    fallback = top_features(first, "importance", least).select("feature", F.lit(True).alias("_top"))
    chosen = F.when(F.col("_enough") < least, F.coalesce("_top", F.lit(False))).otherwise(F.col("votes") >= 2)
    return (
        everyone.join(fallback, "feature", "left").withColumn("_enough", enough)
        .withColumn("selected", chosen).select("feature", "votes", "selected")
    )


def importance_report(attribution: DataFrame, information: DataFrame, selected: DataFrame) -> DataFrame:
    """Both scores side by side, 0 where one is missing, with the selection flag."""
    both = attribution.select("feature", F.col("importance").alias("shap_importance")).join(
        information.select("feature", F.col("mi").alias("mi_importance")), "feature", "full"
    )
    flags = selected.where("selected").select("feature", F.lit(True).alias("selected"))
    out = both.fillna(0.0, subset=["shap_importance", "mi_importance"]).join(flags, "feature", "left")
    return out.fillna(False, subset=["selected"]).orderBy(F.desc("shap_importance"), "feature")


# Search ranges (low, high, on a log scale) for the two searched boosters.
SEARCH_SPACE = {
    "gbt_l1": {
        "stepSize": (1e-3, 0.3, True), "maxDepth": (3, 12, False), "minInstancesPerNode": (5, 100, False),
        "subsamplingRate": (0.4, 1.0, False), "featureSubsetStrategy": (0.4, 1.0, False),
    },
    "gbt_alt": {
        "stepSize": (1e-3, 0.3, True), "maxDepth": (3, 10, False), "minInstancesPerNode": (1, 50, False),
        "subsamplingRate": (0.5, 1.0, False), "featureSubsetStrategy": (0.5, 1.0, False),
    },
}


def draw_parameters(kind: str, chance: random.Random, most_depth: int | None = None) -> dict:
    """One random setting from the search space; `most_depth` is the upper end of the depths."""
    drawn: dict = {}
    for name, (low, high, log) in SEARCH_SPACE[kind].items():
        if name == "maxDepth" and most_depth:
            low, high = min(low, most_depth), min(high, most_depth)
        if isinstance(low, int):
            drawn[name] = chance.randint(low, high)
        elif log:
            drawn[name] = low * (high / low) ** chance.random()
        else:
            drawn[name] = chance.uniform(low, high)
    drawn["featureSubsetStrategy"] = str(round(drawn["featureSubsetStrategy"], 2))
    return drawn


def parameter_search(indexed: DataFrame, plan: fd.Plan, features: Sequence[str], kind: str = "gbt_l1",
                     label: str = "demand", trials: int = 20, seed: int = 42, warmup_trials: int = 10,
                     warmup_folds: int = 2, fixed: dict | None = None, most_depth: int | None = None, parallel: int = 1) -> DataFrame:
    """Random search by mean fold RMSE; a trial worse than the running median stops early.

    Returns one row per trial: number, parameters as JSON, folds done, mean RMSE,
    whether it was stopped, and whether it is the best finished one. With
    `parallel` trials at a time a trial may also be stopped in the middle of a
    fit; where none is stopped, the table is that of one trial after the other.
    """
    spark = indexed.sparkSession
    assigned = fd.assign(indexed, plan)
    n_folds = fd.fold_count(plan)
    chance = random.Random(seed)
    drawn = [{**draw_parameters(kind, chance, most_depth), **(fixed or {})} for _ in range(trials)]

    def run_fold(trial: int, fold: int) -> float:
        train = assigned.where((F.col("fold") == fold) & (F.col("role") == "train"))
        val = assigned.where((F.col("fold") == fold) & (F.col("role") == "val"))
        scored = Booster(kind, drawn[trial]).fit(train, features, label).predict(val, "prediction")
        gap = F.col(label) - F.col("prediction")
        return float(scored.agg(F.sqrt(F.avg(gap * gap))).first()[0])

    done = Search(spark, n_folds, warmup_trials, warmup_folds).run(trials, run_fold, parallel)
    rows = []
    for trial, (params, result) in enumerate(zip(drawn, done)):
        shown = ", ".join(f'"{k}": {v!r}' for k, v in sorted(params.items())).replace("'", '"')
        rows.append((trial, "{" + shown + "}", len(result.means), result.means[-1], result.stopped))
    table = spark.createDataFrame(rows, "trial bigint, params string, folds_done bigint, rmse double, stopped boolean")
    best = min((r for r in rows if not r[4]), key=lambda r: r[3])[0]
    return table.withColumn("best", F.col("trial") == best)
