"""Boosted-tree demand models and helpers around them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonecast import fixed_values as fv
from zonecast.session import shared_dir

Score = Callable[[DataFrame], DataFrame]


def feature_columns(df: DataFrame) -> list[str]:
    """Columns that may go into a model: not excluded by name and not text."""
    return [
        f.name for f in df.schema.fields
        if f.name not in fv.NON_FEATURES and not isinstance(f.dataType, (T.StringType, T.TimestampNTZType, T.TimestampType))
    ]


def drop_nulls(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with every feature present. Other columns may be null."""
    return df.na.drop(subset=list(features))


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / (population deviation + 1e-8), statistics from one pass."""
    stats = df.agg(F.struct(*[
        part for c in columns
        for part in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))
    ]).alias("s")).scalar()
    out = df.withColumn("_s", stats)
    scaled = {c: (F.col(c) - F.col(f"_s.{c}_mean")) / (F.col(f"_s.{c}_std") + 1e-8) for c in columns}
    return out.withColumns(scaled).drop("_s")


# Settings of the three boosters (absolute error, small steps).
BOOSTERS = {
    "gbt_l1": {"maxIter": 1000, "maxDepth": 7, "minInstancesPerNode": 20, "featureSubsetStrategy": "0.8"},
    "gbt_alt": {"maxIter": 1000, "maxDepth": 7, "minInstancesPerNode": 10, "featureSubsetStrategy": "0.8", "dropRate": 0.1},
    "gbt_categorical": {"maxIter": 1000, "maxDepth": 8, "minInstancesPerNode": 1, "featureSubsetStrategy": "all"},
}
BINS = 64
COMMON = {"lossType": "absolute", "stepSize": 0.05, "subsamplingRate": 0.8, "seed": 42}


@dataclass
class Booster:
    """A gradient-boosted tree model on named columns.

    `kind` picks the settings. The categorical kind indexes text columns as
    categories, however many values they have; the others take numbers only. The
    kind with a `dropRate` leaves earlier trees out at random while it grows.
    With `validation`, a boolean column, boosting stops once those rows no longer
    improve. Null features must be filled or dropped before.
    """

    kind: str = "gbt_l1"
    params: dict = field(default_factory=dict)
    model: PipelineModel | None = None
    features: list[str] = field(default_factory=list)
    inputs: list[str] = field(default_factory=list)

    def unfitted(self) -> "Booster":
        return Booster(self.kind, dict(self.params))

    def fit(self, df: DataFrame, features: Sequence[str], label: str = "demand",
            validation: str | None = None) -> "Booster":
        shared_dir(df.sparkSession)  # long boosting runs cut their lineage there
        self.features = list(features)
        texts = [c for c in features if isinstance(df.schema[c].dataType, T.StringType)]
        if texts and self.kind != "gbt_categorical":
            raise ValueError(f"{self.kind} takes numeric columns only, got {texts}")
        stages: list = []
        inputs = [c for c in features if c not in texts]
        if texts:
            codes = [f"{c}_code" for c in texts]
            stages.append(StringIndexer(inputCols=texts, outputCols=codes, handleInvalid="keep"))
            inputs += codes
        stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
        settings = {**COMMON, **BOOSTERS[self.kind], **self.params}
        if validation:
            settings["validationIndicatorCol"] = validation
        drop_rate = settings.pop("dropRate", None)
        keep = [c for c in (label, validation) if c]
        rows = df.select(*features, *[c for c in keep if c not in features])
        if texts:
            # The indexer marks its columns as categories; a bin for each of them, and one for values never seen.
            stages[0] = stages[0].fit(rows)
            most = max(len(labels) for labels in stages[0].labelsArray) + 1
            settings["maxBins"] = max(BINS, most, settings.get("maxBins", BINS))
        settings.setdefault("maxBins", BINS)
        if drop_rate is None:
            gbt = GBTRegressor(featuresCol="features", labelCol=label, predictionCol="prediction", **settings)
            self.model = Pipeline(stages=[*stages, gbt]).fit(rows)
        else:
            from zonecast.operators.dropout import fit_dropout

            settings.pop("lossType", None)  # the absolute error is the only one
            settings.pop("validationIndicatorCol", None)
            before = Pipeline(stages=stages).fit(rows)
            trees = fit_dropout(before.transform(rows), label, settings.pop("maxIter"), settings.pop("stepSize"), drop_rate, settings.pop("seed"), validation, **settings)
            self.model = PipelineModel(stages=[*before.stages, trees])
        self.inputs = inputs
        return self

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Add the prediction, never below 0."""
        extra = {"features", "rawPrediction", "prediction"} | {f"{c}_code" for c in self.features}
        scored = self.model.transform(df)
        value = F.greatest(F.col("prediction"), F.lit(0.0))
        return scored.withColumn("_value", value).drop(*(extra - set(df.columns))).withColumnRenamed("_value", out)

    def importance(self, spark: SparkSession) -> DataFrame:
        """Importance per input column, largest first."""
        values = self.model.stages[-1].featureImportances.toArray()
        # A model put together from trees knows no columns beyond the last one they use.
        rows = [(name, float(values[i]) if i < len(values) else 0.0) for i, name in enumerate(self.inputs)]
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, kind: str, features: Sequence[str]) -> "Booster":
        model = PipelineModel.load(path)
        return cls(kind, model=model, features=list(features), inputs=list(model.stages[-2].getInputCols()))


@dataclass
class Formula:
    """A linear score over columns; stands for any model where a closed form is wanted."""

    weights: dict[str, float]
    intercept: float = 0.0

    def expression(self, source: Callable[[str], Column] = F.col) -> Column:
        total = F.lit(self.intercept)
        for name, weight in self.weights.items():
            total = total + F.lit(weight) * source(name).cast("double")
        return total

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.expression())
