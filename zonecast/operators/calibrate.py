"""Calibration of predictions: curve, temperature, isotonic and sigmoid maps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.operators.ordering import bucket_of, quantiles
from zonecast.session import checkpointed


def calibration_curve(df: DataFrame, p: str = "pred", y: str = "demand", bins: int = 20) -> DataFrame:
    """Mean prediction and actual per quantile bin of the prediction.

    Bins are right-closed, the first also includes its left edge, and equal edges
    collapse into one.
    """
    edges = quantiles(df, p, [i / bins for i in range(bins + 1)], name="edges").select(
        F.array_distinct("edges").alias("edges")
    ).scalar()
    placed = df.withColumn("_edges", edges).withColumn(
        "bin", F.greatest(bucket_of(p, "_edges", 2 * bins), F.lit(1)).cast("long")
    )
    out = placed.groupBy("bin").agg(
        F.avg(p).alias("mean_pred"), F.avg(y).alias("mean_actual"), F.count(y).alias("count")
    )
    return out.withColumn("bias", F.col("mean_pred") - F.col("mean_actual")).orderBy("bin")


def temperature(df: DataFrame, p: str = "pred", y: str = "demand") -> DataFrame:
    """The T in [0.1, 10] that minimises the mean of (p / T - y)^2, in closed form."""
    squares = F.sum(F.col(p) * F.col(p)).alias("pp")
    cross = F.sum(F.col(p) * F.col(y)).alias("py")
    best = F.when(F.col("py") <= 0, 10.0).otherwise(
        F.least(F.greatest(F.try_divide(F.col("pp"), F.col("py")), F.lit(0.1)), F.lit(10.0))
    )
    return df.agg(squares, cross).select(best.alias("temperature"))


def apply_temperature(df: DataFrame, t: Column, p: str = "pred", out: str = "calibrated") -> DataFrame:
    return df.withColumn(out, F.col(p) / t)


def _weighted(df: DataFrame, p: str, y: str) -> DataFrame:
    """Rows with the same prediction combined: mean label and weight. Least squares needs no more."""
    return df.groupBy(F.col(p).cast("double").alias("feature")).agg(
        F.avg(F.col(y).cast("double")).alias("label"), F.count(F.lit(1)).cast("double").alias("weight")
    )


BLOCKS = "part bigint, low double, high double, total double, weight double"


def pooled(rows: pd.DataFrame) -> pd.DataFrame:
    """Pool neighbours until means do not fall: rows (low, high, total, weight) sorted by value, the blocks back."""
    lows, highs, totals, weights = [], [], [], []
    for low, high, total, weight in zip(rows["low"], rows["high"], rows["total"], rows["weight"]):
        while totals and totals[-1] * weight >= total * weights[-1]:
            low, total, weight = lows.pop(), total + totals.pop(), weight + weights.pop()
            highs.pop()
        lows.append(low), highs.append(high), totals.append(total), weights.append(weight)
    return pd.DataFrame({"low": lows, "high": highs, "total": totals, "weight": weights})


def isotonic_blocks(df: DataFrame, p: str = "pred", y: str = "demand") -> DataFrame:
    """(low, high, mean) of the blocks of the non-decreasing least-squares fit, pooled on the cluster.

    Parts of the value range are pooled by themselves. Then neighbouring parts
    are merged, two by two, in rounds: the left one's means above the first mean
    of the right one and the right one's below the last of the left one are the
    only blocks that can still change (a pooled mean lies between the two), so
    only these border blocks meet in a task; all others stay where they are.
    Merging is associative, and rounds are the logarithm of the number of parts.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(p).cast("double").alias("low")).agg(
        F.sum(F.col(y).cast("double")).alias("total"), F.count(F.lit(1)).cast("double").alias("weight"))
    dealt = points.select("low", F.col("low").alias("high"), "total", "weight").repartitionByRange(parts, "low").sortWithinPartitions("low")
    numbered = checkpointed(spark, dealt.withColumn("part", F.spark_partition_id().cast("long")))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        part = rows["part"].iloc[0]
        return pooled(rows.sort_values("low")).assign(part=part)[["part", "low", "high", "total", "weight"]]

    blocks = checkpointed(spark, numbered.groupBy("part").applyInPandas(merge, BLOCKS))
    while parts > 1:
        mean = F.col("total") / F.col("weight")
        ends = blocks.groupBy("part").agg(F.min_by(mean, "low").alias("first"), F.max_by(mean, "low").alias("last"))
        beside = ends.select(F.col("part").bitwiseXOR(F.lit(1)).alias("part"), "first", "last")
        met = blocks.join(beside, "part", "left")
        torn = F.when(F.col("part") % 2 == 0, mean >= F.col("first")).otherwise(mean <= F.col("last"))
        marked = checkpointed(spark, met.select(F.shiftright("part", 1).alias("part"), "low", "high", "total", "weight", F.coalesce(torn, F.lit(False)).alias("torn")))
        merged = marked.where("torn").drop("torn").groupBy("part").applyInPandas(merge, BLOCKS)
        blocks = checkpointed(spark, marked.where("NOT torn").drop("torn").unionByName(merged))
        parts = (parts + 1) // 2
    return blocks.select("low", "high", (F.col("total") / F.col("weight")).alias("mean"))


class Isotonic:
    """Non-decreasing map of predictions; linear between blocks, flat beyond both ends."""

    def fit(self, df: DataFrame, p: str = "pred", y: str = "demand") -> "Isotonic":
        # Only the borders and means of the blocks are taken to the driver.
        blocks = isotonic_blocks(df, p, y).orderBy("low").toPandas()
        self.edges = blocks[["low", "high"]].to_numpy().ravel()
        self.levels = np.repeat(blocks["mean"].to_numpy(), 2)
        return self

    def transform(self, df: DataFrame, p: str = "pred", out: str = "calibrated") -> DataFrame:
        edges, levels = self.edges, self.levels

        @F.pandas_udf("double")
        def level(value: pd.Series) -> pd.Series:
            x = value.to_numpy(dtype=float)
            return pd.Series(np.where(np.isnan(x), np.nan, np.interp(x, edges, levels))) if len(edges) else pd.Series(np.full(len(x), np.nan))

        value = level(F.col(p).cast("double"))
        return df.withColumn(out, F.when(F.isnan(value), None).otherwise(value))


class Sigmoid:
    """Logistic map of predictions to the target, fitted on targets scaled to [0, 1]."""

    def fit(self, df: DataFrame, p: str = "pred", y: str = "demand") -> "Sigmoid":
        low, high = df.agg(F.min(y), F.max(y)).first()
        self.low, self.high = float(low), float(high)
        scaled = df.withColumn("_scaled", (F.col(y) - self.low) / (self.high - self.low + 1e-8))
        combined = _weighted(scaled, p, "_scaled")
        rows = VectorAssembler(inputCols=["feature"], outputCol="features").transform(combined)
        glm = GeneralizedLinearRegression(family="binomial", link="logit", weightCol="weight", maxIter=50)
        fitted = glm.fit(rows)
        self.slope, self.offset = float(fitted.coefficients[0]), float(fitted.intercept)
        return self

    def transform(self, df: DataFrame, p: str = "pred", out: str = "calibrated") -> DataFrame:
        chance = 1 / (1 + F.exp(-(self.slope * F.col(p) + self.offset)))
        return df.withColumn(out, chance * (self.high - self.low) + self.low)


class Temperature:
    def fit(self, df: DataFrame, p: str = "pred", y: str = "demand") -> "Temperature":
        self.temperature = float(temperature(df, p, y).first()[0])
        return self

    def transform(self, df: DataFrame, p: str = "pred", out: str = "calibrated") -> DataFrame:
        return apply_temperature(df, F.lit(self.temperature), p, out)


def compare_calibrators(df: DataFrame, p: str = "pred", y: str = "demand") -> DataFrame:
    """Mean absolute error of the raw and of the calibrated predictions, smallest first."""
    kinds = {"Isotonic": Isotonic(), "Platt": Sigmoid(), "Temperature": Temperature()}
    scored = df.select(F.col(p).alias("Uncalibrated"), F.col(y).alias("_y"))
    for name, kind in kinds.items():
        scored = kind.fit(df, p, y).transform(scored, "Uncalibrated", name)
    names = ["Uncalibrated", *kinds]
    one_row = scored.agg(*[F.round(F.avg(F.abs(F.col(n) - F.col("_y"))), 4).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(n).alias("calibrator"), F.col(n).alias("mae")) for n in names])
    return one_row.select(F.explode(pairs).alias("_p")).select("_p.*").orderBy("mae", "calibrator")
