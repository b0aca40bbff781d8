"""Categories as numbers: ordered target statistics.

A training row gets the mean target of the rows of its category that come before
it in a hashed order, smoothed by the mean of all rows before it; so no row sees
its own target. Other rows get the statistics of whole categories. Sums of
earlier rows are bucketed prefix sums, so a category that a third of all rows
have is cut by its order into many parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.operators.ordering import prefix_sums
from zonecast.session import checkpointed


def hashed_place(keys: Sequence[str], seed: int) -> Column:
    """The row's place: the first 15 hex digits of an md5 of the seed and the keys as text; null keys count as empty."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def category_key(category: str) -> Column:
    """The category as text in which a null is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(category).cast("string")), F.lit("null"))


class OrderedTargets:
    """Target statistics of one column. `weight` is how many rows the overall mean counts as."""

    def __init__(self, category: str, label: str = "demand", keys: Sequence[str] = ("timestamp", "zone"), weight: float = 1.0, seed: int = 42):
        self.category, self.label, self.keys, self.weight, self.seed = category, label, list(keys), weight, seed

    def fit(self, df: DataFrame) -> "OrderedTargets":
        """`totals`: (_category, _s, _n) of whole categories; the overall sums are their sums."""
        self.totals = checkpointed(df.sparkSession, self._placed(df).groupBy("_category").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n")))
        return self

    def _placed(self, df: DataFrame) -> DataFrame:
        """One row per category and place. Rows without a label are no evidence."""
        rows = df.where(F.col(self.label).isNotNull())
        return rows.groupBy(category_key(self.category).alias("_category"), hashed_place(self.keys, self.seed).alias("_place")).agg(
            F.sum(F.col(self.label).cast("double")).alias("_s"), F.count(F.lit(1)).alias("_n"))

    def fit_transform(self, df: DataFrame, out: str) -> DataFrame:
        """The training rows with the statistic of the rows before each; the very first one gets 0."""
        self.fit(df)
        placed = checkpointed(df.sparkSession, self._placed(df))
        own = prefix_sums(placed, "_place", ["_s", "_n"], ["_category"]).select("_category", "_place", F.col("_s_before").alias("_cs"), F.col("_n_before").alias("_cn"))
        whole = placed.groupBy("_place").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
        before = prefix_sums(whole, "_place", ["_s", "_n"]).select("_place", F.coalesce(F.try_divide("_s_before", "_n_before"), F.lit(0.0)).alias("_prior"))
        value = (F.col("_cs") + self.weight * F.col("_prior")) / (F.col("_cn") + self.weight)
        codes = own.join(before, "_place").select("_category", "_place", value.alias(out))
        keyed = df.withColumns({"_category": category_key(self.category), "_place": hashed_place(self.keys, self.seed)})
        return keyed.join(codes, ["_category", "_place"], "left").drop("_category", "_place")

    def transform(self, df: DataFrame, out: str) -> DataFrame:
        """Other rows with the statistic of their whole category; the overall mean for one that training never saw."""
        mean = self.totals.agg((F.sum("_s") / F.sum("_n")).alias("m")).scalar()
        keyed = df.withColumn("_category", category_key(self.category)).join(self.totals, "_category", "left").withColumn("_m", mean)
        value = (F.coalesce("_s", F.lit(0.0)) + self.weight * F.col("_m")) / (F.coalesce("_n", F.lit(0)) + self.weight)
        return keyed.withColumn(out, value).drop("_category", "_s", "_n", "_m")
