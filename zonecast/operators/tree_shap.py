"""Exact attributions and pairwise interactions of boosted trees.

The explained game is the path-dependent one: a feature that is not known
follows both sides of its splits in proportion to the training rows on them.
For one leaf this is value * product over the features of its path, a known
feature giving 1 or 0 (the row meets all its splits on the path or not), an
unknown one its share of rows z. The Shapley weights of such a product are
integrals of k-th powers, so a feature j has exactly

    value * (o_j - z_j) * integral over t in (0, 1) of the product over the other
    features i of z_i (1 - t) + o_i t,

a polynomial of degree under the depth, which Gauss-Legendre nodes integrate
without error: time per row is trees * leaves * depth^2, where subsets would take
2^depth. Interactions have the factors (o_j - z_j)(o_k - z_k) / 2 and leave both
features out of the product.

The leaves' conditions are arrays as large as the model and are broadcast; rows
are scored in Arrow batches where they lie. What is explained is the score
before it is cut off at 0. Rows with a null feature are refused by the model's
assembler, as in prediction.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonecast.operators.modeling import Booster
from zonecast.session import new_dir

#: Rows whose interactions of all pairs are held at once.
CHUNK = 256


@dataclass
class Leaf:
    """value: weighted prediction; features on the path, their shares of rows, and the ranges or categories that lead here."""

    value: float
    features: np.ndarray
    shares: np.ndarray
    above: np.ndarray
    upto: np.ndarray
    allowed: dict[int, np.ndarray]

    def met(self, x: np.ndarray) -> np.ndarray:
        """For rows x, which features of the path lead to this leaf: rows by features."""
        own = x[:, self.features]
        out = (own > self.above) & (own <= self.upto)
        for place, table in self.allowed.items():
            code = own[:, place].astype(np.int64)
            out[:, place] = table[np.where((code >= 0) & (code < len(table) - 1), code, len(table) - 1)]
        return out


def tree_leaves(spark: SparkSession, booster: Booster) -> list[Leaf]:
    """All leaves of a fitted booster, read from the stored form of its trees."""
    gbt = booster.model.stages[-1]
    path = new_dir(spark, "trees")
    gbt.write().save(path)
    # As many rows as the model has nodes.
    nodes: dict[int, dict[int, dict]] = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData").toLocalIterator():
        nodes.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"].asDict(recursive=True)
    return [leaf for tree, weight in enumerate(gbt.treeWeights) for leaf in _leaves_of(nodes[tree], weight)]


def _leaves_of(nodes: dict[int, dict], weight: float) -> Iterator[Leaf]:
    waiting: list[tuple[int, dict[int, dict]]] = [(0, {})]
    while waiting:
        at, path = waiting.pop()
        node = nodes[at]
        if node["leftChild"] < 0:
            order = sorted(path)
            yield Leaf(
                weight * node["prediction"], np.array(order, dtype=np.int64), np.array([path[f]["z"] for f in order]),
                np.array([path[f]["above"] for f in order]), np.array([path[f]["upto"] for f in order]),
                {i: path[f]["allowed"] for i, f in enumerate(order) if path[f]["allowed"] is not None})
            continue
        split, rows = node["split"], node["impurityStats"][0]
        feature, kinds = split["featureIndex"], split["numCategories"]
        for child, left in ((node["leftChild"], True), (node["rightChild"], False)):
            own = dict(path.get(feature) or {"z": 1.0, "above": -np.inf, "upto": np.inf, "allowed": None})
            own["z"] *= nodes[child]["impurityStats"][0] / rows
            if kinds < 0:
                cut = split["leftCategoriesOrThreshold"][0]
                own["upto" if left else "above"] = min(own["upto"], cut) if left else max(own["above"], cut)
            else:
                # One more place, for values that are no category: they go right.
                table = np.zeros(kinds + 1, dtype=bool)
                table[np.array(split["leftCategoriesOrThreshold"], dtype=np.int64)] = True
                table = table if left else ~table
                own["allowed"] = table if own["allowed"] is None else own["allowed"] & table
            waiting.append((child, {**path, feature: own}))


def _patterns(leaf: Leaf, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(met, which, factors, weights): the distinct patterns of the rows, each row's one, and the factors at the nodes of t."""
    met = leaf.met(x)
    codes = np.packbits(met, axis=1, bitorder="little").astype(np.int64)
    code = sum(codes[:, i] << (8 * i) for i in range(codes.shape[1]))
    kinds, first, which = np.unique(code, return_index=True, return_inverse=True)
    nodes, weights = np.polynomial.legendre.leggauss(len(leaf.features) // 2 + 1)
    t = (nodes + 1) / 2
    known = met[first].astype(float)
    return known, which, leaf.shares[None, :, None] * (1 - t) + known[:, :, None] * t, weights / 2


def leaf_attributions(leaf: Leaf, x: np.ndarray) -> np.ndarray:
    """The leaf's part of each of its features' attributions: rows by features of the path."""
    known, which, factors, weights = _patterns(leaf, x)
    # No factor is 0: every child of a split has rows, and t lies inside (0, 1).
    others = (factors.prod(axis=1, keepdims=True) / factors) @ weights
    return (leaf.value * (known - leaf.shares) * others)[which]


def leaf_interactions(leaf: Leaf, x: np.ndarray) -> np.ndarray:
    """The leaf's part of each pair's interaction (its half for either order): rows by features by features, 0 on the diagonal."""
    known, which, factors, weights = _patterns(leaf, x)
    change = known - leaf.shares
    others = np.einsum("ut,uit,ujt,t->uij", factors.prod(axis=1), 1 / factors, 1 / factors, weights)
    out = 0.5 * leaf.value * change[:, :, None] * change[:, None, :] * others
    out[:, np.arange(out.shape[1]), np.arange(out.shape[1])] = 0.0
    return out[which]


def base_value(leaves: Sequence[Leaf]) -> float:
    return float(sum(leaf.value * leaf.shares.prod() for leaf in leaves))


def attributions_of(leaves: Sequence[Leaf], x: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape)
    for leaf in leaves:
        if len(leaf.features):
            out[:, leaf.features] += leaf_attributions(leaf, x)
    return out


def interactions_of(leaves: Sequence[Leaf], x: np.ndarray) -> np.ndarray:
    """Rows by features by features; the diagonal has what of an attribution no pair takes, so rows of the matrix sum to it."""
    out = np.zeros((len(x), x.shape[1], x.shape[1]))
    for leaf in leaves:
        if len(leaf.features) > 1:
            out[np.ix_(np.arange(len(x)), leaf.features, leaf.features)] += leaf_interactions(leaf, x)
    own = attributions_of(leaves, x) - out.sum(axis=2)
    out[:, np.arange(x.shape[1]), np.arange(x.shape[1])] = own
    return out


def _inputs(df: DataFrame, booster: Booster, keys: Sequence[str]) -> DataFrame:
    """(keys, _x): the numbers the trees see, in the order of `booster.inputs`."""
    ready = PipelineModel(booster.model.stages[:-1]).transform(df.select(*dict.fromkeys([*keys, *booster.features])))
    return ready.select(*keys, vector_to_array("features").alias("_x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def attributions(df: DataFrame, booster: Booster, keys: Sequence[str] = ("timestamp", "zone")) -> DataFrame:
    """Exact attributions, long form: keys, feature, attribution, base_value, prediction (before the cut at 0)."""
    leaves = tree_leaves(df.sparkSession, booster)
    base, names = base_value(leaves), list(booster.inputs)
    sent = df.sparkSession.sparkContext.broadcast(leaves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = attributions_of(sent.value, _matrix(batch.column(len(keys)), len(names)))
            columns = [batch.column(i) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(found), pa.list_(pa.float64()))], names=[*keys, "_phi"])

    rows = _inputs(df, booster, keys)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    wide = rows.mapInArrow(run, f"{kinds}, _phi array<double>")
    total = F.aggregate("_phi", F.lit(base), lambda t, v: t + v)
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("_phi").alias("attribution"))
    return wide.select(*keys, total.alias("prediction"), F.explode(pairs).alias("_p")).select(
        *keys, F.col("_p.feature").alias("feature"), F.col("_p.attribution").alias("attribution"), F.lit(base).alias("base_value"), "prediction")


def interactions(df: DataFrame, booster: Booster, features: Sequence[str], keys: Sequence[str] = ("timestamp", "zone")) -> DataFrame:
    """Long form: keys, feature, partner, interaction, for the given features with all partners; a feature's own row has the rest of its attribution."""
    leaves, names = tree_leaves(df.sparkSession, booster), list(booster.inputs)
    sent, wanted = df.sparkSession.sparkContext.broadcast(leaves), [names.index(f) for f in features]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(start, CHUNK)
                found = interactions_of(sent.value, _matrix(batch.column(len(keys)), len(names)))[:, wanted, :]
                columns = [batch.column(i) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(list(found.reshape(len(found), -1)), pa.list_(pa.float64()))], names=[*keys, "_phi"])

    rows = _inputs(df, booster, keys)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(p).alias("partner")) for f in features for p in names])
    wide = rows.mapInArrow(run, f"{kinds}, _phi array<double>")
    return wide.select(*keys, F.explode(F.arrays_zip(pairs.alias("of"), F.col("_phi").alias("v"))).alias("_p")).select(
        *keys, "_p.of.feature", "_p.of.partner", F.col("_p.v").alias("interaction"))


def interaction_strength(df: DataFrame, booster: Booster) -> DataFrame:
    """(feature, partner, strength): the mean absolute interaction of every two features over all rows.

    A task hands on one number per pair, however many rows it has.
    """
    leaves, names = tree_leaves(df.sparkSession, booster), list(booster.inputs)
    sent, width = df.sparkSession.sparkContext.broadcast(leaves), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((width, width)), 0
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                x = _matrix(whole.column(0).slice(start, CHUNK), width)
                total += np.abs(interactions_of(sent.value, x)).sum(axis=0)
                rows += len(x)
        i, j = np.indices((width, width)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel()), pa.array([rows] * len(i))], names=["i", "j", "s", "n"])

    sums = _inputs(df, booster, []).mapInArrow(run, "i int, j int, s double, n bigint").where("i <> j")
    name = lambda c: F.get(F.array(*[F.lit(n) for n in names]), F.col(c))
    return sums.groupBy("i", "j").agg((F.sum("s") / F.greatest(F.sum("n"), F.lit(1))).alias("strength")).select(
        name("i").alias("feature"), name("j").alias("partner"), "strength")


def strongest_partners(strength: DataFrame) -> DataFrame:
    """(feature, partner): for each feature the one it interacts with most; the first by name of equal ones."""
    order = Window.partitionBy("feature").orderBy(F.desc("strength"), "partner")
    return strength.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("feature", "partner", "strength")


def dependence(df: DataFrame, booster: Booster, features: Sequence[str], keys: Sequence[str] = ("timestamp", "zone")) -> DataFrame:
    """(keys, feature, value, attribution, partner, interaction_value, interaction) points; the partner is the strongest one found.

    Only the features' names reach the driver, one row each.
    """
    found = {r["feature"]: r["partner"] for r in strongest_partners(interaction_strength(df, booster)).collect()}
    partner = {f: found[f] for f in features}
    values = _inputs(df, booster, keys)
    place = {n: i for i, n in enumerate(booster.inputs)}
    points = F.array(*[F.struct(F.lit(f).alias("feature"), F.get("_x", F.lit(place[f])).alias("value"), F.lit(partner[f]).alias("partner"),
                                F.get("_x", F.lit(place[partner[f]])).alias("interaction_value")) for f in features])
    flat = values.select(*keys, F.explode(points).alias("_p")).select(*keys, "_p.*")
    own = attributions(df, booster, keys).where(F.col("feature").isin(list(features))).select(*keys, "feature", "attribution")
    both = interactions(df, booster, features, keys)
    return flat.join(own, [*keys, "feature"]).join(both, [*keys, "feature", "partner"]).select(
        *keys, "feature", "value", "attribution", "partner", "interaction_value", "interaction")
