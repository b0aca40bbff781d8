"""Model explanation as batch jobs over any `score` function that adds `prediction`.

Random draws are hashes of the row key, the draw number and a seed, so a lost
task gives the same numbers when it runs again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonecast.operators.drift import long_values
from zonecast.operators.ordering import bucket_of, quantiles

Score = Callable[[DataFrame], DataFrame]


def uniform(*parts: Column | str | int) -> Column:
    """Number in [0, 1) fixed by the given parts."""
    seeded = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.pmod(F.xxhash64(*seeded), F.lit(1 << 30)) / float(1 << 30)


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows dealt out by key before each is multiplied into many.

    The multiplied rows then use every core, and the later grouping by the same
    keys needs no shuffle of its own.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


# Partial dependence -----------------------------------------------------------


def grid_values(df: DataFrame, feature: str, points: int, low: float = 0.05, high: float = 0.95) -> Column:
    """Evenly spaced values between two quantiles of the feature, as one array."""
    ends = quantiles(df, feature, [low, high], name="q")
    start, stop = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    step = (stop - start) / max(points - 1, 1)
    steps = F.sequence(F.lit(0), F.lit(points - 1))
    return ends.select(F.transform(steps, lambda i: start + i * step).alias("grid")).scalar()


def over_grid(df: DataFrame, feature: str, score: Score, points: int = 50, keep: Sequence[str] = ()) -> DataFrame:
    """Every row scored at every grid value of the feature: (keep, grid_id, grid_value, prediction)."""
    spread = df.withColumn("_grid", grid_values(df, feature, points)).select(
        *df.columns, F.posexplode("_grid").alias("grid_id", "grid_value")
    )
    scored = score(spread.withColumn(feature, F.col("grid_value")))
    return scored.select(*keep, F.col("grid_id").cast("long").alias("grid_id"), "grid_value", "prediction")


def pdp(df: DataFrame, feature: str, score: Score, points: int = 50) -> DataFrame:
    """Mean prediction per grid value; rows are averaged before anything is shuffled."""
    return over_grid(df, feature, score, points).groupBy("grid_id", "grid_value").agg(F.avg("prediction").alias("avg_pred"))


def ice(df: DataFrame, feature: str, score: Score, keys: Sequence[str] = ("timestamp", "zone"), points: int = 50) -> DataFrame:
    """One curve per row."""
    return over_grid(df, feature, score, points, keys)


def ice_centred(curves: DataFrame, keys: Sequence[str] = ("timestamp", "zone")) -> DataFrame:
    """Each curve less its value at the first grid point (a few dozen rows per curve)."""
    start = F.first("prediction").over(Window.partitionBy(*keys).orderBy("grid_id"))
    return curves.withColumn("centred", F.col("prediction") - start)


def mean_centred(centred: DataFrame) -> DataFrame:
    return centred.groupBy("grid_id", "grid_value").agg(F.avg("centred").alias("avg_centred"))


def pdp_2d(df: DataFrame, first: str, second: str, score: Score, points: int = 20) -> DataFrame:
    """Mean prediction on a grid of two features, each between its 10th and 90th percentile."""
    with_grids = df.withColumn("_g1", grid_values(df, first, points, 0.1, 0.9)).withColumn(
        "_g2", grid_values(df, second, points, 0.1, 0.9)
    )
    spread = with_grids.select("*", F.posexplode("_g1").alias("i", "v1")).select("*", F.posexplode("_g2").alias("j", "v2"))
    scored = score(spread.withColumns({first: F.col("v1"), second: F.col("v2")}))
    return scored.groupBy(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v1", "v2").agg(
        F.avg("prediction").alias("avg_pred")
    )


# Shapley values ---------------------------------------------------------------


def background_rows(df: DataFrame, features: Sequence[str], draws: int, seed: int = 42,
                    keys: Sequence[str] = ("timestamp", "zone")) -> Column:
    """`draws` rows chosen by hash, as one array of structs (a sampling step of fixed small size)."""
    row = F.struct(*[F.col(f).cast("double").alias(f) for f in features])
    order = F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))
    chosen = df.select(order.alias("_o"), row.alias("_row")).orderBy("_o").limit(draws)
    return chosen.agg(F.array_sort(F.collect_list(F.struct("_o", "_row"))).alias("b")).select(
        F.transform("b", lambda e: e["_row"]).alias("rows")
    ).scalar()


def shapley(df: DataFrame, features: Sequence[str], score: Score, keys: Sequence[str] = ("timestamp", "zone"),
            draws: int = 4, seed: int = 42, background: Column | None = None) -> DataFrame:
    """Monte-Carlo Shapley values, long form: keys, feature, attribution, base_value, prediction.

    Each draw replaces a background row by the explained row, one feature after
    the other in random order; a feature is credited with the change in the
    score. Per row the attributions add up to prediction - base_value exactly.
    """
    features = list(features)
    n = len(features)
    pool = background_rows(df, features, draws, seed, keys) if background is None else background
    base = spread(df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]), keys).withColumn("_pool", pool)
    drawn = base.select(*keys, *features, F.posexplode("_pool").alias("_draw", "_other"))
    # The draw's random order: feature numbers (from 1) sorted by hash; place i is feature i's position in it.
    own_text = ", ".join(f"`{k}`" for k in keys)
    marks = ", ".join(f"named_struct('h', xxhash64({own_text}, _draw, {i}, {seed}), 'i', {i})" for i in range(1, n + 1))
    ordered = drawn.withColumn("_order", F.expr(f"transform(array_sort(array({marks})), e -> e.i)"))
    placed = ordered.withColumns({f"_p{i}": F.expr(f"array_position(_order, {i})") for i in range(1, n + 1)})
    steps = placed.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(n))))
    mixed = steps.withColumns({
        f: F.expr(f"CASE WHEN _p{i} <= _step THEN `{f}` ELSE _other.`{f}` END") for i, f in enumerate(features, start=1)
    })
    # Between steps s - 1 and s the score changes by the feature at place s.
    names = "array(" + ", ".join(f"'{f}'" for f in features) + ")"
    flat = score(mixed).select(*keys, F.explode(F.array_compact(F.array(
        F.expr(f"if(_step > 0, named_struct('feature', get({names}, _order[_step - 1] - 1), 'v', prediction), NULL)"),
        F.expr(f"if(_step < {n}, named_struct('feature', get({names}, get(_order, _step) - 1), 'v', -prediction), NULL)"),
        F.expr("if(_step = 0, named_struct('feature', '__base__', 'v', prediction), NULL)"),
    ))).alias("_c"))
    # Everything of a row sits in one partition here, so this combines before its shuffle.
    sums = flat.groupBy(*keys, "_c.feature").agg(F.sum("_c.v").alias("s"))
    with_rounds = sums.withColumn("_rounds", F.size(pool))
    whole = Window.partitionBy(*keys)
    level = F.col("s") / F.col("_rounds")
    is_base = F.col("feature") == "__base__"
    out = with_rounds.select(
        *keys, "feature", level.alias("attribution"),
        F.max(F.when(is_base, level)).over(whole).alias("base_value"), F.sum(level).over(whole).alias("prediction"),
    )
    return out.where("feature <> '__base__'")


def global_importance(attributions: DataFrame) -> DataFrame:
    return (
        attributions.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )


def importance_by_group(attributions: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """Mean attribution, one row per group, one column per feature."""
    return attributions.groupBy(group).pivot("feature", list(features)).agg(F.avg("attribution"))


def top_contributors(attributions: DataFrame, keys: Sequence[str] = ("timestamp", "zone"), n: int = 10) -> DataFrame:
    """The n largest attributions by absolute value per row, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.abs("attribution")), "feature")
    return attributions.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def local_explanation(attributions: DataFrame, condition: Column, keys: Sequence[str] = ("timestamp", "zone"),
                      n: int = 10) -> DataFrame:
    """Base value, prediction and top contributions of the rows that meet `condition`."""
    top = top_contributors(attributions.where(condition), keys, n)
    return top.select(
        *keys, F.round("base_value", 2).alias("base_value"), F.round("prediction", 2).alias("prediction"), "rank",
        "feature", F.round("attribution", 3).alias("attribution"),
    )


def dependence(attributions: DataFrame, df: DataFrame, features: Sequence[str], interaction: str,
               keys: Sequence[str] = ("timestamp", "zone")) -> DataFrame:
    """(feature, value, attribution, interaction value) points of the given features."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    inputs = df.select(*keys, F.col(interaction).cast("double").alias("interaction_value"), F.explode(pairs).alias("_p"))
    flat = inputs.select(*keys, "interaction_value", "_p.feature", "_p.value")
    return attributions.join(flat, [*keys, "feature"]).select(*keys, "feature", "value", "attribution", "interaction_value")


# Local linear explanation -----------------------------------------------------


def quartile_edges(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row with `edges`: a struct of the distinct edges (min, quartiles, max) of each feature."""
    per = quantiles(long_values(df, features), "value", [0, 0.25, 0.5, 0.75, 1], ["feature"], "e")
    as_map = per.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.array_distinct("e").alias("e")))).alias("m"))
    return as_map.select(F.struct(*[F.element_at("m", F.lit(f)).alias(f) for f in features]).alias("edges"))


def quartile_bin(value: str, edges: str) -> Column:
    """0-based right-closed bin of a value between distinct edges."""
    inner = f"slice({edges}, 2, greatest(size({edges}) - 2, 0))"
    return bucket_of(value, inner, 8)


def lime(df: DataFrame, features: Sequence[str], score: Score, keys: Sequence[str] = ("timestamp", "zone"),
         draws: int = 100, n_features: int = 10, seed: int = 42, ridge: float = 1.0) -> DataFrame:
    """Local linear fit around every row.

    Each draw picks a quartile bin and a value inside it per feature; the linear
    model sees 1 where the draw stayed in the row's own bin. Draws weigh
    sqrt(exp(-d^2 / w^2)) with d^2 the number of left bins and w = 0.75 sqrt(features).
    The weighted sums are made in Spark; a pandas UDF solves one small system per row.
    """
    features = list(features)
    q = len(features)
    edges = quartile_edges(df, features).scalar()
    own = ", ".join(f"`{k}`" for k in keys)
    typed = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features])
    rows = spread(typed, keys).withColumn("_edges", edges).select(
        *keys, *[F.col(f).alias(f"_x{i}") for i, f in enumerate(features)],
        *[quartile_bin(f, f"_edges.`{f}`").alias(f"_b{i}") for i, f in enumerate(features)],
    )
    # The edges are added after the rows are multiplied: they are the same for all.
    drawn = rows.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws)))).withColumn("_edges", edges)

    def chance(i: int, label: str) -> str:
        return f"(pmod(xxhash64({own}, _draw, {i}, {seed}, '{label}'), {1 << 30}L) / {float(1 << 30)!r}D)"

    bins, values = {}, {}
    for i, f in enumerate(features):
        e = f"_edges.`{f}`"
        picked = f"CAST(floor({chance(i, 'bin')} * greatest(size({e}) - 1, 1)) AS INT)"
        bins[f"_d{i}"] = F.expr(f"if(_draw = 0, _b{i}, {picked})")  # draw 0 is the row itself
        low = f"get({e}, _d{i})"
        inside = f"{low} + (coalesce(get({e}, _d{i} + 1), {low}) - {low}) * {chance(i, 'value')}"
        values[f] = F.expr(f"if(_draw = 0, _x{i}, {inside})")
    scored = score(drawn.withColumns(bins).withColumns(values))
    left = " + ".join(f"CAST(_d{i} <> _b{i} AS DOUBLE)" for i in range(q))
    terms = scored.select(
        *keys, *[F.expr(f"CAST(_d{i} = _b{i} AS DOUBLE)").alias(f"z{i + 1}") for i in range(q)],
        F.expr(f"sqrt(exp(-({left}) / {0.75 * 0.75 * q!r}D))").alias("w"), F.col("prediction").alias("y"),
        F.expr("if(_draw = 0, prediction, NULL)").alias("own"), *[f"_b{i}" for i in range(q)],
    ).withColumn("z0", F.lit(1.0))
    # The weighted cross products are symmetric: one triangle is summed, mirrored afterwards.
    upper = [(i, j) for i in range(q + 1) for j in range(i, q + 1)]
    sums = terms.groupBy(*keys).agg(
        *[F.expr(f"sum(w * z{i} * z{j}) AS g{i}_{j}") for i, j in upper],
        *[F.expr(f"sum(w * z{i} * y) AS c{i}") for i in range(q + 1)],
        F.expr("sum(w * y * y) AS yy"), F.max("own").alias("prediction"), *[F.max(f"_b{i}").alias(f"_b{i}") for i in range(q)],
    )
    conditions = []
    for i, f in enumerate(features):
        e = f"_edges.`{f}`"
        low, high = (f"CAST(round(get({e}, _b{i} + {k}), 2) AS STRING)" for k in (0, 1))
        conditions.append(
            f"CASE WHEN size({e}) <= 2 THEN '{f}' WHEN _b{i} = 0 THEN concat('{f} <= ', {high}) "
            f"WHEN _b{i} >= size({e}) - 2 THEN concat('{f} > ', {low}) ELSE concat({low}, ' < {f} <= ', {high}) END"
        )
    gram = [f"g{min(i, j)}_{max(i, j)}" for i in range(q + 1) for j in range(q + 1)]
    sums = sums.withColumn("_edges", edges).select(
        *keys, "prediction", "yy", F.array(*gram).alias("gram"), F.array(*[f"c{i}" for i in range(q + 1)]).alias("cross"),
        F.expr(f"array({', '.join(conditions)})").alias("conditions"),
    )

    @F.pandas_udf("struct<intercept: double, r2: double, weights: array<double>>")
    def solve(gram: pd.Series, cross: pd.Series, yy: pd.Series) -> pd.DataFrame:
        a = np.stack(gram.to_numpy()).reshape(-1, q + 1, q + 1)
        b = np.stack(cross.to_numpy())
        penalty = ridge * np.eye(q + 1)
        penalty[0, 0] = 0.0
        w = np.linalg.solve(a + penalty, b[:, :, None])[:, :, 0]
        total = a[:, 0, 0]
        mean = b[:, 0] / total
        residual = yy.to_numpy() - 2 * np.einsum("ij,ij->i", w, b) + np.einsum("ij,ijk,ik->i", w, a, w)
        spread = yy.to_numpy() - total * mean * mean
        r2 = np.where(spread > 1e-12, 1 - residual / np.where(spread > 1e-12, spread, 1.0), 0.0)
        return pd.DataFrame({"intercept": w[:, 0], "r2": r2, "weights": list(w[:, 1:])})

    solved = sums.withColumn("_fit", solve("gram", "cross", "yy"))
    entries = F.transform(
        F.sequence(F.lit(0), F.lit(q - 1)),
        lambda i: F.struct(
            (-F.abs(F.get("_fit.weights", i))).alias("size"), F.get(F.array(*[F.lit(f) for f in features]), i).alias("feature"),
            F.get("conditions", i).alias("condition"), F.get("_fit.weights", i).alias("weight"),
        ),
    )
    top = F.slice(F.array_sort(entries), 1, n_features)
    return solved.select(
        *keys, "prediction", F.col("_fit.intercept").alias("intercept"), F.col("_fit.r2").alias("local_r2"),
        F.transform(top, lambda e: F.struct(e["feature"].alias("feature"), e["condition"].alias("condition"), e["weight"].alias("weight"))).alias("top_features"),
    )


def agreement(global_scores: DataFrame, local_scores: DataFrame, n: int = 10) -> DataFrame:
    """Top-n features of two score tables side by side by rank, with the Jaccard overlap of the sets.

    Both inputs have columns feature and score; the absolute score decides.
    """
    def ranked(df: DataFrame, side: str) -> DataFrame:
        # Cut to n rows before the rank is taken.
        top = df.withColumn("_s", F.abs("score")).orderBy(F.desc("_s"), "feature").limit(n)
        order = Window.partitionBy(F.lit(0)).orderBy(F.desc("_s"), "feature")
        return top.select(
            F.row_number().over(order).cast("long").alias("rank"), F.col("feature").alias(f"{side}_feature"),
            F.col("score").alias(f"{side}_score"),
        )

    both = ranked(global_scores, "global").join(ranked(local_scores, "local"), "rank", "full")
    sets = both.agg(F.collect_set("global_feature").alias("g"), F.collect_set("local_feature").alias("l"))
    share = F.size(F.array_intersect("g", "l")) / F.size(F.array_union("g", "l"))
    return both.withColumn("jaccard", sets.select(F.round(share, 3).alias("j")).scalar()).orderBy("rank")


def set_overlap(first: DataFrame, second: DataFrame, column: str = "feature") -> DataFrame:
    """Sizes of the intersection and union of two sets, and their ratio."""
    common = first.select(column).intersect(second.select(column)).agg(F.count(F.lit(1)).alias("n")).scalar()
    union = first.select(column).union(second.select(column)).distinct()
    out = union.agg(F.count(F.lit(1)).alias("union_size")).withColumn("intersection_size", common)
    return out.withColumn("jaccard", F.coalesce(F.try_divide("intersection_size", "union_size"), F.lit(0.0)))


# Anchors and counterfactuals --------------------------------------------------


def quartile_rule(df: DataFrame, features: Sequence[str], row: dict[str, float]) -> tuple[list[Column], list[str]]:
    """Per feature the condition, and its text, that holds in the row's quartile bin; without data it always holds."""
    edges = quartile_edges(df, features).first()["edges"]
    conditions, texts = [], []
    for f in features:
        inner = list((edges and edges[f]) or [])[1:-1]
        at = sum(1 for e in inner if e < float(row[f]))
        low = inner[at - 1] if at > 0 else None
        high = inner[at] if at < len(inner) else None
        inside = F.lit(True)
        if low is not None:
            inside = inside & (F.col(f) > low)
        if high is not None:
            inside = inside & (F.col(f) <= high)
        conditions.append(inside)
        left = f"{low:.2f} < " if low is not None and high is not None else ""
        right = f" <= {high:.2f}" if high is not None else f" > {low:.2f}" if low is not None else ""
        texts.append(f"{left}{f}{right}")
    return conditions, texts


def prediction_quartile(scored: DataFrame, features: Sequence[str], score: Score, row: dict[str, float]) -> tuple[float, Column]:
    """The row's prediction, and whether a prediction lies in the same quartile of all predictions."""
    cuts = quantiles(scored, "prediction", [0.25, 0.5, 0.75], name="c").select(F.array_distinct("c")).first()[0]
    one = [tuple(float(row[f]) for f in features)]
    own = score(scored.sparkSession.createDataFrame(one, ", ".join(f"{f} double" for f in features)))
    predicted = float(own.select("prediction").first()[0])
    cuts = [c for c in cuts or [] if c is not None]
    if not cuts:
        return predicted, F.lit(True)
    target = sum(1 for c in cuts if c < predicted)
    edges = f"array({', '.join(f'{float(c)!r}D' for c in cuts)})"
    return predicted, bucket_of("prediction", edges, 4) == target


def anchor(df: DataFrame, features: Sequence[str], score: Score, row: dict[str, float], threshold: float = 0.9,
           beam: int = 4) -> DataFrame:
    """The shortest rule on quartile bins under which the prediction stays in the row's prediction quartile.

    Each level is one pass that counts coverage and hits of all candidate rules
    at once; only those counts reach the driver. Among the rules of the first
    level that reach `threshold`, the one with the widest coverage wins; if none
    does, the most precise rule of the last level is returned.
    """
    features = list(features)
    spark = df.sparkSession
    scored = score(df)
    conditions, texts = quartile_rule(df, features, row)
    predicted, same_quartile = prediction_quartile(scored, features, score, row)
    flags = scored.select(
        *[c.alias(f"_f{i}") for i, c in enumerate(conditions)],
        same_quartile.alias("_hit"),
    )
    kept: list[tuple[int, ...]] = [()]
    chosen, chosen_stats = (), (0.0, 0.0)
    for _ in features:
        candidates = sorted({tuple(sorted({*rule, i})) for rule in kept for i in range(len(features)) if i not in rule})
        sums = [F.count(F.lit(1))]
        for rule in candidates:
            holds = F.lit(True)
            for i in rule:
                holds = holds & F.col(f"_f{i}")
            sums += [F.sum(holds.cast("long")), F.sum((holds & F.col("_hit")).cast("long"))]
        total, *counts = flags.agg(*sums).first()
        stats = {}
        for k, rule in enumerate(candidates):
            covered, hits = counts[2 * k], counts[2 * k + 1]
            stats[rule] = (hits / covered if covered else 0.0, covered / total if total else 0.0)
        good = [r for r in candidates if stats[r][0] >= threshold]
        if good:
            chosen = max(good, key=lambda r: (stats[r][1], stats[r][0]))
            chosen_stats = stats[chosen]
            break
        kept = sorted(candidates, key=lambda r: stats[r], reverse=True)[:beam]
        chosen, chosen_stats = kept[0], stats[kept[0]]
    parts = [texts[i] for i in chosen]
    text = "IF " + " AND ".join(parts) if parts else "No anchor found"
    return spark.createDataFrame(
        [(round(predicted, 2), parts, round(chosen_stats[0], 4), round(chosen_stats[1], 4), text)],
        "prediction double, anchor array<string>, precision double, coverage double, rule_str string",
    )


def counterfactuals(df: DataFrame, features: Sequence[str], score: Score, desired: tuple[float, float] = (15.0, 30.0),
                    n: int = 3, vary: Sequence[str] | None = None, keys: Sequence[str] = ("timestamp", "zone"),
                    tries: int = 40, seed: int = 42) -> DataFrame:
    """Up to n changed copies of each row whose prediction falls into `desired`.

    `status` is "found"; a row for which no try succeeds comes out once, as
    "none" with rank 0 and null changes, so every input is in the result.

    A try changes a random subset of the allowed features to values between the
    feature's smallest and largest. Fewest changes come first, then the smallest
    change relative to the ranges.
    """
    features = list(features)
    allowed = list(vary or features)
    own = [F.col(k) for k in keys]
    typed = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features])
    ranges = typed.agg(F.struct(*[
        F.struct(F.min(f).alias("low"), F.max(f).alias("high")).alias(f) for f in allowed
    ]).alias("r")).scalar()
    tried = spread(typed, keys).withColumn("_r", ranges).withColumns({f"_x{i}": F.col(f) for i, f in enumerate(features)})
    tried = tried.withColumn("_try", F.explode(F.sequence(F.lit(1), F.lit(tries))))
    edits = {}
    for f in allowed:
        low, high = F.col(f"_r.{f}.low"), F.col(f"_r.{f}.high")
        changed = uniform(*own, F.col("_try"), f, seed, "pick") < 0.5
        edits[f] = F.when(changed, low + (high - low) * uniform(*own, F.col("_try"), f, seed, "value")).otherwise(F.col(f))
    scored = score(tried.withColumns(edits)).where(F.col("prediction").between(*desired))
    moved = {f: F.abs(F.col(f) - F.col(f"_x{i}")) for i, f in enumerate(features)}
    n_changes = sum(((m > 1e-3).cast("long") for m in list(moved.values())[1:]), (moved[features[0]] > 1e-3).cast("long"))
    distance = F.lit(0.0)
    for f in allowed:
        width = F.col(f"_r.{f}.high") - F.col(f"_r.{f}.low")
        distance = distance + F.coalesce(F.try_divide(moved[f], width), F.lit(0.0))
    shown = [
        F.when(moved[f] > 1e-3, F.struct(
            F.lit(f).alias("k"), F.concat(F.format_string("%.2f", F.col(f"_x{i}")), F.lit(" → "), F.format_string("%.2f", F.col(f))).alias("v")
        ))
        for i, f in enumerate(features)
    ]
    found = scored.select(
        *keys, "_try", F.col("prediction").alias("cf_prediction"), n_changes.alias("n_changes"), distance.alias("distance"),
        F.map_from_entries(F.array_compact(F.array(*shown))).alias("changes"),
    )
    order = Window.partitionBy(*keys).orderBy("n_changes", "distance", "_try")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)
    found = ranked.select(
        *keys, "rank", F.round("cf_prediction", 1).alias("cf_prediction"), "n_changes", "changes", F.lit("found").alias("status"))
    missed = df.select(*keys).join(found.where("rank = 1").select(*keys), list(keys), "left_anti").select(
        *keys, F.lit(0).cast("long").alias("rank"), F.lit(None).cast("double").alias("cf_prediction"), F.lit(None).cast("long").alias("n_changes"),
        F.lit(None).cast("map<string,string>").alias("changes"), F.lit("none").alias("status"))
    return found.unionByName(missed)
