"""Anchors by perturbation: which conditions alone keep a prediction in its quartile.

A draw keeps the bin of the features a rule names (a value of another row in that
bin takes their place) and takes all other features from a row of the data. A
rule's precision is the share of draws that stay in the prediction's quartile.

Rules are searched by beam. Each level draws one batch for every candidate and
then only for those still open: the ones whose confidence bounds do not yet tell
whether they belong to the best. A round is one aggregate over all open
candidates; two counts per candidate reach the driver. Bounds are the
Kullback-Leibler ones for shares; a share of `delta` is dealt over all
candidates and rounds of a level.

Donors are a hash sample of the data of about `DONORS` rows, whatever its size:
draws are a sample by nature. Coverage is counted over all rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.operators.explain import Score, prediction_quartile, quartile_rule, spread, uniform
from zonecast.session import checkpointed

#: Rows of the data that values are drawn from.
DONORS = 4000
#: Draws of a candidate in a round: a quarter of the donors.
SLICES = 4

Rule = tuple[int, ...]


def divergence(p: float, q: float) -> float:
    """Kullback-Leibler divergence of two shares."""
    q = min(max(q, 1e-12), 1 - 1e-12)
    return (p * log(p / q) if p > 0 else 0.0) + ((1 - p) * log((1 - p) / (1 - q)) if p < 1 else 0.0)


def bounds(hits: int, n: int, level: float) -> tuple[float, float]:
    """The shares whose divergence from hits / n is at most level / n."""
    if not n:
        return 0.0, 1.0
    p, ends = hits / n, []
    for far in (0.0, 1.0):
        near, out = p, far
        for _ in range(40):
            middle = (near + out) / 2
            near, out = (middle, out) if divergence(p, middle) * n <= level else (near, middle)
        ends.append(near)
    return ends[0], ends[1]


class Sampler:
    """Draws of rules: `draw` adds one batch for each of the given rules to `n` and `hits`."""

    def __init__(self, df: DataFrame, features: Sequence[str], score: Score, row: dict[str, float], keys: Sequence[str], seed: int):
        self.features, self.score, self.seed = list(features), score, seed
        self.spark = df.sparkSession
        typed = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in self.features])
        self.conditions, self.texts = quartile_rule(typed, self.features, row)
        self.predicted, self.hit = prediction_quartile(score(typed), self.features, score, row)
        self.rows = typed.count()
        drawn = uniform(*[F.col(k) for k in keys], F.lit("donor"), seed) < min(1.0, DONORS / max(self.rows, 1))
        named = typed.where(drawn).select(F.xxhash64(*keys, F.lit(seed)).alias("_key"), *self.features)
        self.donors = spread(checkpointed(self.spark, named), ["_key"])
        # Per feature the donors' values in the row's bin, and the row's own: there is always one.
        self.pools = checkpointed(self.spark, self.donors.agg(*[
            F.concat(F.sort_array(F.collect_list(F.when(c, F.col(f)))), F.array(F.lit(float(row[f])))).alias(f)
            for c, f in zip(self.conditions, self.features)
        ]))
        self.flags = typed.select(*[F.coalesce(c, F.lit(False)).alias(f"_f{i}") for i, c in enumerate(self.conditions)])
        self.n: dict[Rule, int] = {}
        self.hits: dict[Rule, int] = {}
        self.turn = 0

    def draw(self, rules: Sequence[Rule]) -> None:
        self.turn += 1
        numbered = F.array(*[
            F.struct(F.lit(i).alias("rule"), *[F.lit(j in rule).alias(f"_p{j}") for j in range(len(self.features))])
            for i, rule in enumerate(rules)
        ])
        part = self.donors.where(F.pmod(F.xxhash64("_key", F.lit("slice")), F.lit(SLICES)) == self.turn % SLICES)
        many = part.withColumn("_c", F.explode(numbered)).select("_key", "_c.*", *self.features)
        edits = {}
        for j, f in enumerate(self.features):
            pool = self.pools.select(f).scalar()
            place = F.floor(uniform(F.col("_key"), F.col("rule"), f, self.seed, self.turn) * F.size(pool)).cast("int")
            edits[f] = F.when(F.col(f"_p{j}"), F.get(pool, place)).otherwise(F.col(f))
        scored = self.score(many.withColumns(edits))
        for r in scored.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.sum(self.hit.cast("long")).alias("hits")).collect():
            rule = rules[r["rule"]]
            self.n[rule] = self.n.get(rule, 0) + r["n"]
            self.hits[rule] = self.hits.get(rule, 0) + (r["hits"] or 0)

    def precision(self, rule: Rule) -> float:
        return self.hits.get(rule, 0) / self.n[rule] if self.n.get(rule) else 0.0

    def bounds(self, rule: Rule, delta: float, candidates: int, turn: int) -> tuple[float, float]:
        # 1 / (t (t + 1)) sums to one over all rounds; two sides of each candidate.
        return bounds(self.hits.get(rule, 0), self.n.get(rule, 0), log(2 * candidates * turn * (turn + 1) / delta))

    def coverage(self, rules: Sequence[Rule]) -> dict[Rule, float]:
        """Share of all rows under each rule, all counted in one pass."""
        sums = []
        for rule in rules:
            holds = F.lit(True)
            for i in rule:
                holds = holds & F.col(f"_f{i}")
            sums.append(F.sum(holds.cast("long")))
        counts = self.flags.agg(*sums).first()
        return {rule: (c or 0) / self.rows if self.rows else 0.0 for rule, c in zip(rules, counts)}


def best_candidates(sampler: Sampler, rules: Sequence[Rule], beam: int, threshold: float, delta: float, tolerance: float,
                    rounds: int) -> tuple[list[Rule], list[Rule]]:
    """The `beam` most precise rules, and those of them whose precision is shown to reach `threshold`."""
    sampler.draw(rules)
    turn = 1
    while True:
        interval = {r: sampler.bounds(r, delta, len(rules), turn) for r in rules}
        ranked = sorted(rules, key=lambda r: (-sampler.precision(r), r))
        top, rest = ranked[:beam], ranked[beam:]
        weakest = min(interval[r][0] for r in top)
        strongest = max((interval[r][1] for r in rest), default=0.0)
        still = []
        if strongest - weakest > tolerance:
            still += [r for r in top if interval[r][0] < strongest - tolerance] + [r for r in rest if interval[r][1] > weakest + tolerance]
        for r in top:
            low, high = interval[r]
            reached = sampler.precision(r) >= threshold
            if r not in still and (low < threshold - tolerance if reached else high >= threshold + tolerance):
                still.append(r)
        if not still or turn >= rounds:
            shown = [r for r in top if sampler.precision(r) >= threshold and interval[r][0] >= threshold - tolerance]
            return top, shown
        sampler.draw(still)
        turn += 1


def anchor(df: DataFrame, features: Sequence[str], score: Score, row: dict[str, float], threshold: float = 0.9,
           beam: int = 4, delta: float = 0.05, tolerance: float = 0.05, rounds: int = 12,
           keys: Sequence[str] = ("timestamp", "zone"), seed: int = 42) -> DataFrame:
    """The shortest rule on quartile bins that keeps the prediction of `row` in its quartile under perturbation.

    Of the rules of the first length whose precision is at least `threshold`
    (and, with probability 1 - delta, at least threshold - tolerance) the one
    with the widest coverage wins; if no length has one, the most precise of the
    longest is returned. `rounds` bounds the batches of one level; a rule
    whose bounds are still too wide then does not count as shown. Empty data
    give a rule with a precision and coverage of 0.
    """
    sampler = Sampler(df, features, score, row, keys, seed)
    kept: list[Rule] = [()]
    chosen: Rule = ()
    for _ in sampler.features:
        rules = sorted({tuple(sorted({*rule, i})) for rule in kept for i in range(len(sampler.features)) if i not in rule})
        kept, shown = best_candidates(sampler, rules, beam, threshold, delta, tolerance, rounds)
        chosen = kept[0]
        if shown:
            wide = sampler.coverage(shown)
            chosen = max(shown, key=lambda r: (wide[r], sampler.precision(r)))
            break
    parts = [sampler.texts[i] for i in chosen]
    text = "IF " + " AND ".join(parts) if parts else "No anchor found"
    covered = sampler.coverage([chosen])[chosen] if chosen else 0.0
    return sampler.spark.createDataFrame(
        [(round(sampler.predicted, 2), parts, round(sampler.precision(chosen), 4), round(covered, 4), text, sum(sampler.n.values()))],
        "prediction double, anchor array<string>, precision double, coverage double, rule_str string, n_draws bigint",
    )
