"""Exact cosine near-duplicates of vectors by tiled comparison in principal-component order.

Vectors link when their cosine is `LEAST` or more. The result is each vector's
number of links and its component.

1. Equal vectors are one vector with a number of copies; copies link with each
   other and with all that one of them links with.
2. The second moments of all unit vectors give principal components (driver: a
   d x d matrix for vectors of length d). Turned into them, a vector has most of
   its length in its leading dimensions.
3. Vectors are sorted by the leading dimensions and cut into tiles of `TILE`.
   Two tiles are compared unless their boxes in the leading dimensions are
   farther apart than linked unit vectors can be (an equality join on slots of
   the first dimension finds the pairs, so far ones are never formed).
4. Inside a pair of tiles, products of the first `LEADING` dimensions come first.
   What the rest can add is at most the product of the suffix norms
   (Cauchy-Schwarz); a pair of vectors is given up once the sum cannot reach
   `LEAST`, the others go on by `STEP` dimensions. The few at the threshold are
   decided by the product of the vectors as they are.
5. Of a pair of tiles only the number of links per vector and a spanning forest
   of the links leave the task, so a large group of near copies emits no pairs.

All vectors are compared with all others that the bounds leave: time grows with
the square of the number of distinct vectors, with a small factor; memory and
rows do not.

Vectors that are null, empty, zero or hold a null or non-finite component link
with nothing. Vectors of different lengths do not link. Rows with a null or
repeated vec_id are vectors of their own; a component's id is its smallest
vec_id (null if none has one), and a row is kept if its id equals that (null ids
alike). Other columns, labels included, are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.llm.links import components
from zonecast.llm.positions import numbered
from zonecast.session import checkpointed

LEAST = 0.95
TILE = 4096
BLOCK = 1024
LEADING = 16
STEP = 16
#: Dimensions that a tile's box has, and parts that the first two sort dimensions are cut into.
BOX = 8
PARTS = 8
#: What sums of rounded products may be off by; pairs this near the threshold are computed again.
SLACK = 1e-9


def unit(values: np.ndarray) -> np.ndarray | None:
    """The vector at length 1, or null if it has no direction; scaled first, so no square overflows."""
    largest = np.abs(values).max(initial=0.0)
    if not np.isfinite(largest) or largest == 0:
        return None
    scaled = values / largest
    return scaled / np.sqrt(scaled @ scaled)


def read_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, digest, vector) of each row; digest and vector (8-byte floats) are null where there is no direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, vectors = [], []
            for values in batch.column(1).to_pylist():
                bad = values is None or any(v is None for v in values)
                # Adding 0 makes a negative zero a positive one.
                array = None if bad else np.array(values, dtype=np.float64) + 0.0
                if array is None or unit(array) is None:
                    digests.append(None)
                    vectors.append(None)
                else:
                    vectors.append(array.tobytes())
                    digests.append(sha256(vectors[-1]).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], names=["vec_id", "digest", "vector"])

    return rows.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id bigint, digest binary, vector binary")


def unpacked(vectors: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as rows padded with 0 to `width`: as they are, at length 1, and their lengths in dimensions."""
    raw = np.zeros((len(vectors), width))
    sizes = np.array([len(v) // 8 for v in vectors])
    for row, v in zip(raw, vectors):
        row[:len(v) // 8] = np.frombuffer(v)
    scaled = raw / np.abs(raw).max(axis=1, initial=0.0, keepdims=True) if len(raw) else raw
    return raw, scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True)), sizes


def rotation(kept: DataFrame, width: int) -> np.ndarray:
    """The principal components of all unit vectors as columns, largest first."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            whole = unpacked(batch.column(0).to_pylist(), width)[1]
            total += whole.T @ whole
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": rows["i"].iloc[:1], "row": [np.sum(rows["row"].tolist(), axis=0)]})

    schema = "i int, row array<double>"
    rows = kept.select("vector").mapInArrow(moments, schema).groupBy("i").applyInPandas(summed, schema).collect()
    matrix = np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])])
    return np.ascontiguousarray(np.linalg.eigh((matrix + matrix.T) / 2)[1][:, ::-1])


def placed(spark: SparkSession, kept: DataFrame, turn: np.ndarray) -> DataFrame:
    """Distinct vectors numbered in the order of their leading dimensions: parts of the first and second, then the third."""
    width = len(turn)

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            whole = unpacked(vectors, width)[1] @ turn[:, :3]
            whole = np.pad(whole, ((0, 0), (0, 3 - whole.shape[1])))
            dims = pa.array([len(v) // 8 for v in vectors], pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("digest", "vector", "copies")], dims, *[pa.array(whole[:, k].copy()) for k in range(3)]],
                                             names=["digest", "vector", "copies", "dims", "y0", "y1", "y2"])

    rows = checkpointed(spark, kept.select("digest", "vector", "copies").mapInArrow(lead, "digest binary, vector binary, copies bigint, dims int, y0 double, y1 double, y2 double"))
    shares = ", ".join(repr(i / PARTS) for i in range(1, PARTS))
    cuts = rows.agg(*[F.expr(f"percentile_approx(y{k}, array({shares}))").alias(f"c{k}") for k in (0, 1)]).first()

    def part(name: str, points: list[float]) -> F.Column:
        return sum((F.col(name) > float(c)).cast("int") for c in points[1:]) + (F.col(name) > float(points[0])).cast("int")

    cut = rows.select("digest", "vector", "copies", "dims", part("y0", cuts["c0"]).alias("p0"), part("y1", cuts["c1"]).alias("p1"), "y2")
    return numbered(spark, checkpointed(spark, cut), ["dims", "p0", "p1", "y2", "digest"]).select("pos", "digest", "vector", "copies")


_TILE = "tile bigint, first bigint, low array<double>, high array<double>, copies array<bigint>, vectors array<binary>"


def tiles(rows: DataFrame, turn: np.ndarray) -> DataFrame:
    """`TILE` vectors in a row, with their box in the leading dimensions."""
    width = len(turn)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        lead = unpacked(rows["vector"].tolist(), width)[1] @ turn[:, :BOX]
        first = int(rows["pos"].iloc[0])
        return pd.DataFrame({"tile": [first // TILE], "first": [first], "low": [lead.min(axis=0)], "high": [lead.max(axis=0)],
                             "copies": [rows["copies"].to_numpy()], "vectors": [rows["vector"].tolist()]})

    return rows.select(F.floor(F.col("pos") / TILE).alias("tile"), "pos", "copies", "vector").groupBy("tile").applyInPandas(pack, _TILE)


def tile_pairs(packed: DataFrame, least: float) -> DataFrame:
    """(a, b) with a <= b of tiles whose boxes are near enough for a link."""
    reach = float(np.sqrt(2 - 2 * least)) + SLACK
    boxes = packed.select("tile", "low", "high")

    def slot(value: F.Column) -> F.Column:
        return F.floor(value / reach)

    own = boxes.select(F.explode(F.sequence(slot(F.get("low", F.lit(0))), slot(F.get("high", F.lit(0))))).alias("slot"), F.struct("tile", "low", "high").alias("x"))
    near = boxes.select(F.explode(F.sequence(slot(F.get("low", F.lit(0)) - reach), slot(F.get("high", F.lit(0)) + reach))).alias("slot"), F.struct("tile", "low", "high").alias("y"))
    gap = "aggregate(zip_with(zip_with(x.low, y.high, (l, h) -> l - h), zip_with(y.low, x.high, (l, h) -> l - h), (u, v) -> greatest(u, v, 0D)), 0D, (t, g) -> t + g * g)"
    met = own.join(near, "slot").where("x.tile <= y.tile").where(F.expr(gap) <= reach * reach)
    return met.groupBy(F.col("x.tile").alias("a"), F.col("y.tile").alias("b")).agg(F.count(F.lit(1)).alias("_n")).drop("_n")


def linked(x: dict[str, np.ndarray], y: dict[str, np.ndarray], least: float) -> np.ndarray:
    """Which vectors of two blocks link, as a matrix of booleans.

    Blocks hold turned unit vectors `turned`, norms of what follows each step
    `rest` (by step), the vectors as they are `raw`, and `dims`.
    """
    width = x["turned"].shape[1]
    same = x["dims"][:, None] == y["dims"][None, :]
    done = min(LEADING, width)
    sums = x["turned"][:, :done] @ y["turned"][:, :done].T
    step = 0
    alive = (sums + x["rest"][step][:, None] * y["rest"][step][None, :] >= least - SLACK) & same
    while done < width:
        more = min(done + STEP, width)
        step += 1
        if alive.sum() * 8 > alive.size:
            sums += x["turned"][:, done:more] @ y["turned"][:, done:more].T
            alive &= sums + x["rest"][step][:, None] * y["rest"][step][None, :] >= least - SLACK
        else:
            i, j = np.nonzero(alive)
            if not len(i):
                return alive
            sums[i, j] += np.einsum("ij,ij->i", x["turned"][i, done:more], y["turned"][j, done:more])
            alive[i, j] = sums[i, j] + x["rest"][step][i] * y["rest"][step][j] >= least - SLACK
        done = more
    i, j = np.nonzero(alive & (np.abs(sums - least) <= SLACK))
    for a, b in zip(i, j):
        alive[a, b] = cosine(x["raw"][a], y["raw"][b]) >= least
    return alive


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """By the definition, on vectors scaled so that no square overflows."""
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return float(x @ y / np.sqrt((x @ x) * (y @ y)))


def forest(found: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges (row, column) of a spanning forest of the links in a matrix; every row and column is visited once."""
    rows_left, columns_left = found.any(axis=1), found.any(axis=0)
    while rows_left.any():
        rows = np.flatnonzero(rows_left)[:1]
        rows_left[rows] = False
        while len(rows):
            reached = np.flatnonzero(found[rows].any(axis=0) & columns_left)
            if not len(reached):
                break
            yield from zip(rows[found[np.ix_(rows, reached)].argmax(axis=0)], reached)
            columns_left[reached] = False
            following = np.flatnonzero(found[:, reached].any(axis=1) & rows_left)
            if len(following):
                yield from zip(following, reached[found[np.ix_(following, reached)].argmax(axis=1)])
                rows_left[following] = False
            rows = following


_FOUND = "pos bigint, n bigint, other bigint"


def compare_tiles(pairs: DataFrame, packed: DataFrame, turn: np.ndarray, least: float) -> DataFrame:
    """Per pair of tiles: (pos, n) links found of a vector, copies of the others counted, and (pos, other) edges of a forest."""
    width = len(turn)

    def block(row: pd.Series, start: int) -> dict[str, np.ndarray]:
        raw, whole, dims = unpacked(list(row["vectors"][start:start + BLOCK]), width)
        turned = whole @ turn
        ends = [*range(min(LEADING, width), width, STEP), width]
        rest = [np.sqrt((turned[:, e:] ** 2).sum(axis=1)) for e in ends]
        return {"turned": turned, "rest": rest, "raw": raw, "dims": dims, "copies": np.asarray(row["copies"][start:start + BLOCK]),
                "pos": row["first"] + start + np.arange(len(raw))}

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        sides = [row for _, row in rows.sort_values("tile").iterrows()]
        a, b = sides[0], sides[-1]
        right = [block(b, s) for s in range(0, len(b["vectors"]), BLOCK)]
        left = right if a["tile"] == b["tile"] else [block(a, s) for s in range(0, len(a["vectors"]), BLOCK)]
        counts: dict[str, list] = {"pos": [], "n": []}
        edges: list[tuple[int, int]] = []
        for i, x in enumerate(left):
            for y in right[i:] if left is right else right:
                found = linked(x, y, least)
                if x is y:
                    np.fill_diagonal(found, False)
                if not found.any():
                    continue
                for one, n in [(x, found @ y["copies"])] + ([] if x is y else [(y, x["copies"] @ found)]):
                    some = np.flatnonzero(n)
                    counts["pos"].append(one["pos"][some])
                    counts["n"].append(n[some])
                edges += [(int(x["pos"][u]), int(y["pos"][v])) for u, v in forest(found)]
        parts = [pd.DataFrame({"pos": p, "n": n}) for p, n in zip(counts["pos"], counts["n"])]
        out = pd.concat(parts).groupby("pos", as_index=False)["n"].sum() if parts else pd.DataFrame({"pos": [], "n": []})
        out = pd.concat([out.assign(other=None), pd.DataFrame({"pos": [e[0] for e in edges], "n": None, "other": [e[1] for e in edges]})])
        return out.astype("Int64")

    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"))
    return sides.join(packed, "tile").groupBy("a", "b").applyInPandas(compare, _FOUND)


def near_duplicates(spark: SparkSession, rows: DataFrame, least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of `rows` (vec_id, embedding)."""
    read = checkpointed(spark, read_vectors(rows))
    kept = read.where("digest IS NOT NULL").groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least_id"), F.first("vector").alias("vector"))
    kept = checkpointed(spark, kept)
    width = (kept.agg(F.max(F.length("vector"))).first()[0] or 0) // 8
    if width:
        turn = rotation(kept, width)
        places = checkpointed(spark, placed(spark, kept, turn))
        packed = checkpointed(spark, tiles(places, turn))
        found = checkpointed(spark, compare_tiles(checkpointed(spark, tile_pairs(packed, least)), packed, turn, least))
    else:
        places = spark.createDataFrame([], "pos bigint, digest binary")
        found = spark.createDataFrame([], _FOUND)
    counts = found.where("other IS NULL").groupBy("pos").agg(F.sum("n").alias("n"))
    groups = components(spark, found.where("other IS NOT NULL").select(F.col("pos").alias("a"), F.col("other").alias("b")))
    known = places.select("pos", "digest").join(kept.select("digest", "copies", "least_id"), "digest").join(counts, "pos", "left")
    known = checkpointed(spark, known.join(groups.select(F.col("node").alias("pos"), "component"), "pos", "left").withColumn("component", F.coalesce("component", "pos")))
    smallest = known.groupBy("component").agg(F.min("least_id").alias("component_id"))
    known = known.join(smallest, "component").select("digest", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("_known"))
    out = read.select("vec_id", "digest").join(known, "digest", "left")
    component = F.when(F.col("_known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


SQL = f"""WITH RECURSIVE good AS (SELECT row_number() OVER () AS id, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
 WHERE len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
pairs AS (SELECT a.id AS a, b.id AS b FROM good a JOIN good b ON a.id < b.id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {LEAST}),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT id, id AS to_id FROM good UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.to_id),
comp AS (SELECT r.id, min(g.vec_id) AS component_id FROM reach r JOIN good g ON g.id = r.to_id GROUP BY r.id),
found AS (SELECT g.id, g.vec_id, (SELECT count(*) FROM links l WHERE l.a = g.id) AS n_links, component_id FROM good g JOIN comp USING (id))
SELECT vec_id, n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM found
UNION ALL SELECT vec_id, 0, vec_id, true FROM embeddings
WHERE embedding IS NULL OR len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) > 0 OR len(list_filter(embedding, lambda v: v <> 0)) = 0"""
