"""A Merkle manifest of a dataset, with proofs expanded from one multiproof per leaf partition.

Each document is a leaf; leaves of a language form a tree, the trees' roots form
the top tree. A node is the SHA-256 of the hex digests of its one or two
children; a lone leaf is its own root.

1. Leaves are numbered inside their language and cut into partitions of
   `2 ** LEVELS` neighbours (a hot language is many of them). Each partition
   makes its nodes up to its own top; the tops are cut into partitions in the
   same way, until one node is left. So a tree over n leaves takes
   log(n) / LEVELS rounds, not log(n).
2. For the proofs each partition computes the octopus set of its wanted leaves:
   walking up all paths at once, a node is missing if it is the sibling of a
   known or derived one and neither itself. These coordinates are fetched once
   per partition by a join, whatever number of proofs shares them.
3. Nodes between leaves and fetched siblings are derived in the partition, once
   for all its proofs; each proof is then read from these nodes.

Nulls count as `-` in a leaf. Null languages are the first tree; documents with
a null id come first in their language and are never tampered with. Rows of one
id are ordered by their leaves; equal rows are separate leaves with proofs of
their own. Empty texts are values of 0 bytes; texts of any length are hashed
where they are read. Columns other than the five are not read. An empty table
has no leaves, no root and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.llm.base import per_batch
from zonecast.llm.positions import numbered
from zonecast.session import checkpointed

LEVELS = 12
#: The tree over the roots of the languages; languages count from 0.
TOP = -1
TAMPERED_SHARE = 7


def joined_hash(parts: Sequence[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def value_part(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(n_chars: Column) -> Column:
    return F.sha2(F.concat(*[value_part(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))]), 256)


def sizes_of(n: int) -> list[int]:
    """Nodes per level of a tree over `n` leaves."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append((sizes[-1] + 1) // 2)
    return sizes


def parents(level: list[str], first: int, size: int) -> list[str]:
    """Nodes above neighbours that start at the even index `first` of a level of `size` nodes."""
    return [joined_hash(level[i:i + 2]) for i in range(0, len(level), 2)] if size > 1 else []


def missing(indexes: Sequence[int], n: int) -> list[tuple[int, int]]:
    """(level, index) of the fewest nodes that the leaves at `indexes` need from outside for all their paths."""
    found: list[tuple[int, int]] = []
    known = sorted(set(indexes))
    for level, size in enumerate(sizes_of(n)[:-1]):
        own = set(known)
        found += [(level, i ^ 1) for i in known if i ^ 1 < size and i ^ 1 not in own]
        known = sorted({i >> 1 for i in known})
    return found


def derived(leaves: dict[int, str], fetched: dict[tuple[int, int], str], n: int) -> list[dict[int, str]]:
    """All nodes by level that follow from the leaves and the fetched ones."""
    levels = [dict(leaves)]
    for level, size in enumerate(sizes_of(n)[:-1]):
        here = levels[-1]
        here.update({i: h for (at, i), h in fetched.items() if at == level})
        pairs = {i >> 1 for i in here}
        levels.append({
            p: joined_hash([here[i] for i in (2 * p, 2 * p + 1) if i < size]) for p in pairs
            if all(i in here for i in (2 * p, 2 * p + 1) if i < size)
        })
    return levels


def path(levels: list[dict[int, str]], index: int, n: int) -> list[tuple[bool, str | None]]:
    """For each level up to the root: whether the node is a left one, and its sibling if it has one."""
    steps = []
    for level, size in enumerate(sizes_of(n)[:-1]):
        sibling = index ^ 1
        steps.append((index % 2 == 0, levels[level][sibling] if sibling < size else None))
        index >>= 1
    return steps


def folded(leaf: str, steps: Sequence[tuple[bool, str | None]]) -> str:
    for left, sibling in steps:
        leaf = joined_hash([leaf] if sibling is None else [leaf, sibling] if left else [sibling, leaf])
    return leaf


@dataclass
class Manifest:
    """packs: one row per leaf partition (tree, n, block, trees, entries); nodes: (tree, level, idx, hash) above the leaves; tops: (tree, lang, n, subroot)."""

    packs: DataFrame
    nodes: DataFrame
    tops: DataFrame


def blocks(rows: DataFrame, kept: Sequence[str]) -> DataFrame:
    """Rows (tree, n, pos, hash, ...) as one row per tree and `2 ** LEVELS` neighbours."""
    entry = F.struct("pos", *kept)
    return rows.groupBy("tree", "n", F.shiftright("pos", LEVELS).alias("block")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def risen(packs: DataFrame, base: int) -> DataFrame:
    """Nodes of levels base + 1 to base + LEVELS from partitions of nodes of level `base`."""

    def fn(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"tree": [], "level": [], "idx": [], "hash": []}
        for tree, n, block, entries in zip(*(columns[c] for c in ("tree", "n", "block", "entries"))):
            sizes, level = sizes_of(n), [e["hash"] for e in entries]
            for k in range(base, min(base + LEVELS, len(sizes) - 1)):
                level = parents(level, 0, sizes[k])
                first = block << (LEVELS - 1 - (k - base))
                out["tree"] += [tree] * len(level)
                out["level"] += [k + 1] * len(level)
                out["idx"] += range(first, first + len(level))
                out["hash"] += level
        return out

    return per_batch(packs.select("tree", "n", "block", "entries"), fn, "tree bigint, level int, idx bigint, hash string")


def grown(spark: SparkSession, packs: DataFrame) -> DataFrame:
    """All nodes above the leaves, stored."""
    most = packs.agg(F.max("n")).first()[0] or 0
    counts = packs.select("tree", "n").distinct()
    done: list[DataFrame] = []
    for base in range(0, len(sizes_of(most)) - 1, LEVELS):
        done.append(checkpointed(spark, risen(packs, base)))
        tops = done[-1].where(F.col("level") == base + LEVELS).join(counts, "tree").select("tree", "n", F.col("idx").alias("pos"), "hash")
        packs = blocks(tops, ["hash"])
    nodes = spark.createDataFrame([], "tree bigint, level int, idx bigint, hash string")
    for part in done:
        nodes = nodes.union(part)
    return nodes


def build(spark: SparkSession, docs: DataFrame) -> Manifest:
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    shaken = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % TAMPERED_SHARE == 0, F.lit(False))
    leaves = checkpointed(spark, docs.select("doc_id", "lang", leaf_of(F.col("n_chars")).alias("hash"), F.when(shaken, leaf_of(more)).alias("tampered")))
    langs = checkpointed(spark, leaves.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    trees = checkpointed(spark, numbered(spark, langs, ["lang"], name="tree").select("tree", F.col("lang").alias("_lang"), "n"))
    held = leaves.join(trees, F.col("lang").eqNullSafe(F.col("_lang"))).select("tree", "n", "doc_id", "hash", "tampered")
    rows = numbered(spark, checkpointed(spark, held), ["doc_id", "hash"], "tree")
    n_trees = trees.count()
    packs = checkpointed(spark, blocks(rows, ["doc_id", "hash", "tampered"]).withColumn("trees", F.lit(n_trees).cast("long")))
    nodes = grown(spark, packs)
    single = packs.where("n = 1").select("tree", F.get("entries", F.lit(0))["hash"].alias("hash"))
    height = trees.select("tree", "_lang", "n", F.ceil(F.log2(F.col("n").cast("double"))).cast("int").alias("level"))
    roots = nodes.where("idx = 0").join(height, ["tree", "level"]).select("tree", "hash").union(single)
    tops = checkpointed(spark, trees.join(roots, "tree").select("tree", F.col("_lang").alias("lang"), "n", F.col("hash").alias("subroot")))
    above = blocks(tops.select(F.lit(TOP).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), F.col("tree").alias("pos"), F.col("subroot").alias("hash")), ["hash"])
    return Manifest(packs, nodes.union(grown(spark, above)), tops)


PROOF = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, siblings array<string>"


def proofs(spark: SparkSession, manifest: Manifest, wanted: Column | str | None = None) -> DataFrame:
    """The proof of each leaf, or of those whose `doc_id` meets the condition `wanted`.

    `folded_root` is what the tampered leaf, where there is one, and the siblings
    give; `siblings` go from the leaf to the root.
    """
    packs = manifest.packs
    if wanted is not None:
        marks = packs.select("tree", "n", "block", "trees", F.explode("entries").alias("e")).select("*", F.col("e.doc_id").alias("doc_id")).where(wanted)
        packs = checkpointed(spark, marks.groupBy("tree", "n", "block", "trees").agg(F.array_sort(F.collect_list("e")).alias("entries")))

    def coordinates(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"tree": [], "block": [], "of": [], "level": [], "idx": []}
        for tree, n, block, trees, entries in zip(*(columns[c] for c in ("tree", "n", "block", "trees", "entries"))):
            needs = [(tree, *c) for c in missing([e["pos"] for e in entries], n)] + [(TOP, *c) for c in missing([tree], trees)]
            for of, level, idx in needs:
                for name, value in zip(out, (tree, block, of, level, idx)):
                    out[name].append(value)
        return out

    needed = per_batch(packs.select("tree", "n", "block", "trees", F.transform("entries", lambda e: F.struct(e["pos"].alias("pos"))).alias("entries")),
                       coordinates, "tree bigint, block bigint, of bigint, level int, idx bigint")
    leaves = manifest.packs.select(F.col("tree").alias("of"), F.lit(0).alias("level"), F.explode("entries").alias("e")).select("of", "level", F.col("e.pos").alias("idx"), F.col("e.hash").alias("hash"))
    tops = manifest.tops.select(F.lit(TOP).cast("long").alias("of"), F.lit(0).alias("level"), F.col("tree").alias("idx"), F.col("subroot").alias("hash"))
    nodes = manifest.nodes.withColumnRenamed("tree", "of").unionByName(leaves).unionByName(tops)
    fetched = needed.join(nodes, ["of", "level", "idx"]).groupBy("tree", "block").agg(F.collect_list(F.struct("of", "level", "idx", "hash")).alias("fetched"))
    full = packs.join(fetched, ["tree", "block"], "left").join(manifest.tops.select("tree", "subroot"), "tree")

    def expand(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c.split()[0]: [] for c in PROOF.split(", ")}
        names = ("tree", "n", "trees", "entries", "fetched", "subroot")
        for tree, n, trees, entries, got, subroot in zip(*(columns[c] for c in names)):
            for row in _expanded(tree, n, trees, entries, got or [], subroot):
                for name, value in zip(out, row):
                    out[name].append(value)
        return out

    return per_batch(full.select("tree", "n", "trees", "entries", "fetched", "subroot"), expand, PROOF)


def _expanded(tree: int, n: int, trees: int, entries: list[dict], fetched: list[dict], subroot: str) -> Iterator[tuple]:
    inside = {(f["level"], f["idx"]): f["hash"] for f in fetched if f["of"] == tree}
    above = {(f["level"], f["idx"]): f["hash"] for f in fetched if f["of"] == TOP}
    levels = derived({e["pos"]: e["hash"] for e in entries}, inside, n)
    top = derived({tree: subroot}, above, trees)
    ending, root = path(top, tree, trees), top[-1][0]
    for e in entries:
        steps = path(levels, e["pos"], n) + ending
        siblings = [s for _, s in steps if s is not None]
        got = folded(e["tampered"] or e["hash"], steps)
        yield e["doc_id"], e["hash"], subroot, root, joined_hash(siblings), got, got == root, siblings


def audit(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Every document with its leaf, roots, proof digest and what a check of its (perhaps tampered) leaf finds."""
    return proofs(spark, build(spark, docs)).drop("siblings")


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: ascii(substr(CAST(doc_id AS VARCHAR), i, 1))::BIGINT)),
 lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, 3988292384::BIGINT * (a & 1)))), 4294967295::BIGINT)"""


def _leaf_sql(n_chars: str) -> str:
    values = ("CAST(doc_id AS VARCHAR)", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values) + ")"


def _grow_sql(name: str, leaves: str) -> str:
    return f"""{name} AS (SELECT tree, n, 0 AS level, pos, hash, n AS size FROM {leaves}
 UNION ALL SELECT tree, n, level + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), (size + 1) // 2 FROM {name} WHERE size > 1 GROUP BY tree, n, level, size, pos // 2)"""


SQL = f"""WITH RECURSIVE leaf AS (SELECT doc_id, lang, {_leaf_sql('CAST(n_chars AS VARCHAR)')} AS hash,
 CASE WHEN {_CRC} % 7 = 0 THEN {_leaf_sql('CAST(CAST(n_chars AS HUGEINT) + 1 AS VARCHAR)')} END AS tampered FROM documents),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) AS n FROM leaf GROUP BY lang),
held AS (SELECT tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, hash) - 1 AS pos, doc_id, hash, tampered FROM leaf JOIN langs ON leaf.lang IS NOT DISTINCT FROM langs.lang),
{_grow_sql('inner_nodes', 'held')},
subroots AS (SELECT tree, hash AS subroot FROM inner_nodes WHERE size = 1),
top_leaves AS (SELECT -1 AS tree, (SELECT count(*) FROM langs) AS n, tree AS pos, subroot AS hash FROM subroots),
{_grow_sql('top_nodes', 'top_leaves')},
nodes AS (SELECT * FROM inner_nodes UNION ALL SELECT * FROM top_nodes),
walk AS (SELECT tree AS own, pos AS leaf_pos, doc_id, hash AS leaf, tree, 0 AS step, 0 AS level, n AS size, pos, coalesce(tampered, hash) AS got, CAST(NULL AS VARCHAR) AS sibling FROM held
 UNION ALL SELECT own, leaf_pos, doc_id, leaf, w.tree, step + 1, w.level + 1, (w.size + 1) // 2, w.pos // 2,
  CASE WHEN s.hash IS NULL THEN sha256(got) WHEN w.pos % 2 = 0 THEN sha256(got || s.hash) ELSE sha256(s.hash || got) END, s.hash
  FROM (SELECT own, leaf_pos, doc_id, leaf, step, got, CASE WHEN size = 1 THEN -1 ELSE tree END AS tree, CASE WHEN size = 1 THEN 0 ELSE level END AS level,
   CASE WHEN size = 1 THEN own ELSE pos END AS pos, CASE WHEN size = 1 THEN (SELECT count(*) FROM langs) ELSE size END AS size FROM walk WHERE size > 1 OR (tree >= 0 AND (SELECT count(*) FROM langs) > 1)) w
  LEFT JOIN nodes s ON s.tree = w.tree AND s.level = w.level AND s.pos = xor(w.pos, 1)),
proof AS (SELECT own, leaf_pos, any_value(doc_id) AS doc_id, any_value(leaf) AS leaf, sha256(coalesce(string_agg(sibling, '' ORDER BY step), '')) AS proof_sha256, arg_max(got, step) AS folded_root FROM walk GROUP BY own, leaf_pos)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM proof JOIN subroots ON subroots.tree = own, (SELECT hash AS root FROM top_nodes WHERE size = 1) r"""
