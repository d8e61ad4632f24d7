"""Merkle manifest of a dataset as a persistent tree that is changed by copying paths.

Every row is a leaf. The leaves of a source are ordered by doc_id and joined
three at a time into their hash until one node is left, the sources' nodes
likewise. A tree is computed in aligned blocks of ``3 ** depth`` neighbours:
block by block into block roots, and again over these, so that every task holds
one block however large a source is. Each block is a ``PersistentTree``: a
changed leaf makes a new version that copies the leaf's ancestors in the block
and shares every other node. The version goes on above its block with the nodes
beside the block's path, which a second pass hands down from the upper blocks.

Nulls and odd rows: a null value is hashed as ``-``; a null doc_id stands before
all others, and is never tampered with; rows with equal doc_id in a source stand
in the order of their leaves; null is a source of its own, before all others; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.scan import running_sum, scan
from llm.common import SQL_CRC32, crc_mod, stage

WIDTH = 3
#: Levels in a block: 3 ** 7 = 2,187 neighbours.
DEPTH = 7
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

_PATH = "array<struct<left:string,right:string>>"


def hashed(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class PersistentTree:
    """Tree over up to a block of digests; nodes are never changed, a version is the number of its root.

    A block stands for ``total`` nodes of its level, of which it holds those from ``first`` on: a level with one
    node in all is the last.
    """

    def __init__(self, digests: list[str], total: int, depth: int):
        self.hash: list[str] = []
        self.children: list[tuple[int, ...]] = []
        level = [self._node(digest, ()) for digest in digests]
        self.height = 0
        while total > 1 and self.height < depth:
            level = [self._joined(tuple(level[i : i + WIDTH])) for i in range(0, len(level), WIDTH)]
            total = -(-total // WIDTH)
            self.height += 1
        (self.root,) = level

    def _node(self, digest: str, children: tuple[int, ...]) -> int:
        self.hash.append(digest)
        self.children.append(children)
        return len(self.hash) - 1

    def _joined(self, children: tuple[int, ...]) -> int:
        return self._node(hashed(self.hash[c] for c in children), children)

    def _way(self, place: int) -> list[int]:
        """Which child to take on every level, from the root down."""
        return [place // WIDTH**level % WIDTH for level in range(self.height - 1, -1, -1)]

    def changed(self, place: int, digest: str) -> int:
        """Root of the version with another leaf at ``place``; only the leaf's ancestors are copied."""
        way, passed, node = self._way(place), [], self.root
        for child in way:
            passed.append(node)
            node = self.children[node][child]
        new = self._node(digest, ())
        for node, child in zip(reversed(passed), reversed(way)):
            children = self.children[node]
            new = self._joined((*children[:child], new, *children[child + 1 :]))
        return new

    def forget(self, size: int) -> None:
        """Drop the nodes of versions made since the tree had ``size`` nodes."""
        del self.hash[size:], self.children[size:]

    def beside(self, place: int) -> list[tuple[str, str]]:
        """Digests left and right of the path, joined, from the leaf up."""
        node, levels = self.root, []
        for child in self._way(place):
            children = self.children[node]
            digests = [self.hash[c] for c in children]
            levels.append(("".join(digests[:child]), "".join(digests[child + 1 :])))
            node = children[child]
        return levels[::-1]


def _value(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_column(**changed: Column) -> Column:
    """Leaf of a row, with other values for some of its fields."""
    return F.sha2(F.concat(*[_value(changed.get(name, F.col(name))) for name in FIELDS]), 256)


def tampered_column() -> Column:
    """Rows to be tampered with: those whose doc_id has an even crc32."""
    return F.coalesce(F.col("doc_id").isNotNull() & (crc_mod(2) == 0), F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, and the leaf after tampering where the row is tampered with."""
    rows = docs.select(*[F.col(name) for name in FIELDS])
    return rows.select(
        "doc_id", "source", leaf_column().alias("leaf"),
        F.when(tampered_column(), leaf_column(text=F.translate("text", "\n", ""))).alias("tampered"),
    )


def _blocks(nodes: DataFrame, depth: int) -> DataFrame:
    """``nodes`` (tree, place, total, digest) with their block."""
    return nodes.withColumn("block", F.expr(f"place div {WIDTH**depth}"))


def block_roots(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes of the upper tree: one per block."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        tree = PersistentTree(pdf.sort_values("place")["digest"].tolist(), int(first["total"]), depth)
        total = -(-int(first["total"]) // WIDTH**depth)
        return pd.DataFrame({"tree": [first["tree"]], "place": [first["block"]], "total": [total], "digest": [tree.hash[tree.root]]})

    return _blocks(nodes, depth).groupBy("tree", "block").applyInPandas(build, "tree long, place long, total long, digest string")


def upper_paths(nodes: DataFrame, most: int, depth: int) -> DataFrame:
    """Per node of ``nodes`` what stands beside its path, level by level, and its tree's root.

    ``most`` is the size of the largest tree; every round shortens it by the size of a block.
    """
    if most <= 1:
        return nodes.select("tree", "place", F.expr(f"CAST(array() AS {_PATH})").alias("path"), F.col("digest").alias("root"))
    above = upper_paths(stage(block_roots(nodes, depth), "block-roots"), -(-most // WIDTH**depth), depth)
    above = above.select("tree", F.col("place").alias("block"), F.col("path").alias("rest"), "root")

    def hand_down(held: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("place")
        tree = PersistentTree(held["digest"].tolist(), int(held["total"].iloc[0]), depth)
        rest, root = list(upper["rest"].iloc[0]), upper["root"].iloc[0]
        paths = [[{"left": a, "right": b} for a, b in tree.beside(i)] + rest for i in range(len(held))]
        return pd.DataFrame({"tree": held["tree"], "place": held["place"], "path": paths, "root": root})

    cogrouped = _blocks(nodes, depth).groupBy("tree", "block").cogroup(above.groupBy("tree", "block"))
    return cogrouped.applyInPandas(hand_down, f"tree long, place long, path {_PATH}, root string")


def _sizes(placed: DataFrame) -> DataFrame:
    """Sources with their number and their place among the sources."""
    sizes = placed.groupBy("source").agg(F.count(F.lit(1)).alias("total"))
    # Binary values order bytewise; an empty one and null differ in the first part.
    keyed = sizes.select("*", F.lit(0).alias("all"), F.col("source").isNotNull().cast("int").alias("named"),
                         F.coalesce(F.col("source").cast("binary"), F.lit(b"")).alias("name"))
    ranked = scan(keyed, ["all"], ["named", "name"], ranged=True, number=running_sum(F.lit(1)))
    return stage(ranked.select("source", "total", (F.col("number") - 1).alias("tree")), "sources")


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Per row: doc_id, source, leaf, subroot, root, proof_sha256, tampered_leaf, folded_root, verified."""
    spark = docs.sparkSession
    keyed = leaves(docs).select(
        "*", F.col("source").isNotNull().cast("int").alias("named"), F.coalesce("source", F.lit("")).alias("name"),
        F.col("doc_id").isNotNull().cast("int").alias("known"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("number"),
    )
    rows = scan(keyed, ["named", "name"], ["known", "number", "leaf"], ranged=True, place=running_sum(F.lit(1)))
    placed = stage(rows.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "leaf", "tampered", (F.col("place") - 1).alias("place")), "leaves")
    sources = _sizes(placed)
    bounds = sources.agg(F.max("total"), F.count(F.lit(1))).first()
    if not bounds[1]:
        return _finished(spark.createDataFrame([], _ROWS))
    numbered = placed.join(sources, placed["source"].eqNullSafe(sources["source"])).select(
        placed["*"], "tree", "total", F.col("leaf").alias("digest")
    )
    numbered = stage(_blocks(numbered, depth), "numbered-leaves")

    block_nodes = stage(block_roots(numbered.select("tree", "place", "total", "digest"), depth), "leaf-blocks")
    within = stage(upper_paths(block_nodes, -(-bounds[0] // WIDTH**depth), depth), "paths-in-sources")
    subroots = within.where("place = 0").select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(bounds[1]).cast("long").alias("total"), F.col("root").alias("digest")
    )
    across = upper_paths(stage(subroots, "subroots"), bounds[1], depth).select(F.col("place").alias("of"), F.col("path").alias("top"), F.col("root").alias("whole"))
    above = within.join(across, within["tree"] == across["of"]).select(
        "tree", F.col("place").alias("block"), F.concat("path", "top").alias("rest"), F.col("root").alias("subroot"), F.col("whole").alias("root")
    )

    def prove(held: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        """A block's rows, with the versions of its tree carried on to the root."""
        held = held.sort_values("place")
        tree = PersistentTree(held["leaf"].tolist(), int(held["total"].iloc[0]), depth)
        rest, root = [(level["left"], level["right"]) for level in upper["rest"].iloc[0]], upper["root"].iloc[0]
        above = "".join(a + b for a, b in rest)
        proofs, folded, size = [], [], len(tree.hash)
        for place, new in enumerate(held["tampered"]):
            proofs.append(hashed([*(a + b for a, b in tree.beside(place)), above]))
            digest = tree.hash[tree.root if new is None else tree.changed(place, new)]
            for left, right in rest:
                digest = hashed((left, digest, right))
            folded.append(digest)
            tree.forget(size)
        out = held[["doc_id", "source", "leaf"]].copy()
        out["subroot"], out["root"], out["proof_sha256"] = upper["subroot"].iloc[0], root, proofs
        out["tampered_leaf"], out["folded_root"] = held["tampered"], folded
        out["verified"] = out["folded_root"] == root
        return out

    return _finished(numbered.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInPandas(prove, _ROWS))


def _finished(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


# Ids are text on their way through pandas, where a null would turn them into floating-point numbers.
_ROWS = (
    "doc_id string, source string, leaf string, subroot string, root string, proof_sha256 string, tampered_leaf string, "
    "folded_root string, verified boolean"
)


def _sql_leaf(text: str = "text") -> str:
    values = [text if name == "text" else f"CAST({name} AS VARCHAR)" for name in FIELDS]
    return "sha256(" + " || ".join(f"COALESCE(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


SQL = f"""
WITH RECURSIVE
leaves AS (
  SELECT doc_id, source, {_sql_leaf()} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {SQL_CRC32.format(column="doc_id")} % 2 = 0 THEN {_sql_leaf("replace(text, chr(10), '')")} END AS tampered
  FROM documents),
sources AS (
  SELECT source, COUNT(*) AS n, ROW_NUMBER() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaves GROUP BY source),
placed AS (
  SELECT l.*, s.tree, s.n, ROW_NUMBER() OVER (PARTITION BY s.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
  FROM leaves l JOIN sources s ON l.source IS NOT DISTINCT FROM s.source),
nodes AS (
  SELECT 0 AS lvl, tree, idx, n, leaf AS digest FROM placed
  UNION ALL
  SELECT lvl + 1, tree, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY lvl, tree, idx // 3, n),
subroots AS (SELECT tree, lvl AS height, digest AS subroot FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS lvl, tree AS idx, COUNT(*) OVER () AS n, subroot AS digest FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM upper WHERE n > 1 GROUP BY lvl, idx // 3, n),
beside AS (
  SELECT a.lvl, a.tree, a.idx, COALESCE(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
    COALESCE(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM nodes a JOIN nodes b ON a.lvl = b.lvl AND a.tree = b.tree AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY a.lvl, a.tree, a.idx),
upper_beside AS (
  SELECT a.lvl, a.idx, COALESCE(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
    COALESCE(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM upper a JOIN upper b ON a.lvl = b.lvl AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY a.lvl, a.idx),
steps AS (
  SELECT p.tree, p.idx, b.lvl AS step, b.l, b.r FROM placed p JOIN beside b ON b.tree = p.tree AND b.idx = p.idx // CAST(3 ** b.lvl AS BIGINT)
  UNION ALL
  SELECT p.tree, p.idx, s.height + b.lvl, b.l, b.r FROM placed p JOIN subroots s ON s.tree = p.tree
  JOIN upper_beside b ON b.idx = p.tree // CAST(3 ** b.lvl AS BIGINT)),
proofs AS (SELECT tree, idx, string_agg(l || r, '' ORDER BY step) AS siblings, COUNT(*) AS n_steps FROM steps GROUP BY tree, idx),
folds AS (
  SELECT tree, idx, 0 AS step, COALESCE(tampered, leaf) AS digest FROM placed
  UNION ALL
  SELECT f.tree, f.idx, f.step + 1, sha256(s.l || f.digest || s.r) FROM folds f JOIN steps s ON s.tree = f.tree AND s.idx = f.idx AND s.step = f.step)
SELECT p.doc_id, p.source, p.leaf, s.subroot, u.digest AS root, sha256(COALESCE(q.siblings, '')) AS proof_sha256, p.tampered AS tampered_leaf,
  f.digest AS folded_root, f.digest = u.digest AS verified
FROM placed p JOIN subroots s ON s.tree = p.tree JOIN upper u ON u.n = 1
LEFT JOIN proofs q ON q.tree = p.tree AND q.idx = p.idx
JOIN folds f ON f.tree = p.tree AND f.idx = p.idx AND f.step = COALESCE(q.n_steps, 0)
"""
