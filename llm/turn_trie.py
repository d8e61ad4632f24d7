"""Prefix trie of conversations by truncation peeling.

A conversation is the sequence of its turns' digests; every prefix is a node.
Peeling goes down from the deepest prefixes: at depth d the conversations that
end there join the nodes that survive from depth d + 1, all are cut by their
last turn and grouped again, and each group is a node whose figures are summed
from its members as it is found.

Sequences are cut into bands of turns, so that a conversation of any length is
many rows; bands are peeled from the last to the first, the nodes at the top of
a band being the survivors that enter the next one. Within a band the distinct
sequences are range-partitioned in their own order and each partition is peeled
in one task. A node whose members all stand in one partition is finished there.
The others are prefixes of a partition's first or last sequence: these two go on,
as sequences with figures of their own at every depth, to another round of
fewer partitions, until one is left.

Nulls and odd rows: null turns stand first; turns with equal numbers are ordered
by the digest of role and text; null role or text is empty; rows without conv_id
belong to no conversation; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from galley.scan import running_sum, scan
from llm.common import SQL_CRC32, stage, words_pattern

#: Neighbours that share a first conversation, and the most turns that they take from it.
FAMILY = 20
SHARED = 3
#: Turns in a band (or a sixteenth of the longest conversation), and bytes of a turn's digest.
BAND = 1024
BANDS = 16
DIGEST = 16
#: Turns in one task of a round, sequences in one task of the next rounds, and ids hashed as one piece.
TASK_TURNS = 1 << 15
TASK_CHAINS = 1 << 10
PIECE_IDS = 1 << 12

_FIGURES = ["n", "conv", "children", "leaves", "saved"]
_CHAIN = (
    "base binary, path binary, next binary, words array<long>, first long, n array<long>, conv array<long>, children array<long>, "
    "leaves array<long>, saved array<long>, ends array<binary>"
)
_NODE = "key binary, parent_key binary, conv long, depth long, parent_conv long, n long, children long, leaves long, saved long, ends binary"


# ---- Conversations as sequences ---------------------------------------------------------------------------------


def ordered_turns(rows: DataFrame) -> DataFrame:
    """conv, place (from 1), digest (hex) and words of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    turns = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").isNotNull().cast("int").alias("known"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), digest.alias("digest"),
        F.regexp_count(text, F.lit(words_pattern)).cast("long").alias("words"),
    )
    numbered = scan(turns, ["conv"], ["known", "turn", "digest"], ranged=True, place=running_sum(F.lit(1)))
    return numbered.select("conv", "place", "digest", "words")


def _shared(conv: Column) -> Column:
    """How many turns a conversation takes from the first one of its family."""
    return (F.crc32(conv.cast("string")) % (SHARED + 1)).cast("long")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, depth, digest, words) of rebuilt conversations, and all conversations (conv, size)."""
    sizes = turns.groupBy("conv").agg(F.max("place").alias("own"), F.sort_array(
        F.collect_list(F.when(F.col("place") <= SHARED, F.struct("place", "digest", "words")))).alias("opening"))
    sizes = stage(sizes, "openings")
    wanted = sizes.select("conv", "own", (F.col("conv") - F.col("conv") % FAMILY).alias("of"), _shared(F.col("conv")).alias("h"))
    openings = sizes.select(F.col("conv").alias("of"), F.col("opening"))
    heads = wanted.join(openings, "of", "left").select(
        "conv", "own", "h", F.expr("slice(opening, 1, CAST(h AS INT))").alias("head")
    )
    heads = stage(heads.withColumn("m", F.greatest(F.size("head"), F.lit(0)).cast("long")), "heads")
    first = heads.select("conv", F.explode("head").alias("t")).select("conv", F.col("t.place").alias("depth"), "t.digest", "t.words")
    later = turns.join(heads.select("conv", "h", "m"), "conv").where("place > h").select(
        "conv", (F.col("place") - F.col("h") + F.col("m")).alias("depth"), "digest", "words"
    )
    whole = heads.select("conv", (F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size"))
    return first.unionByName(later), whole


def _hash_parts(value: Column) -> list[Column]:
    """Four 32-bit parts of a digest; their sums name a sequence of digests whatever its length."""
    digest = F.sha2(value, 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def segments(turns: DataFrame, band: int) -> DataFrame:
    """One row per conversation and band: path, words, and the names of what stands before it and with it."""
    rows = turns.withColumn("band", F.expr(f"(depth - 1) div {band}"))
    held = rows.groupBy("conv", "band").agg(F.sort_array(F.collect_list(F.struct("depth", "digest", "words"))).alias("turns"))
    paths = held.select("conv", "band", F.unhex(F.array_join(F.col("turns.digest"), "")).alias("path"), F.col("turns.words").alias("words"))
    named = paths.select("*", *[p.alias(f"p{i}") for i, p in enumerate(_hash_parts(F.concat(F.col("band").cast("string").cast("binary"), F.col("path"))))])
    so_far = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)  # at most BANDS + 1 rows
    sums = [F.sum(f"p{i}").over(so_far) for i in range(4)]
    name = F.unhex(F.substring(F.sha2(F.concat_ws(",", *sums), 256), 1, 2 * DIGEST))
    return named.select("conv", "band", "path", "words", name.alias("name")).withColumn(
        "base", F.coalesce(F.lag("name").over(Window.partitionBy("conv").orderBy("band")), F.lit(bytes(DIGEST)))
    )


def endings(conversations: DataFrame) -> DataFrame:
    """Distinct conversations (name, size): conv (smallest id), n, and SHA-256 of the ids in order.

    The ids of one conversation are hashed in order by one task, but as texts of ``PIECE_IDS`` ids that others wrote.
    """
    named = conversations.select(F.coalesce("name", F.lit(bytes(DIGEST))).alias("name"), "conv")
    numbered = scan(named, ["name"], ["conv"], ranged=True, place=running_sum(F.lit(1)))
    pieces = numbered.groupBy("name", F.expr(f"place div {PIECE_IDS}").alias("piece")).agg(
        F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"), F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple | None = None
        for batch in batches:
            done = []
            for name, ids, n, conv in zip(*(batch.column(c).to_pylist() for c in ("name", "ids", "n", "conv"))):
                if open_ and open_[0] == name:
                    open_[1].update(b"," + ids.encode())
                    open_ = (name, open_[1], open_[2] + n, min(open_[3], conv))
                else:
                    done += [open_] if open_ else []
                    open_ = (name, hashlib.sha256(ids.encode()), n, conv)
            yield _ended(done)
        if open_:
            yield _ended([open_])

    def _ended(done: list[tuple]) -> pa.RecordBatch:
        names, hashes, counts, convs = zip(*done) if done else ((), (), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.binary()), pa.array([h.digest() for h in hashes], pa.binary()), pa.array(counts, pa.int64()), pa.array(convs, pa.int64())],
            ["name", "ends", "n", "conv"],
        )

    return pieces.repartition("name").sortWithinPartitions("name", "piece").mapInArrow(digest, "name binary, ends binary, n long, conv long")


# ---- Peeling ----------------------------------------------------------------------------------------------------


def _prefix_keys(base: bytes, path: bytes, following: bytes | None, band: int) -> list[bytes]:
    """Names of the nodes along a sequence, from depth 0 of the band on."""
    keys, state = [base], hashlib.sha256(base)
    for i in range(0, len(path), DIGEST):
        state.update(path[i : i + DIGEST])
        keys.append(state.digest()[:DIGEST])
    if following is not None and len(path) == band * DIGEST:
        keys[-1] = following
    return keys


class Peel:
    """Peels one partition of distinct sequences in their order, each with figures at its depths from ``first`` on.

    ``edges`` are the rows whose prefixes may have members in other partitions.
    """

    def __init__(self, rows: dict[str, list], band: int, edges: list[int]):
        self.rows, self.band, self.edges = rows, band, edges
        self.count = len(rows["base"])
        self.length = np.array([len(p) // DIGEST for p in rows["path"]], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.words = np.array(list(chain.from_iterable(rows["words"])), dtype=np.int64)
        self.common = self._common()
        first = np.array(rows["first"], dtype=np.int64)
        held = self.length - first + 1
        self.entry_row = np.repeat(np.arange(self.count), held)
        self.entry_depth = np.arange(len(self.entry_row)) - np.repeat(np.cumsum(held) - held - first, held)
        self.entries = {f: np.array(list(chain.from_iterable(rows[f])), dtype=np.int64) for f in _FIGURES}
        self.entry_ends = list(chain.from_iterable(rows["ends"]))
        self._keys: dict[int, list[bytes]] = {}

    def _common(self) -> np.ndarray:
        """Turns that each sequence shares with the one before; -1 where what stands before the band differs."""
        base, flat = self.rows["base"], np.frombuffer(b"".join(self.rows["path"]), dtype=np.int64).reshape(-1, DIGEST // 8)
        common = np.full(self.count, -1, dtype=np.int64)
        same = np.array([i for i in range(1, self.count) if base[i] == base[i - 1]], dtype=np.int64)
        common[same] = depth = 0
        while len(same):
            same = same[(self.length[same] > depth) & (self.length[same - 1] > depth)]
            same = same[(flat[self.start[same] + depth] == flat[self.start[same - 1] + depth]).all(axis=1)]
            depth += 1
            common[same] = depth
        return common

    def key(self, row: int, depth: int) -> bytes:
        if row not in self._keys:
            self._keys[row] = _prefix_keys(self.rows["base"][row], self.rows["path"][row], self.rows["next"][row], self.band)
        return self._keys[row][depth]

    def run(self, named: bool) -> Iterator[tuple[str, dict]]:
        """("node", …) for every finished node and ("chain", …) for the edges; all nodes get a name if ``named``."""
        deepest = int(self.length.max())
        by_depth = np.argsort(self.entry_depth, kind="stable")
        limits = np.searchsorted(self.entry_depth[by_depth], np.arange(deepest + 2))
        left: dict[int, dict[int, tuple]] = {e: {} for e in self.edges}
        # Survivors of the depth below: first row, figures, 1 if finished, and the node itself.
        heads, figures = np.zeros(0, dtype=np.int64), {f: np.zeros(0, dtype=np.int64) for f in _FIGURES}
        finished, nodes = np.zeros(0, dtype=np.int64), []
        for depth in range(deepest, -1, -1):
            new = by_depth[limits[depth] : limits[depth + 1]]
            old = len(heads)
            place = np.concatenate([heads, self.entry_row[new]])
            sort = np.argsort(place, kind="stable")
            place = place[sort]
            # A group begins with its first row, which shares less than ``depth`` turns with the row before.
            begins = self.common[place] < depth
            begins[1:] &= place[1:] != place[:-1]
            at, group = np.flatnonzero(begins), np.cumsum(begins) - 1
            summed = {f: np.concatenate([figures[f], self.entries[f][new]])[sort] for f in _FIGURES}
            total = {f: np.add.reduceat(summed[f], at) for f in ("n", "leaves", "saved")}
            total["conv"] = np.minimum.reduceat(summed["conv"], at)
            below = np.concatenate([finished, self.entries["children"][new]])[sort]
            total["children"] = np.add.reduceat(below, at)
            ends: dict[int, bytes] = {}
            for i, g in zip(sort.tolist(), group.tolist()):
                if i >= old and self.entry_ends[new[i - old]] is not None:
                    ends[g] = self.entry_ends[new[i - old]]
            heads = place[at]
            edge_of = {int(np.searchsorted(heads, e, side="right")) - 1: e for e in reversed(self.edges) if depth <= self.length[e]}
            closed = np.ones(len(heads), dtype=np.int64)
            closed[list(edge_of)] = 0
            total["leaves"] = np.where(closed & (total["children"] == 0), 1, total["leaves"])
            if depth:
                total["saved"] += closed * (total["n"] - 1) * self.words[self.start[heads] + depth - 1]
            made = []
            for g, row in enumerate(heads.tolist()):
                row_figures = {f: int(total[f][g]) for f in _FIGURES}
                if g in edge_of:
                    left[edge_of[g]][depth] = (row_figures, ends.get(g))
                    made.append(None)
                    continue
                continues = depth == 0 or depth == self.band and self.rows["next"][row] is not None
                key = self.key(row, depth) if named or continues else None
                made.append({"key": key, "parent_key": None, "parent_conv": None, "depth": depth, "ends": ends.get(g), **row_figures})
            # Nodes below learn their parent: its id if it is finished, its name otherwise or at the top of the band.
            for i, g in zip(sort.tolist(), group.tolist()):
                if i < old and nodes[i] is not None:
                    if g in edge_of or depth == 0:
                        nodes[i]["parent_key"] = self.key(int(heads[g]) if g not in edge_of else edge_of[g], depth)
                    else:
                        nodes[i]["parent_conv"] = made[g]["conv"]
                    yield "node", nodes[i]
            # What is not finished goes on by itself, so nothing of it is added here.
            figures = {f: np.where(closed, total[f], _NOTHING[f]) for f in _FIGURES}
            finished, nodes = closed, made
        for node in nodes:
            if node is not None:
                yield "node", node
        for e in self.edges:
            if left[e]:
                first = min(left[e])
                each = [left[e][d] for d in range(first, int(self.length[e]) + 1)]
                yield "chain", {
                    "base": self.rows["base"][e], "path": self.rows["path"][e], "next": self.rows["next"][e], "words": self.rows["words"][e],
                    "first": first, "ends": [end for _, end in each], **{f: [figures[f] for figures, _ in each] for f in _FIGURES},
                }


_NOTHING = {"n": 0, "conv": np.iinfo(np.int64).max, "children": 0, "leaves": 0, "saved": 0}


def _peeled(rows: DataFrame, band: int, first_round: bool, last_round: bool) -> DataFrame:
    """One round: every partition of sorted sequences is peeled; columns ``node`` and ``chain``, one of them null."""
    types = to_arrow_schema(StructType.fromDDL(f"node struct<{_struct(_NODE)}>, chain struct<{_struct(_CHAIN)}>"))

    def peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for name, column in zip(batch.schema.names, batch.columns):
                held.setdefault(name, []).extend(column.to_pylist())
        if not held or not held["base"]:
            return
        edges = [] if last_round else sorted({0, len(held["base"]) - 1})
        out: list[tuple[str, dict]] = []
        for item in Peel(held, band, edges).run(named=not first_round):
            out.append(item)
            if len(out) >= 2000:
                yield _batch(out)
                out = []
        yield _batch(out)

    def _batch(items: list[tuple[str, dict]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"node": None, "chain": None, kind: value} for kind, value in items], schema=types)

    return rows.mapInArrow(peel, f"node struct<{_struct(_NODE)}>, chain struct<{_struct(_CHAIN)}>")


def _struct(columns: str) -> str:
    return ", ".join(": ".join(c.split(" ", 1)) for c in columns.split(", "))


def peel_band(records: DataFrame, band: int, turns: int) -> DataFrame:
    """Nodes of a band from its distinct sequences; its depth-0 nodes are the survivors that enter the band before."""
    columns = [c.split()[0] for c in _CHAIN.split(", ")]
    parts, first_round, nodes = -(-turns // TASK_TURNS), True, None
    while True:
        last_round = parts <= 1
        # An unkeyed single partition in the last round: nothing may be dealt elsewhere.
        dealt = records.coalesce(1) if last_round else records.repartitionByRange(parts, "base", "path")
        done = stage(_peeled(dealt.select(*columns).sortWithinPartitions("base", "path"), band, first_round, last_round), "peeled")
        found = done.where("node IS NOT NULL").select("node.*")
        nodes = found if nodes is None else nodes.unionByName(found)
        if last_round:
            return nodes
        records = done.where("chain IS NOT NULL").select("chain.*")
        parts, first_round = -(-records.count() // TASK_CHAINS), False


def nodes_of(rows: DataFrame) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = rows.sparkSession
    turns, whole = rebuilt(stage(ordered_turns(rows), "ordered-turns"))
    turns, whole = stage(turns, "rebuilt-turns"), stage(whole, "rebuilt")
    longest, n_turns, n_convs, smallest = whole.agg(F.max("size"), F.sum("size"), F.count(F.lit(1)), F.min("conv")).first()
    if not n_convs:
        return spark.createDataFrame([], _RESULT)
    band = max(BAND, -(-longest // BANDS))
    bands = -(-longest // band)
    parts = stage(segments(turns, band), "segments")
    last = parts.select(F.col("conv").alias("of"), "band", "name")
    ended = whole.join(last, (whole["conv"] == last["of"]) & (last["band"] == F.expr(f"(size - 1) div {band}")) & (whole["size"] > 0), "left")
    ended = stage(endings(ended.select("conv", "name")), "endings")
    chosen = ended.select("conv", "ends", "n", F.col("name").alias("whole"))

    tables, survivors, root_key = [], None, bytes(DIGEST)
    for number in reversed(range(bands)):
        here = parts.where(F.col("band") == number)
        records = here.join(chosen, (here["conv"] == chosen["conv"]) & (here["name"] == chosen["whole"])).select(
            "base", "path", F.lit(None).cast("binary").alias("next"), "words", "n", here["conv"],
            *[F.lit(0).cast("long").alias(f) for f in ("children", "leaves", "saved")], "ends",
        )
        if survivors is not None:
            ids = here.select(F.col("conv").alias("of"), "name", "base", "path", "words")
            entering = survivors.join(ids, (survivors["conv"] == ids["of"]) & (survivors["key"] == ids["name"]))
            records = records.unionByName(entering.select(
                "base", "path", F.col("key").alias("next"), "words", "n", "conv", "children", "leaves", "saved", F.lit(None).cast("binary").alias("ends")))
            # A conversation that ends with the band and survivors of the next band may be one node.
            records = records.groupBy("base", "path").agg(
                F.max("next").alias("next"), F.first("words").alias("words"), F.sum("n").alias("n"), F.min("conv").alias("conv"),
                F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends"),
            )
        listed = records.select(
            "base", "path", "next", "words", F.size("words").cast("long").alias("first"), *[F.array(f).alias(f) for f in (*_FIGURES, "ends")]
        )
        nodes = peel_band(stage(listed, "sequences"), band, n_turns)
        tops = nodes.where("depth = 0")
        survivors = stage(tops, "survivors") if number else tops
        tables.append(nodes.where("depth > 0").withColumn("depth", F.col("depth") + number * band))
    root = _root(spark, survivors, ended, n_convs, smallest, root_key)
    if not tables:
        return _named(root)
    nodes = tables[0]
    for table in tables[1:]:
        nodes = nodes.unionByName(table)
    by_root = F.col("parent_key") == F.lit(root_key)
    known = nodes.where(F.col("parent_key").isNull() | by_root).withColumn("parent_conv", F.when(by_root, F.lit(smallest)).otherwise(F.col("parent_conv")))
    names = nodes.where("key IS NOT NULL").select(F.col("key").alias("name"), F.col("conv").alias("named"))
    open_ = nodes.where(F.col("parent_key").isNotNull() & ~by_root)
    found = open_.join(names, open_["parent_key"] == names["name"]).withColumn("parent_conv", F.col("named")).select(*nodes.columns)
    return _named(known.unionByName(found).unionByName(root))


def _root(spark, tops: DataFrame | None, ended: DataFrame, n_convs: int, smallest: int, key: bytes) -> DataFrame:
    """The textless root: what the first band left, and conversations without a turn."""
    top = tops.first() if tops is not None else None
    empty = ended.where(F.col("name") == F.lit(key)).first()
    row = (key, None, smallest, 0, None, n_convs, top.children if top else 0, top.leaves if top else 1, top.saved if top else 0, empty.ends if empty else None)
    return spark.createDataFrame([row], _NODE)


def _named(nodes: DataFrame) -> DataFrame:
    ends = F.coalesce(F.lower(F.hex("ends")), F.sha2(F.lit(""), 256))
    return nodes.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), ends.alias("ends_sha256"),
    )


_RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"

SQL = f"""
WITH turns AS (
  SELECT conv_id AS conv, COALESCE(role, '') AS role, COALESCE(text, '') AS text, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    sha256(strlen(COALESCE(role, '')) || ':' || COALESCE(role, '') || COALESCE(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv, COUNT(*) AS own, {SQL_CRC32.format(column="conv")} % 4 AS h FROM turns GROUP BY conv),
heads AS (
  SELECT c.conv, c.h, c.own, LEAST(c.h, COALESCE(b.own, 0)) AS m FROM convs c LEFT JOIN convs b ON b.conv = c.conv - c.conv % 20),
rebuilt AS (
  SELECT h.conv, t.place AS d, t.role, t.text FROM heads h JOIN turns t ON t.conv = h.conv - h.conv % 20 AND t.place <= h.m
  UNION ALL
  SELECT h.conv, t.place - h.h + h.m, t.role, t.text FROM heads h JOIN turns t ON t.conv = h.conv AND t.place > h.h),
paths AS (
  SELECT conv, d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    sha256(string_agg(sha256(strlen(role) || ':' || role || text), '' ORDER BY d) OVER (PARTITION BY conv ORDER BY d)) AS path FROM rebuilt
  UNION ALL SELECT conv, 0, 0, '' FROM convs),
lasts AS (SELECT conv, MAX(d) AS size FROM paths GROUP BY conv),
nodes AS (
  SELECT p.path, MIN(p.conv) AS conv_id, p.d AS depth, COUNT(*) AS n_convs, MAX(p.words) AS words,
    sha256(COALESCE(string_agg(CAST(p.conv AS VARCHAR), ',' ORDER BY p.conv) FILTER (l.size = p.d), '')) AS ends_sha256
  FROM paths p JOIN lasts l USING (conv) GROUP BY p.path, p.d),
linked AS (
  SELECT n.*, up.path AS parent FROM nodes n LEFT JOIN paths up ON up.conv = n.conv_id AND up.d = n.depth - 1),
counted AS (
  SELECT l.*, COALESCE(c.k, 0) AS n_children FROM linked l LEFT JOIN (SELECT parent, COUNT(*) AS k FROM linked GROUP BY parent) c ON c.parent = l.path),
subtrees AS (
  SELECT up.path, SUM((c.n_convs - 1) * c.words) AS saved_tokens, COUNT(*) FILTER (c.n_children = 0) AS n_leaves
  FROM counted c JOIN paths up ON up.conv = c.conv_id AND up.d <= c.depth GROUP BY up.path)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN subtrees s USING (path) LEFT JOIN counted p ON p.path = c.parent
"""
