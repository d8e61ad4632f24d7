"""Near duplicates by SimHash: a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Three differing bits touch at most three of
them, so linked fingerprints agree in at least five positional bytes, the
count that a pair must reach. Postings of a single positional byte would be
read by nearly every pair; postings are therefore kept per four positions. The
fourteen blocks of the Steiner system S(3, 4, 8) put any three positions into
one block, whose complement is a block too: whichever three bytes differ, one
posting list of four equal bytes holds both fingerprints. Within a posting list
the equal positional bytes of a pair are counted, pairs below five are left,
and the others are verified bit by bit.

Equal fingerprints are one entry, and a posting list gives a spanning forest of
its links instead of all pairs, so the work follows the number of different
fingerprints. Components come from rounds of large-star and small-star steps on
the links, each round written to the shared folder.

Nulls and odd rows: null, empty and blank texts have fingerprint zero and link
like any other; repeated rows are equal entries; a null doc_id is never the
smallest id unless its component has no other; an empty table gives an empty
result; further columns are ignored by ``components`` and kept by ``thin_out``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import stage

BITS = 3
SHINGLE = 3
HASH_SEED = 42
POSITIONS = 8
MATCHES = POSITIONS - BITS
#: Words hashed at a time, which bounds memory for long texts.
WORDS_AT_ONCE = 1 << 17
#: Pairs compared at a time within a posting list.
PAIRS_AT_ONCE = 1 << 20


def position_blocks() -> list[tuple[int, ...]]:
    """Fourteen sets of four positions: the words of weight four of the extended Hamming code."""
    words = []
    for a in range(16):
        bits = [a >> k & 1 for k in range(4)]
        word = [sum(bits[k] & (x >> k) for k in range(3)) + bits[3] & 1 for x in range(8)]
        if sum(word) == 4:
            words.append(tuple(i for i, on in enumerate(word) if on))
    return words


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text; words are runs without ASCII white space, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, count, WORDS_AT_ONCE):
        end = min(count, start + WORDS_AT_ONCE)
        runs = [words[start + k : end + k] for k in range(shingle)] if len(words) >= shingle else [[b" ".join(words)]]
        hashes = np.fromiter((digest(s, HASH_SEED) for s in map(b" ".join, zip(*runs))), dtype=np.uint64, count=end - start)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > count).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return _narrow(docs).mapInArrow(run, "doc_id long, fp long")


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _prints_of_texts(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text (a null one is empty) and fp: id and digest name a row up to repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            values = np.array([fingerprint(t) for t in texts], dtype=np.uint64)
            digests = pa.array([hashlib.sha256((t or "").encode()).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), digests, pa.array(values.view(np.int64))], ["doc_id", "digest", "fp"])

    return _narrow(docs).mapInArrow(run, "doc_id long, digest binary, fp long")


_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


def _linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs that reach the byte count and differ in few enough bits."""
    both = np.bitwise_xor(a, b)
    parts = np.ascontiguousarray(both).view(np.uint8).reshape(*both.shape, POSITIONS)
    counted = (parts == 0).sum(axis=-1) >= MATCHES
    near = np.zeros(both.shape, dtype=bool)
    left = np.ascontiguousarray(both[counted])
    near[counted] = _ONES[left.view(np.uint16).reshape(-1, 4)].sum(axis=1) <= BITS
    return near


def _forest(values: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect the distinct values just as all links would: breadth-first trees."""
    heads, tails = [], []
    rest = values
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            step = max(1, PAIRS_AT_ONCE // len(rest))
            part, front = front[:step], front[step:]
            near = _linked(part[:, None], rest[None, :])
            reached = near.any(axis=0)
            if reached.any():
                heads.append(part[near[:, reached].argmax(axis=0)])
                tails.append(rest[reached])
                front = np.concatenate([front, rest[reached]])
                rest = rest[~reached]
    return heads, tails


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints, spanning every posting list's components."""
    masks = []
    for block in position_blocks():
        mask = sum(0xFF << (8 * i) for i in block)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    entries = F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks)]))
    postings = distinct.select("fp", entries.alias("e")).groupBy("e.block", "e.part").agg(F.collect_list("fp").alias("fps"))
    postings = postings.where(F.size("fps") > 1).select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, offsets = lists.flatten().to_numpy().view(np.uint64), np.diff(lists.offsets.to_numpy())
            ends = np.cumsum(offsets)
            starts = ends - offsets
            heads, tails = [], []
            pairs = offsets == 2
            a, b = flat[starts[pairs]], flat[starts[pairs] + 1]
            near = _linked(a, b)
            heads.append(a[near])
            tails.append(b[near])
            for s, e in zip(starts[~pairs], ends[~pairs]):
                more = _forest(np.sort(flat[s:e]))
                heads += more[0]
                tails += more[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x).view(np.int64)) for x in (heads, tails)], ["a", "b"]
            )

    return postings.mapInArrow(run, "a long, b long").distinct()


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on (a, b) with a > b: neighbours are hung on the smallest of a node's neighbours and itself."""
    sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        sides = sides.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = sides.join(least, "u")
    hung = joined.where("v > u" if large else "v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        hung = hung.unionByName(least.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b")))
    return hung.where("a <> b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node of the component."""
    current = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    state = None
    while True:
        current = stage(_stars(_stars(current, large=True), large=False), "stars")
        # Settled when no node hangs on two others and no root hangs on another node.
        found = current.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
        ).first()
        if state == found:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        state = found


def _rooted(distinct: DataFrame) -> DataFrame:
    """``distinct`` (fp, …) with root, the fingerprint that names the component."""
    roots = connected(links(distinct.select("fp")))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root"))


def components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    marked = stage(fingerprints(docs, shingle), "fingerprints")
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    placed = _rooted(distinct)
    # One row per root, for roots that have more than themselves; few beside all fingerprints.
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = stage(placed.join(least, "root").select("fp", "component_id"), "classes")
    return marked.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def thin_out(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one per component: the one with the smallest doc_id.

    A null doc_id comes after all others. Of rows with one doc_id the one with the smallest SHA-256 of its text stays,
    of rows with one text as well the smallest by all columns.
    """
    marked = stage(_prints_of_texts(docs), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "digest")).alias("first")
    distinct = stage(marked.groupBy("fp").agg(first), "distinct-fingerprints")
    winners = _rooted(distinct).groupBy("root").agg(F.min("first").alias("w")).select(F.col("w.doc_id").alias("_kept"), F.col("w.digest").alias("_of"))
    digest = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).alias("_digest")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), digest)
    chosen = rows.join(stage(winners, "winners"), (rows["_digest"] == F.col("_of")) & rows["_id"].eqNullSafe(F.col("_kept")), "left_semi")
    # Only rows that repeat both id and text are left to choose from.
    once = Window.partitionBy("_digest", "_id").orderBy("_row")
    return chosen.select("_row", F.row_number().over(once).alias("_no")).where("_no = 1").select("_row.*")
