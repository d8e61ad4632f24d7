"""Exact deduplication against a minimal perfect hash over historical digests.

A corpus splits into a history and newly arrived rows. The distinct digests of
the history are sharded by their leading bytes; each shard becomes one index
row: the levels of a minimal perfect hash, and per slot the full digest, the
winner's doc_id and the number of rows. New rows, first summed per digest, are
looked up in their shard. A minimal perfect hash answers for any key, so a hit
counts only if all 32 bytes in the slot agree; the others form groups of their
own.

Nulls and odd rows: a null text is an empty text; a null doc_id never wins
against another id; repeated rows are one group with the rows counted; an empty
table gives an empty result; further columns are ignored by ``groups_of`` and
kept by ``deduplicate``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import crc_mod, stage, text_column

#: Digests in one shard, on average; a shard is the unit that one task holds.
SHARD_KEYS = 1 << 16
GAMMA = 2
DIGEST = 32

_INDEX = "shard int, n long, sizes array<long>, bits binary, digests binary, winners binary, counts binary"
_GROUPS = "digest binary, keep_id long, group_size long"
_NONE = np.iinfo(np.int64).min


def _slots(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Slot of every digest at a level; ``words`` are its four 64-bit words."""
    mixed = (words[:, level % 4] ^ (words[:, (level + 1) % 4] >> np.uint64(level % 61 + 1))) * np.uint64(0x9E3779B97F4A7C15 + 2 * level)
    return ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def _words(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, dtype=np.uint64).reshape(-1, 4)


class PerfectHash:
    """Minimal perfect hash as levels of bit arrays; a key's slot is the rank of its bit."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits, dtype=np.int64) - 1

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        """Distinct keys only. Keys that collide at a level pass on to the next."""
        sizes, parts, left = [], [], words
        while len(left):
            size = GAMMA * len(left) + 1
            at = _slots(left, len(sizes), size)
            single = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(single)
            left = left[~single[at]]
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, dtype=bool))

    def slots(self, words: np.ndarray) -> np.ndarray:
        """Slot of each key; some slot, or -1, for a key that is no member."""
        found = np.full(len(words), -1, dtype=np.int64)
        open_, base = np.arange(len(words)), 0
        for level, size in enumerate(self.sizes):
            at = base + _slots(words[open_], level, size)
            hit = self.bits[at]
            found[open_[hit]] = self.rank[at[hit]]
            open_, base = open_[~hit], base + size
        return found


def digest_column() -> Column:
    return F.unhex(F.sha2(text_column(), 256))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("n"))


def _shard(shards: int) -> Column:
    return F.expr(f"CAST(conv(hex(substr(digest, 1, 6)), 16, 10) AS BIGINT) % {shards}").cast("int").alias("shard")


def _filled(values: pd.Series) -> np.ndarray:
    return values.astype("Int64").fillna(_NONE).to_numpy(dtype=np.int64)


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row per shard from distinct (digest, winner, n)."""

    def build(shard: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        digests = b"".join(pdf["digest"])
        words = _words(digests)
        table = PerfectHash.build(words)
        order = np.argsort(table.slots(words))
        return pd.DataFrame(
            {
                "shard": [shard[0]],
                "n": [len(pdf)],
                "sizes": [table.sizes],
                "bits": [np.packbits(table.bits).tobytes()],
                "digests": [words[order].tobytes()],
                "winners": [_filled(pdf["winner"])[order].tobytes()],
                "counts": [pdf["n"].to_numpy(dtype=np.int64)[order].tobytes()],
            }
        )

    return history.select("digest", "winner", "n", _shard(shards)).groupBy("shard").applyInPandas(build, _INDEX)


def look_up(arrived: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Groups of the history and of the arrived (digest, winner, n) together."""

    def merge(new: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        digests = b"".join(new["digest"])
        words, winners, counts = _words(digests), _filled(new["winner"]), new["n"].to_numpy(dtype=np.int64)
        member = np.zeros(len(new), dtype=bool)
        out_words, out_winners, out_counts = words, winners, counts
        if len(held):
            row = held.iloc[0]
            bits = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8), count=int(sum(row["sizes"]))).astype(bool)
            slot = PerfectHash([int(s) for s in row["sizes"]], bits).slots(words)
            stored = _words(row["digests"])
            member[slot >= 0] = (stored[slot[slot >= 0]] == words[slot >= 0]).all(axis=1)
            held_winners = np.frombuffer(row["winners"], dtype=np.int64).copy()
            held_counts = np.frombuffer(row["counts"], dtype=np.int64).copy()
            np.maximum.at(held_winners, slot[member], winners[member])
            np.add.at(held_counts, slot[member], counts[member])
            out_words = np.concatenate([stored, words[~member]])
            out_winners = np.concatenate([held_winners, winners[~member]])
            out_counts = np.concatenate([held_counts, counts[~member]])
        raw = out_words.tobytes()
        return pd.DataFrame(
            {
                "digest": [raw[i : i + DIGEST] for i in range(0, len(raw), DIGEST)],
                "keep_id": pd.Series(out_winners, dtype="Int64").mask(out_winners == _NONE),
                "group_size": out_counts,
            }
        )

    keyed = arrived.select("digest", "winner", "n", _shard(shards))
    return keyed.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(merge, _GROUPS)


def groups_of(docs: DataFrame, historical: Column | None = None) -> DataFrame:
    """Per distinct text: digest, keep_id (largest doc_id), group_size.

    ``historical`` marks the rows that the index is built from (default: those
    whose crc32 of doc_id is even); the result does not depend on it.
    """
    historical = crc_mod(2) == 0 if historical is None else historical
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), digest_column().alias("digest"), F.coalesce(historical, F.lit(False)).alias("old")
    )
    rows = stage(rows, "digests")
    history = stage(_summed(rows.where("old")), "history")
    shards = max(16, history.count() // SHARD_KEYS)
    index = stage(build_index(history, shards), "digest-index")
    return look_up(_summed(rows.where("NOT old")), index, shards)


def marked(docs: DataFrame, historical: Column | None = None) -> DataFrame:
    """Every row's group: doc_id, keep_id, group_size, kept, text_sha256.

    Repeated rows of the winning doc_id are all marked as kept; ``deduplicate``
    leaves one of them.
    """
    groups = groups_of(docs, historical)
    rows = docs.select(F.col("doc_id"), digest_column().alias("row_digest"))
    # The runtime splits a digest that holds a large share of the rows.
    joined = rows.join(groups, rows["row_digest"] == groups["digest"])
    return joined.select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one per distinct text, with all their columns."""
    groups = groups_of(docs).select(F.col("keep_id").alias("_keep"), F.col("digest").alias("_group"))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), digest_column().alias("_digest"))
    winners = rows.join(groups, (rows["_digest"] == groups["_group"]) & rows["_id"].eqNullSafe(groups["_keep"]), "left_semi")
    # Only rows that repeat both id and text are left; they meet in their digest's partition.
    once = Window.partitionBy("_digest", "_id").orderBy(F.lit(1))
    return winners.select("_row", F.row_number().over(once).alias("_no")).where("_no = 1").select("_row.*")


SQL = """
WITH rows_ AS (SELECT doc_id, sha256(COALESCE(text, '')) AS text_sha256 FROM documents),
groups_ AS (SELECT text_sha256, MAX(doc_id) AS keep_id, COUNT(*) AS group_size FROM rows_ GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM rows_ JOIN groups_ USING (text_sha256)
"""
