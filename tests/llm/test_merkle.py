"""The Merkle manifest against a plain tree and its SQL."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pandas as pd
import pytest

from llm import merkle
from llm.common import SQL_CRC32, prepare

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, place long, leaf string, tree string"


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def climb(digests):
    """Root and, per place, the siblings of every level."""
    beside, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for i, place in enumerate(at):
            run = range(place // 3 * 3, min(place // 3 * 3 + 3, len(level)))
            beside[i].append(([level[j] for j in run if j < place], [level[j] for j in run if j > place]))
        level = [sha(level[j : j + 3]) for j in range(0, len(level), 3)]
        at = [place // 3 for place in at]
    return level[0], beside


def plain(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = climb([leaf(r) for r in groups[name]])
    root, tops = climb([trees[name][0] for name in names]) if names else (None, [])
    out = []
    for name, top in zip(names, tops):
        for row, beside in zip(groups[name], trees[name][1]):
            path = beside + top
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            digest = leaf((*row[:4], row[4] and row[4].replace("\n", ""))) if tampered else leaf(row)
            for left, right in path:
                digest = sha([*left, digest, *right])
            proof = sha(d for left, right in path for d in left + right)
            out.append((row[0], leaf(row), trees[name][0], root, proof, digest, digest == root))
    return sorted(map(repr, out))


def made(seed, n):
    random.seed(seed)
    sources = ["hot", "hot", "hot", "b", "ß", "", None, *[f"s{i}" for i in range(12)]]
    rows = [(i * 7 - 50, random.choice(sources), "en", i, random.choice(["a\nb", "é\n\nü", "", "plain", "\n", None])) for i in range(n)]
    rows += [(None, "hot", None, None, None), (None, None, None, 3, "x\n"), (6, "b", "en", 1, "q\n"), (6, "b", "en", 1, "q\n"), (6, "b", None, 1, "z" * 100_000 + "\n")]
    return rows


def in_duckdb(rows):
    frame = pd.DataFrame(rows, columns=["doc_id", "source", "lang", "n_chars", "text"]).astype({"doc_id": "Int64", "n_chars": "Int64"})
    con = duckdb.connect()
    con.register("documents", frame)
    return sorted(map(repr, con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({merkle.SQL})").fetchall()))


@pytest.mark.parametrize("depth, n", [(1, 60), (2, 300), (7, 300), (7, 1), (2, 0)])
def test_manifest(spark, depth, n):
    prepare(spark)
    rows = made(depth, n) if n > 1 else [(3, "one", "en", 4, "a\nb")][:n]
    docs = spark.createDataFrame([(*r, 1, "clash", "clash") for r in rows], SCHEMA).repartition(3)
    got = sorted(repr(tuple(r)) for r in merkle.manifest(docs, depth).select(*COLUMNS).collect())
    assert got == plain(rows)
    if rows:
        assert got == in_duckdb(rows)


def test_versions_share_all_but_the_path():
    tree = merkle.PersistentTree([sha([str(i)]) for i in range(20)], 20, 7)
    before, size = list(tree.hash), len(tree.hash)
    new = tree.changed(13, sha(["other"]))
    assert tree.hash[:size] == before and len(tree.hash) - size == tree.height + 1
    assert tree.hash[new] == climb([sha(["other" if i == 13 else str(i)]) for i in range(20)])[0]


def test_sql_checksum():
    con = duckdb.connect()
    values = con.sql(f"SELECT i, {SQL_CRC32.format(column='i')} FROM range(-20, 1000, 7) t(i)").fetchall()
    assert all(crc == zlib.crc32(str(i).encode()) for i, crc in values)
