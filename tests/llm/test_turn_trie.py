"""The prefix trie of conversations against a plain trie and its SQL."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pandas as pd
import pytest

from llm import turn_trie
from llm.common import prepare

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, path string, n string"


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        family = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        convs[c] = tuple(own.get(family, [])[:h] + turns[h:])
    members = defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    words = {n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0 for n in members}
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(members[node]) - 1) * words[node]
    out = []
    for node, of in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in of if convs[c] == node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(of), len(node), parent, len(of), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def made(seed, n):
    random.seed(seed)
    texts = ["a b c", "a b\tc d", "é ü", "", None, "one\n two"]
    rows = []
    for conv in range(n):
        # A third of all conversations are alike, and many begin alike.
        turns = [("user", "hello there")] * 3 if conv % 3 == 0 else [("system", "be kind now")] + [
            (random.choice(["user", "assistant", None]), random.choice(texts)) for _ in range(random.randint(0, 6))
        ]
        rows += [(conv * 3 - 40, i, *turn) for i, turn in enumerate(turns)]
    rows += [(9000, i, "user", f"turn {i % 7}") for i in range(90)] + [(9001, i, "user", f"turn {i % 7}" if i < 50 else "end") for i in range(70)]
    rows += [(9002, i, "user", f"turn {i % 7}") for i in range(40)]
    rows += [(None, 1, "user", "lost"), (5, None, "user", "first"), (5, None, None, None), (5, 2, "user", "x y"), (5, 2, "user", "x y"), (5, 2, "user", "w" * 50_000)]
    rows += [(777_777, 1, "user", "alone")]
    return rows


@pytest.mark.parametrize("band, turns, chains, ids", [(1024, 1 << 15, 1024, 4096), (1024, 40, 5, 3), (8, 60, 6, 5), (7, 1 << 15, 1024, 2)])
def test_nodes(spark, band, turns, chains, ids, monkeypatch):
    for name, value in (("BAND", band), ("TASK_TURNS", turns), ("TASK_CHAINS", chains), ("PIECE_IDS", ids)):
        monkeypatch.setattr(turn_trie, name, value)
    prepare(spark)
    rows = made(band + chains, 60)
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)
    got = sorted(repr(tuple(r)) for r in turn_trie.nodes_of(table).select(*COLUMNS).collect())
    assert got == plain(rows)


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "x")], [(1, 0, "user", "x")], [(21, 0, "user", "x y"), (20, 0, "user", "z")]])
def test_small_tables(spark, rows):
    prepare(spark)
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    got = sorted(repr(tuple(r)) for r in turn_trie.nodes_of(table).select(*COLUMNS).collect())
    assert got == plain(rows)


def test_sql():
    rows = made(3, 40)
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    assert sorted(map(repr, con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({turn_trie.SQL})").fetchall())) == plain(rows)
