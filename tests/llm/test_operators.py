"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against plain versions."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from llm import bpe, exact_dedup, mixing, simhash, suffix_dedup, top_k
from llm.common import prepare

DOCS = "doc_id long, text string, source string, size string, row string, kept string, fp string"
WORDS = ["the", "The", "of", "né", "ab", "xyz", "lorem", "ipsum", "日本", "a,b"]


def table(spark, rows, schema=DOCS):
    prepare(spark)
    width = len(schema.split(", "))
    return spark.createDataFrame([(*r, *["clash"] * (width - len(r))) for r in rows], schema).repartition(3)


def documents(seed, n=120):
    random.seed(seed)
    passages = [" ".join(random.choice(WORDS) + str(random.randint(0, 9)) for _ in range(30)) for _ in range(5)]
    rows = []
    for i in range(n):
        text = " ".join(random.choice(WORDS) + str(random.randint(0, 99)) for _ in range(random.randint(0, 60)))
        if random.random() < 0.3:
            at = random.randint(0, 60)
            text = text[:40] + random.choice(passages)[at : at + random.randint(40, 120)] + text[40:]
        if random.random() < 0.15 and rows:
            text = random.choice(rows)[1]
        if random.random() > 0.95:
            text = "ab " * random.randint(10, 100)
        rows.append((i * 3 - 40, text, random.choice(["s1", "s1", "s1", "s2", "ß", None])))
    rows += [(1000, None, "s1"), (1001, "", None), (1002, " \n\t ", "s2"), (1003, "q" * 5000, "s2"), (1004, "the of " * 3000, "new")]
    return rows


ODD = [(None, "the of the", "s1"), (None, "the of the", "s1"), (5, "the of the", "s2"), (5, "the of the", "s2"), (5, "ab", "s1")]


def in_duckdb(sql, rows, schema=DOCS):
    names = [c.split()[0] for c in schema.split(", ")][: len(rows[0])]
    frame = pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", frame)
    return sorted(map(repr, con.sql(sql).fetchall()))


def as_rows(df, columns):
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, seed, monkeypatch):
    rows = [r[:2] for r in documents(seed) + ODD]
    monkeypatch.setattr(suffix_dedup, "BYTES_AT_ONCE", 700)
    owner = {}
    for i, text in rows:
        raw = (text or "").encode()
        for p in range(len(raw) - 49 if i is not None else 0):
            owner[raw[p : p + 50]] = min(owner.get(raw[p : p + 50], i), i)
    want = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - 49 if i is not None else 0):
            if owner[raw[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        want.append(repr((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())))
    got = suffix_dedup.cut_repeats(table(spark, rows))
    assert as_rows(got, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) == sorted(want)


def test_radix_passes_keep_equal_strings_only():
    random.seed(3)
    words = [bytes(random.choice(b"ab") for _ in range(50)) for _ in range(30)]
    picked = [random.choice(words) for _ in range(200)]
    docs = np.array([random.randint(0, 9) for _ in picked])
    data = np.frombuffer(b"".join(picked), dtype=np.uint8)
    same_digit = np.zeros(len(picked), dtype=np.uint64)
    got = suffix_dedup.repeats(data, np.arange(len(picked)) * 50, same_digit, docs)
    first = {w: min(d for x, d in zip(picked, docs) if x == w) for w in picked}
    assert got.tolist() == [bool(d > first[w]) for w, d in zip(picked, docs)]


def test_mixing_equals_sql_and_targets(spark):
    rows = documents(4, 400) + ODD
    got = mixing.shares(table(spark, rows))
    columns = ["doc_id", "size", "source_size", "target", "taken", "copies"]
    assert as_rows(got, columns) == in_duckdb(f"SELECT {', '.join(columns)} FROM ({mixing.SQL})", rows)
    for r in got.collect():
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
    mixed = mixing.mix(table(spark, rows))
    assert mixed.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert mixed.count() == sum(r.copies for r in got.collect())
    by_source = Counter()
    for r in mixed.collect():
        by_source[r.source] += len((r.text or "").encode().split())
    wanted = {r.source: r for r in table(spark, rows).select("doc_id", "source").join(got, "doc_id").collect()}
    for source in ("s1", "s2", "ß"):
        assert abs(by_source[source] - wanted[source].target) <= 0.1 * wanted[source].target + 60


def test_targets_share_out_what_small_sources_leave(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(10, "a"), (500, "b"), (500, "c"), (20, None)])]
    got = {r.doc_id: r.target for r in mixing.shares(table(spark, rows)).collect()}
    # Weights 1, 2, 3, 1 of 1030; a (30) and null (60) stop at three times their size, 940 go to b and c by 2 to 3.
    assert got == pytest.approx({0: 30, 3: 60, 1: 376, 2: 564})


def test_exact_dedup(spark):
    rows = documents(5) + ODD
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got = exact_dedup.marked(table(spark, rows))
    assert as_rows(got, columns) == in_duckdb(f"SELECT {', '.join(columns)} FROM ({exact_dedup.SQL})", rows)
    left = exact_dedup.deduplicate(table(spark, rows))
    assert left.columns == [c.split()[0] for c in DOCS.split(", ")]
    best = {}
    for i, text, _ in rows:
        best[text or ""] = max(best.get(text or "", -(10**9)), -(10**9) if i is None else i)
    assert sorted((r.text or "", r.doc_id) for r in left.collect()) == sorted(best.items())


@pytest.mark.parametrize("historical", ["true", "false", "doc_id > 50"])
def test_exact_dedup_does_not_depend_on_the_history(spark, historical):
    from pyspark.sql import functions as F

    docs = table(spark, documents(6))
    columns = ["doc_id", "keep_id", "group_size"]
    assert as_rows(exact_dedup.marked(docs, F.expr(historical)), columns) == as_rows(exact_dedup.marked(docs), columns)


def test_perfect_hash_is_minimal_and_rejects_others():
    digests = b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000))
    words = exact_dedup._words(digests)
    built = exact_dedup.PerfectHash.build(words[:3000])
    slots = built.slots(words[:3000])
    assert sorted(slots.tolist()) == list(range(3000))
    stored = np.empty_like(words[:3000])
    stored[slots] = words[:3000]
    others = built.slots(words[3000:])
    hit = others >= 0
    assert not (stored[others[hit]] == words[3000:][hit]).all(axis=1).any()


def test_bpe_equals_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    random.seed(7)
    pieces = ["a", "é", " ", "  ", "\n", "'s", "'ll", "12", "!!", "<|endoftext|>", "　", "日本", "🙂", "\x00", "th", "zzzz", "\t", "Ⴀ", "\x1c"]
    rows = documents(8, 30) + [(i, "".join(random.choice(pieces) for _ in range(random.randint(0, 80)))) for i in range(300, 500)]
    rows += [(None, "x" * 3000), (1, "z" * 40 + " 'tis"), (1, "z" * 40 + " 'tis")]
    docs = table(spark, [r[:2] for r in rows])
    want, ids = [], {}
    for i, text, *_ in rows:
        found = library.encode(text or "", add_special_tokens=False).ids
        ids[text or ""] = found
        decoded = library.decode(found, skip_special_tokens=False)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append(repr((i, len(found), sha(",".join(map(str, found))), sha(decoded))))
    assert as_rows(bpe.digests(docs, path), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == sorted(want)
    encoded = bpe.encode(docs, path)
    assert sorted(map(tuple, (r.ids for r in encoded.collect()))) == sorted(tuple(ids[t or ""]) for _, t, *_ in rows)
    assert as_rows(bpe.decode(encoded, path), ["text"]) == sorted(repr((t or "",)) for _, t, *_ in rows)


def test_bpe_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 50)
    monkeypatch.setattr(bpe, "GROUP", 200)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, mine = Tokenizer.from_file(path), bpe.Vocabulary(bpe._content(path))
    texts = ["word  two\n three " * 100, "", "x" * 500, "a b " * 300 + "<|endoftext|>" + "c d " * 100]
    for text, (n, ids, _) in zip(texts, mine.digests(texts)):
        found = library.encode(text, add_special_tokens=False).ids
        assert (n, ids) == (len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest())


def test_forced_cuts_never_stand_inside_a_token():
    mine = bpe.Vocabulary(bpe._content(public_tokenizers.path("byte_bpe_50k.json")))
    assert not mine.joined.all() and mine.joined.any()
    for token in random.Random(1).sample(sorted(mine.bytes_of.values()), 500):
        if token != b"<|endoftext|>":
            assert mine._cuts(np.frombuffer(token, dtype=np.uint8)).sum() == 1


def test_top_k(spark):
    random.seed(9)
    rows = [(i, [random.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    rows += [(i + 1000, rows[5][1]) for i in range(30)] + [(500, None), (600, [1.0, None]), (700, [float("nan")] * 8), (800, [float("inf")])]
    rows += [(900, []), (901, [2.0]), (None, [1.0] * 8), (7, rows[7][1]), (-100, [1e3] * 8)]
    rows += [(8, [2.0] * 8), (100, [1.0] * 8), (200, rows[200][1])] + [(9, [9e2] * 8)] * 14  # equal ids: other vectors, repeats
    prepare(spark)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int").repartition(2)
    held = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole = np.floor(1024 * np.array(v, dtype=np.float32).astype(np.float64)).astype(np.int64)
            held.append((i, np.pad(whole, (0, 8 - len(whole)))))
    want = []
    for q in sorted({i for i, _ in held if i % 100 == 0}):
        scored = sorted((-int(asked @ v), i) for own, asked in held if own == q for i, v in held if i != q)[:10]
        want += [repr((q, r + 1, i, -s)) for r, (s, i) in enumerate(scored)]
    import llm.top_k as module

    for size in (64, 8192):
        module.SHARD_VECTORS = size
        assert as_rows(top_k.search(df), ["query_id", "rank", "vec_id", "score"]) == sorted(want)


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_components(rows):
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for a, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return [(i, f"{prints[a]:016x}", least.get(find(a))) for a, (i, *_) in enumerate(rows)]


def test_simhash(spark):
    random.seed(10)
    rows = documents(11, 80) + ODD
    base = " ".join(random.choice(WORDS) + str(random.randint(0, 99)) for _ in range(60)).split()
    for i in range(60):
        words = list(base)
        for _ in range(random.randint(0, 2)):
            words[random.randrange(len(words))] = f"edit{i}"
        rows.append((2000 + i, " ".join(words), "s1"))
    want = plain_components(rows)
    assert as_rows(simhash.components(table(spark, rows)), ["doc_id", "fingerprint", "component_id"]) == sorted(map(repr, want))
    kept = simhash.thin_out(table(spark, rows))
    assert sorted(repr((r.doc_id, r.text or "")) for r in kept.collect()) == sorted(map(repr, plain_thinned(rows)))


def plain_thinned(rows):
    """Of every component the row with the smallest id (null last), then the smallest digest."""
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    groups = []
    for i, value in enumerate(prints):
        near = [g for g in groups if any((value ^ prints[j]).bit_count() <= 3 for j in g)]
        groups = [g for g in groups if g not in near] + [[i, *(j for g in near for j in g)]]
    best = lambda i: (rows[i][0] is None, rows[i][0] or 0, hashlib.sha256((rows[i][1] or "").encode()).digest())
    return [(rows[i][0], rows[i][1] or "") for i in (min(g, key=best) for g in groups)]


def test_thinning_keeps_a_row_of_every_component(spark):
    texts = ["one two three four", "five six seven eight", "nine ten eleven twelve", None, "thirteen fourteen fifteen sixteen"]
    rows = [(7, texts[0], "a"), (7, texts[1], "b"), (None, texts[2], "c"), (None, texts[3], "d"), (None, texts[4], "e"), (9, texts[0], "f"), (7, texts[0], "a")]
    kept = simhash.thin_out(table(spark, rows)).collect()
    assert sorted(repr((r.doc_id, r.text, r.source)) for r in kept) == sorted(map(repr, [rows[i] for i in (0, 1, 2, 3, 4)]))


def test_simhash_forest_links_what_all_pairs_link():
    random.seed(12)
    values = {random.getrandbits(12) << 40 for _ in range(300)}
    rows = [(v, None) for v in sorted(values)]
    heads, tails = simhash._forest(np.array(sorted(values), dtype=np.uint64))
    root = {v: v for v, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(np.concatenate(heads).tolist(), np.concatenate(tails).tolist()):
        assert (a ^ b).bit_count() <= 3
        root[find(a)] = find(b)
    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 3:
                assert find(a) == find(b)


def test_position_blocks_survive_any_three_bytes():
    from itertools import combinations

    blocks = simhash.position_blocks()
    assert len(blocks) == 14 and all(any(not set(t) & set(b) for b in blocks) for t in combinations(range(8), 3))


def test_empty_tables(spark):
    prepare(spark)
    docs = spark.createDataFrame([], DOCS)
    assert suffix_dedup.cut_repeats(docs).collect() == []
    assert mixing.shares(docs).collect() == [] and mixing.mix(docs).collect() == []
    assert exact_dedup.marked(docs).collect() == [] and exact_dedup.deduplicate(docs).collect() == []
    assert bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json")).collect() == []
    assert simhash.components(docs).collect() == [] and simhash.thin_out(docs).collect() == []
    assert top_k.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
