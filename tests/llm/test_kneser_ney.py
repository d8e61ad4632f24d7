"""The language model against a plain dictionary version."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from llm import kneser_ney
from llm.common import crc_mod, prepare

FIELDS = "doc_id long, text string, n_tokens string"


def tokens(text):
    raw = (text or "").encode()
    return [w.lower() for w in raw.split()] + [None]


def plain(rows, held):
    """Per row (n_tokens, n_known, train_tokens, base, score), and the sum of p over the vocabulary after one word."""
    train = [tokens(t) for (i, t) in rows if not held(i)]
    c = Counter(w for d in train for w in d)
    big = Counter(b for d in train for b in zip(["<s>", *d], d))
    n, v = sum(c.values()), len(c)
    upper = kneser_ney.discounts([sum(x == k for x in big.values()) for k in range(1, 5)])
    before = Counter(w for _, w in big)
    lower = kneser_ney.discounts([sum(x == k for x in before.values()) for k in range(1, 5)])
    follow, kinds = Counter(), defaultdict(lambda: [0, 0, 0])
    for (u, _), x in big.items():
        follow[u] += x
        kinds[u][min(x, 3) - 1] += 1
    rest = sum(lower[min(x, 3) - 1] for x in before.values()) / len(big) if big else 1.0

    def low(w):
        x = before[w]
        return (x - lower[min(x, 3) - 1] if x else 0) / max(1, len(big)) + rest / (v + 1)

    def p(u, w):
        if u not in follow:
            return low(w)
        x = big[u, w]
        back = sum(a * b for a, b in zip(kinds[u], upper)) / follow[u]
        return (x - upper[min(x, 3) - 1] if x else 0) / follow[u] + back * low(w)

    if c:
        assert math.isclose(sum(p("<s>", w) for w in c) + p("<s>", "new word"), 1, rel_tol=1e-9)
    out = []
    for _, t in rows:
        d = tokens(t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in d)
        out.append((len(d), sum(c[w] > 0 for w in d), n, base, sum(math.log10(p(u, w)) for u, w in zip(["<s>", *d], d))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_equal_the_plain_model(spark, seed):
    random.seed(seed)
    vocabulary = ["the", "The", "of", "é", "a", "b", "x" * 40, "İ", "end.", "1"] + [f"w{i}" for i in range(30)]
    rows = [
        (i, " \t\n".join(random.choice(vocabulary) for _ in range(random.randint(0, 30)))) for i in range(60)
    ]
    rows += [(1000, None), (1001, ""), (1002, "  \n "), (None, "the of"), (7, "the the"), (7, rows[7][1]), (1003, "the " * 5000)]
    prepare(spark)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], FIELDS).repartition(3)
    held_out = crc_mod(7) == 2
    model = kneser_ney.train(docs.where(~held_out))
    got = kneser_ney.scores(docs, model, held_out).collect()

    def held(i):
        return crc32(("" if i is None else str(i)).encode()) % 7 == 2

    want = [(i, held(i), *x) for (i, _), x in zip(rows, plain(rows, held))]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-6)


def test_empty_table(spark):
    prepare(spark)
    docs = spark.createDataFrame([], FIELDS)
    assert kneser_ney.scores(docs, kneser_ney.train(docs), F.lit(False)).collect() == []


def test_nothing_to_learn_from(spark):
    prepare(spark)
    docs = spark.createDataFrame([(1, "a b", "x")], FIELDS)
    row = kneser_ney.scores(docs, kneser_ney.train(docs.where("false")), F.lit(True)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def plain_score(train, texts, order):
    """Sum of log10 p of each text by a plain model of this order; probabilities after a history add up to one."""
    grams = {order: Counter()}
    for d in map(tokens, train):
        padded = ["<s>"] * (order - 1) + d
        grams[order].update(tuple(padded[i : i + order]) for i in range(len(d)))
    for n in range(order - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    cut = {n: kneser_ney.discounts([sum(x == k for x in c.values()) for k in range(1, 5)]) for n, c in grams.items()}
    follow, left = Counter(), Counter()
    for n, c in grams.items():
        for g, x in c.items():
            follow[n, g[:-1]] += x
            left[n, g[:-1]] += cut[n][min(x, 3) - 1]
    words = {g[0] for g in grams[1]}

    def p(h, w):
        lower = p(h[1:], w) if h else 1 / (len(words) + 1)
        n = len(h) + 1
        if not follow[n, h]:
            return lower
        x = grams[n][(*h, w)]
        return ((x - cut[n][min(x, 3) - 1] if x else 0) + left[n, h] * lower) / follow[n, h]

    for h in [("<s>",) * (order - 1), next(iter(grams[order]))[:-1]]:
        assert math.isclose(sum(p(h, w) for w in words) + p(h, "new word"), 1, rel_tol=1e-9)
    out = []
    for d in map(tokens, texts):
        padded = ["<s>"] * (order - 1) + d
        out.append(sum(math.log10(p(tuple(padded[i : i + order - 1]), w)) for i, w in enumerate(d)))
    return out


@pytest.mark.parametrize("order", [3, 4])
def test_higher_orders_equal_the_plain_model(spark, order):
    random.seed(order)
    vocabulary = ["the", "of", "é", "a", "b"] + [f"w{i}" for i in range(12)]
    texts = [" ".join(random.choice(vocabulary) for _ in range(random.randint(0, 40))) for _ in range(80)] + ["", "the of " * 900, "new words here"]
    prepare(spark)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], FIELDS).repartition(3)
    held_out = F.col("doc_id") % 4 == 1
    model = kneser_ney.train(docs.where(~held_out), order)
    got = {r.doc_id: r.score for r in kneser_ney.scores(docs, model, held_out).collect()}
    want = plain_score([t for i, t in enumerate(texts) if i % 4 != 1], texts, order)
    assert len(got) == len(want) and all(math.isclose(got[i], x, rel_tol=1e-6) for i, x in enumerate(want))


def test_the_registered_query_is_of_order_three(spark):
    assert kneser_ney.ORDER >= 3
    empty = spark.createDataFrame([], FIELDS)
    assert kneser_ney.train(empty, kneser_ney.ORDER).order == kneser_ney.ORDER


def _zipf(rows, seed=5):
    random.seed(seed)
    return [(i, " ".join(f"w{int(random.paretovariate(0.8))}" for _ in range(random.randint(0, 400)))) for i in range(rows)]


def test_counting_and_asking_at_once_gives_the_scores_of_the_model(spark):
    prepare(spark)
    docs = spark.createDataFrame([*_zipf(60), (None, None), (7, "w1 w2 new")], "doc_id long, text string").repartition(3)
    held_out = crc_mod(7) == 2
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    at_once = sorted(map(tuple, kneser_ney.split_scores(docs, held_out, 3).collect()), key=key)
    model = kneser_ney.train(docs.where(~held_out), 3)
    apart = sorted(map(tuple, kneser_ney.scores(docs, model, held_out).collect()), key=key)
    assert len(at_once) == len(apart) == 62
    for a, b in zip(at_once, apart):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)


def test_an_ngram_is_sent_in_few_bytes(spark):
    """Three 48-bit hashes and a count took 19."""
    prepare(spark)
    docs = spark.createDataFrame(_zipf(400), "doc_id long, text string").coalesce(1)
    rows = docs.selectExpr("doc_id", "false AS held_out", "true AS train", "true AS asked", "text")
    portions = kneser_ney._portions(rows).localCheckpoint()
    numbered = kneser_ney._numbered(portions, 2).where(F.col("kind") == kneser_ney.ANSWER)
    coded = kneser_ney._coded(portions, numbered, 2)
    sent = kneser_ney._sent(coded, 3, 3, 2, kneser_ney.frequent(coded, 3)).collect()
    assert sum(len(r.blob) for r in sent) < 8 * sum(len(kneser_ney._unpacked(r.blob)[2]) for r in sent)


def test_numbers_too_large_for_one_sort_are_told_apart():
    import numpy as np

    x = np.array([1 << 63, 5, (1 << 63) + 1, 5, 1 << 63], dtype=np.uint64)
    keys, first, place = kneser_ney._distinct(x)
    assert keys.tolist() == [5, 1 << 63, (1 << 63) + 1] and first.tolist() == [1, 0, 2] and keys[place].tolist() == x.tolist()
    rows = [np.array([1 << 40, 3, 1 << 40, 3], dtype=np.uint64), np.array([2, 1 << 41, 2, 0], dtype=np.uint64)]
    assert kneser_ney._distinct(kneser_ney._key(rows))[2].tolist() == [2, 1, 2, 0]
    assert kneser_ney._numbers(kneser_ney._planes(x)).tolist() == x.tolist()
