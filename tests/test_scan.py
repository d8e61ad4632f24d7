import random

from pyspark.sql import functions as F

from galley import compose
from galley.scan import Step, following, last, prev, remaining_min, running_max, running_sum, scan
from tests.conftest import rows


def test_scan_equals_brute_force(spark, blocks):
    rng = random.Random(7)
    data = [(d, i, rng.choice([None, rng.randint(0, 9)])) for d in (1, 2, 3) for i in range(0, 40 if d == 1 else 5)]
    df = spark.createDataFrame(data, "d long, i int, v int")
    out = scan(
        df, ["d"], ["i"], p=prev(F.col("v")), l=last(F.col("v")), n=following(F.col("v")), s=running_sum(F.col("v")),
        m=running_max(F.col("v")), lo=remaining_min(F.col("v")), b=Step("max", F.col("v")),
    )
    for r in out.collect():
        own = [(i, v) for d, i, v in data if d == r.d and v is not None]
        before = [v for i, v in own if i < r.i]
        upto = [v for i, v in own if i <= r.i]
        after = [v for i, v in own if i > r.i]
        assert r.p == (before[-1] if before else None)
        assert r.l == (upto[-1] if upto else None)
        assert r.n == (after[0] if after else None)
        assert r.s == sum(upto)
        assert r.m == (max(upto) if upto else None)
        assert r.b == (max(before) if before else None)
        assert r.lo == (min(after) if after else None)


def _check_ranged(spark, data, order):
    names = ["d", *order, "v"]
    df = spark.createDataFrame(data, ", ".join(f"{n} long" for n in names))
    out = scan(
        df, ["d"], order, ranged=True, p=prev(F.col("v")), n=following(F.col("v")), s=running_sum(F.col("v")), m=running_max(F.col("v"))
    ).collect()
    assert len(out) == len(data)
    for r in out:
        own = sorted((row[1:-1], row[-1]) for row in data if row[0] == r.d)
        here = tuple(r[c] for c in order)
        upto = [v for at, v in own if at <= here and v is not None]
        before = [v for at, v in own if at < here and v is not None]
        after = [v for at, v in own if at > here and v is not None]
        assert (r.p, r.n) == (before[-1] if before else None, after[0] if after else None)
        assert (r.s, r.m) == (sum(upto), max(upto) if upto else None)


def test_ranged_scan_over_hash_order(spark):
    rng = random.Random(8)
    _check_ranged(spark, [(d, rng.getrandbits(48), rng.choice([None, 1, 5, 9])) for d in (1, 1, 1, 2) for _ in range(60)], ["at"])


def test_ranged_scan_with_all_rows_in_one_place(spark):
    rng = random.Random(9)
    _check_ranged(spark, [(1, 0, i, rng.choice([None, 2, 3])) for i in rng.sample(range(10**6), 150)], ["place", "seq"])


def test_ranged_scan_uses_several_blocks(spark):
    from galley import scan as module

    seen = []
    staged = module.stage
    module.stage = lambda df, label: seen.append(staged(df, label)) or seen[-1]
    try:
        scan(spark.range(400).selectExpr("1 AS d", "id * 7919 AS at"), ["d"], ["at"], ranged=True, s=running_sum(F.lit(1)))
    finally:
        module.stage = staged
    assert seen[0].select("_block").distinct().count() > 1

def test_composed_choices_equal_the_plain_walk(spark):
    random.seed(8)
    items, want = [], []
    for key in (1, 2, 3):
        state = 0
        for place in sorted(random.sample(range(3000), 200 if key == 1 else 3)):
            pages = sorted(random.sample(range(1, 60), random.randint(1, 9)))
            items.append((key, place, pages, pages))
            want.append((key, place, state))
            state = min((p for p in pages if p >= state), default=state)
    table = spark.createDataFrame(items, "doc_id long, place long, upto array<long>, gives array<long>").repartition(3)
    for width in (4, 37, 256, 5000):
        assert rows(compose.states_before(table, "doc_id", 0, width).select("doc_id", "place", "before")) == sorted(want, key=repr)
    assert compose.states_before(table.limit(0), "doc_id", 0).collect() == []


def test_blocks_are_composed_many_at_a_time_and_may_span_batches(spark, monkeypatch):
    """One Python call a key cost a hundred times the work; a block that a batch cuts is still one block."""
    data = [(d, p, [p % 7 + d, p + 1], [p % 7 + d, p + 1]) for d in range(5) for p in range(0, 40, 1 + d)]
    table = spark.createDataFrame(data, "doc_id long, place long, upto array<long>, gives array<long>")
    want = []
    for d in range(5):
        state = 0
        for _, place, upto, _ in sorted(r for r in data if r[0] == d):
            want.append((d, place, state))
            state = next((u for u in upto if u >= state), state)
    monkeypatch.setattr(compose, "stage", lambda df, label: df)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for width in (4, 8, 64):
            got = compose.states_before(table, "doc_id", 0, width)
            assert "FlatMap" not in got._jdf.queryExecution().toString()
            assert rows(got) == sorted(want, key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
