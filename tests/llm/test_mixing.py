import math
from collections import Counter

import pytest

from drivetrace.llm import mixing
from drivetrace.llm.queries import op6_temperature_mixing

KIND = "doc_id long, text string, source string, n_chars long, block int, epoch int, total string"


def corpus(spark, extra=()):
    rows = [(i, "word " * (1 + i % 7), "big" if i % 3 else ("mid" if i % 2 else "small"), 1, 1, 1, "x") for i in range(600)]
    return spark.createDataFrame([*rows, *extra], KIND)


ODD = [(9001, None, "big", 1, 1, 1, "x"), (9002, "a b c", None, 1, 1, 1, "x"), (None, "a b", "mid", None, 1, 1, "x"), (5, "one two", "mid", 1, 1, 1, "x"),
       (5, "one two", "mid", 1, 1, 1, "x"), (9003, " ", "empty", 1, 1, 1, "x"), (9004, "x " * 5000, "big", 1, 1, 1, "x")]


def shares(rows):
    total = Counter()
    for r in rows:
        total[r.source] += len((r.text or "").split())
    whole = sum(total.values())
    return total, {s: n / whole for s, n in total.items() if n}


def brute_exponent(p, entropy, repeats, budget_share=1.0):
    def h(t):
        z = sum(x**t for x in p.values())
        return -sum(x**t / z * math.log(x**t / z) for x in p.values())

    def passes(t):
        z = sum(x**t for x in p.values())
        return max(x ** (t - 1) for x in p.values()) / z * budget_share

    def last(ok, lo=0.0, hi=1.0):
        if ok(hi):
            return hi
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if ok(mid) else (lo, mid)
        return lo

    found = 1.0 if entropy is None else last(lambda t: h(t) >= entropy * math.log(len(p)))
    if repeats is not None:
        limit = 1 - last(lambda u: passes(1 - u) <= repeats) if passes(1) <= repeats else 1.0
        found = max(found, limit) if entropy is not None else limit
    return found


@pytest.mark.parametrize("entropy,repeats", [(0.95, None), (1.0, 1.4), (None, 1.3), (None, 0.5), (0.2, 4.0), (None, None)])
def test_weights(spark, entropy, repeats):
    docs = corpus(spark, ODD)
    total, p = shares(docs.collect())
    t = brute_exponent(p, entropy, repeats)
    z = sum(x**t for x in p.values())
    got = {r.source: r for r in mixing.weights(mixing.counted(docs), entropy, repeats).collect()}
    assert {s: r.total for s, r in got.items()} == dict(total) | {"empty": 0}
    for s, x in p.items():
        assert got[s].weight == pytest.approx(x**t / z, abs=1e-5)
    assert got["empty"].weight == 0


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_readings(spark, block):
    docs = corpus(spark, ODD)
    budget = 9000
    parts = {r.source: r for r in mixing.weights(mixing.counted(docs), 0.99, 9.0, budget).collect()}
    plan = mixing.mixture(docs, 0.99, 9.0, budget, block_tokens=block).collect()
    have = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in docs.collect())
    spent, longest = Counter(), Counter()
    for r in docs.collect():
        longest[r.source] = max(longest[r.source], len((r.text or "").split()))
    for source, part in parts.items():
        mine = [r for r in plan if r.source == source]
        if part.target <= 0:
            assert not mine
            continue
        passes = part.target // part.total
        for e in range(passes):
            assert Counter((r.doc_id, r.source, r.tokens) for r in mine if r.epoch == e) == Counter({k: n for k, n in have.items() if k[1] == source})
        spent[source] = sum(r.tokens for r in mine)
        assert part.target - longest[source] < spent[source] <= part.target
        assert max(r.epoch for r in mine) <= passes
        by_block = Counter((r.epoch, r.block) for r in mine)
        places = {k: sorted(r.place for r in mine if (r.epoch, r.block) == k) for k in by_block}
        assert all(p == list(range(1, len(p) + 1)) for p in places.values())
        assert all(0 <= r.progress < 1 for r in mine)
    orders = [[r.doc_id for r in sorted(plan, key=lambda r: (r.block, r.place)) if r.source == "small" and r.epoch == e] for e in (0, 1)]
    assert orders[0] != orders[1] and sorted(orders[0]) == sorted(orders[1])


def test_mixed_rows(spark):
    """Every reading is a row, and rows come in the order of the readings."""
    docs = corpus(spark, ODD)
    docs = docs.union(docs.where("doc_id % 4 = 1")).union(docs.where("doc_id % 8 = 1"))
    for options in ({}, {"budget": 700, "block_tokens": 64}, {"budget": 30}):
        plan = mixing.mixture(docs, **options).collect()
        rows = mixing.mixed(docs, **options)
        assert rows.columns == docs.columns
        got = [(r.doc_id, r.source, len((r.text or "").split())) for r in rows.collect()]
        assert Counter(got) == Counter((r.doc_id, r.source, r.tokens) for r in plan)
        at = {}
        for r in sorted(plan, key=lambda r: (r.progress, r.block, r.place)):
            at.setdefault((r.doc_id, r.source, r.tokens), []).append(r.progress)
        progress = [at[k].pop(0) for k in got]
        assert progress == sorted(progress)


def test_budget_in_the_midst_of_equal_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 1, 1, 1, "x")] * 5, KIND)
    assert mixing.mixture(docs, budget=7).count() == mixing.mixed(docs, budget=7).count() == 2


def test_any_column_names(spark):
    names = ["_h", "_d", "_s", "_text_hash", "_id", "_source", "id", "row", "name", "absent", "copy", "progress", "block", "r", "p", "e"]
    rows = [(n, f"text number {n}", "s" if n % 3 else None, *names) for n in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in names))
    got = mixing.mixed(docs, entropy=None, repeats=None)
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))


def test_no_rows(spark):
    none = spark.createDataFrame([], KIND)
    assert mixing.mixture(none).count() == 0 and mixing.mixed(none).count() == 0
    assert mixing.mixture(spark.createDataFrame([ODD[0]], KIND)).count() == 0


def test_query_on_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    total, p = shares(docs.collect())
    t = brute_exponent(p, 0.9, 4.0)
    z = sum(x**t for x in p.values())
    whole = sum(total.values())
    spent = Counter()
    for r in op6_temperature_mixing(spark, sf_dir).collect():
        spent[r.source] += r.tokens
    longest = max(len(r.text.split()) for r in docs.collect())
    for s, x in p.items():
        assert abs(spent[s] - x**t / z * whole) <= longest + 2
