"""Bitmaps of presence and as-of joins in blocks against plain Python."""

import random

import pytest

from panelwise.operators import clean, joins, lags, presence

from .helpers import rows


def test_measures_of_dense_sparse_and_long_runs(spark):
    dice = random.Random(7)
    have = {"dense": set(range(-70, 300)), "edge": set(range(64, 128)) | {130}, "gap": set(range(0, 64)) | set(range(128, 192)), "one": {5}, None: {1, 2, 63, 64, 65}}
    have |= {f"r{k}": {x for x in range(400) if dice.random() < (k + 1) / 8} for k in range(7)}
    facts = [(k, x, "x") for k, xs in have.items() for x in xs for _ in range(1 + x % 3)] + [("one", None, "x")]
    df = spark.createDataFrame(facts, "k string, qi long, seen string").repartition(5)
    got = {(r.k, r.qi): tuple(r)[2:] for r in presence.presence_measures(presence.presence(df, ["k"]), ["k"], (1, 5, 64, 65, 130)).collect()}
    want = {}
    for k, xs in have.items():
        for n, x in enumerate(sorted(xs)):
            run = next(i for i in range(1, 500) if x - i not in xs)
            want[k, x] = (n + 1, run, *(sum(x - i in xs for i in range(t)) for t in (1, 5, 64, 65, 130)))
    assert got == want


def test_one_aggregate_gives_what_the_windows_give(spark):
    dice = random.Random(8)
    df = spark.createDataFrame([(f, q) for f in range(12) for q in range(90) if dice.random() < 0.6], "f int, qi int")
    m = presence.presence_measures(presence.presence(df, ["f"]), ["f"], (4,))
    assert rows(m, "f", "qi", "held_4") == rows(lags.held_count(df, ["f"], 4), "f", "qi", "held")
    assert rows(m, "f", "qi", "run") == rows(lags.run_length(df, ["f"]), "f", "qi", "run")
    assert rows(m.selectExpr("f", "qi", "held_4 = 4")) == rows(lags.feasible(df, ["f"], 4), "f", "qi", "feasible")
    for consecutive in (False, True):
        assert rows(presence.with_history(df, ["f"], 3, consecutive=consecutive)) == rows(clean.min_history(df, ["f"], 3, consecutive=consecutive))
    assert presence.covered(df.limit(0), ["f"], 3).count() == 0


@pytest.mark.parametrize("width", [1, 10, 1000, None])
def test_asof_join_in_blocks(spark, width):
    dice = random.Random(9)
    left = [(dice.choice(["a", "b", "c", None]), dice.randint(0, 300), i) for i in range(200)] + [("a", None, 900)]
    right = [(dice.choice(["a", "b", None]), dice.randint(20, 280), float(i) if i % 5 else None, "x") for i in range(60)] + [("a", 50, 7.5, "x"), ("a", 50, 3.5, "x")]
    got = joins.asof_join(spark.createDataFrame(left, "k string, t int, i int"), spark.createDataFrame(right, "k string, t int, v double, other string"), ["k"], "t", "v", width=width)
    want = []
    for k, t, i in left:
        past = [(b, v) for a, b, v, _ in right if a == k and v is not None and t is not None and b <= t]
        at, v = max(past) if past else (None, None)
        want.append((k, t, i, v, at))
    assert rows(got, "k", "t", "i", "v", "v_date") == sorted(want, key=repr)
    assert got.columns[:3] == ["k", "t", "i"]


def test_past_rates_count_strictly_earlier_periods(spark):
    data = [("a", 1, 1), ("a", 1, 0), ("a", 2, None), ("a", 4, 1), (None, 1, 1), (None, 3, 0), ("b", 2, 1)]
    got = lags.past_rates(spark.createDataFrame(data, "k string, qi int, hit int"), ["k"], ["hit"])
    assert rows(got, "k", "qi", "hit_n", "hit_rate") == sorted([("a", 1, 0, None), ("a", 1, 0, None), ("a", 2, 2, 0.5), ("a", 4, 2, 0.5), (None, 1, 0, None), (None, 3, 1, 1.0), ("b", 2, 0, None)], key=repr)
