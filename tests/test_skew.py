"""Per-key results against brute force, with hot keys, hot pairs and nulls."""

import random
from collections import defaultdict

import pytest

from quadrille.operators import skew


def brute(rows):
    n, vals = defaultdict(int), defaultdict(dict)
    for k, c, v in rows:
        n[k] += 1
        if c is not None:
            vals[k][c] = max(vals[k].get(c, 0), v or 0)
    return {(k, n[k], len(vals[k]), sum(vals[k].values())) for k in n}


@pytest.mark.parametrize("seed,width", [(1, 1), (2, 8), (3, 40)])
def test_against_brute_force(spark, seed, width):
    rng = random.Random(seed)
    rows = []
    for _ in range(4000):
        k = rng.choice(["hot"] * 6 + [f"k{i}" for i in range(30)] + [None])
        c = "same" if rng.random() < 0.3 else rng.choice([f"c{i}" for i in range(200)] + [None])
        rows.append((k, c, rng.choice([None, *range(50)])))
    d = spark.createDataFrame(rows, "k string, c string, v long").repartition(5)
    assert {tuple(r) for r in skew.per_key(d, "k", "c", value="v", width=width).collect()} == brute(rows)


def test_a_heavy_key_is_split(spark):
    d = spark.range(40000).selectExpr("IF(id % 10 < 9, 'hot', CAST(id AS STRING)) AS k", "'same' AS c")
    states = skew.partial_states(d, "k", "c", width=16)
    hot = [r.n for r in states.where("k = 'hot'").collect()]
    assert len(hot) >= 12 and max(hot) < 2 * 40000 / 16
    got = skew.per_key(d, "k", "c", width=16).where("k = 'hot'").first()
    assert (got.n, got.runs) == (36000, 1)


def test_hot_keys_and_empty(spark):
    d = spark.createDataFrame([("a",)] * 5 + [(None,)] * 94 + [("b",)] * 1, "k string")
    assert [tuple(r) for r in skew.hot_keys(d, "k", 0.05).collect()] == [("a", 5)]
    assert skew.per_key(d.limit(0), "k", "k").collect() == []
    assert skew.hot_keys(d.limit(0), "k", 0.05).collect() == []


def test_other_types_and_clashing_names(spark):
    d = spark.createDataFrame([(1, 10, 4), (1, 10, 9), (1, 11, None), (2, None, 3)], "n long, part long, runs long")
    got = {tuple(r) for r in skew.per_key(d, "n", "part", value="runs").collect()}
    assert got == {(1, 3, 2, 9), (2, 1, 0, 0)}
