"""Frequent values against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from quadrille.llm import frequent as Q


def brute(values, share):
    c = Counter(x for x in values if x is not None)
    return {k: v for k, v in c.items() if v >= share * sum(c.values())}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    a = [rng.choice([f"h{min(int(rng.paretovariate(0.7)), 900)}", None, ""]) for _ in range(30000)]
    b = [f"rare{rng.randrange(10**9)}" if rng.random() < 0.8 else rng.choice("xyz") for _ in a]
    d = spark.createDataFrame(list(zip(a, b)), "a string, n string").repartition(7)
    got = Q.frequent(d, ["a", "n"], 0.004).collect()
    for f, vals in (("a", a), ("n", b)):
        want = brute(vals, 0.004)
        assert {r["item"]: r["n"] for r in got if r["field"] == f} == want
        assert all(abs(r["estimate"] - r["n"]) < 0.002 * len(vals) for r in got if r["field"] == f)


def test_threshold_ties_nulls_and_empty(spark):
    d = spark.createDataFrame([("a",)] * 10 + [("b",)] * 10 + [(None,)] * 500 + [(f"c{i}",) for i in range(80)], "x string")
    assert {(r["item"], r["n"]) for r in Q.frequent(d, ["x"], 0.1).collect()} == {("a", 10), ("b", 10)}
    assert Q.frequent(d, ["x"], 0.101).collect() == []
    assert Q.frequent(d.limit(0), ["x"], 0.1).collect() == []
    assert Q.frequent(d.where("x IS NULL"), ["x"], 0.1).collect() == []
    with pytest.raises(ValueError):
        Q.frequent(d, ["x"], 0.0)


def test_sketches_add_up():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**60, 50000, dtype=np.uint64)
    h[:9000] = h[0]
    h[9000:10000] = h[9000]
    a, b, c = (np.zeros(Q.cells(), np.int64) for _ in range(3))
    Q.add(a, h[:20000])
    Q.add(b, h[20000:])
    Q.add(c, h)
    assert (a + b == c).all()
    found, est = Q.descend(c, 0.01 * len(h))
    assert set(found) == {h[0], h[9000]} and abs(est[list(found).index(h[0])] - 9000) < 100


def test_only_bounded_cells_are_shuffled(spark):
    d = spark.range(200000).selectExpr("CAST(id AS STRING) AS x").repartition(4)
    assert Q.sketches(d, ["x"]).count() <= Q.cells()
