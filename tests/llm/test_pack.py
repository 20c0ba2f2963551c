"""Packing: every container within its capacity, every text whole, little room left over."""

import random
from collections import defaultdict

import pytest

from quadrille.llm import pack as P


def expanded(classes, capacity):
    for c in classes:
        items, x = [], c.content
        while x:
            items += [x[0]] * x[1]
            x = x[2]
        assert sum(items) == capacity - c.room <= capacity and c.n > 0
        assert sum(3 * i > capacity for i in items) <= 2
        yield c.n, items


@pytest.mark.parametrize("seed", range(8))
def test_plan(seed):
    rng = random.Random(seed)
    cap = rng.choice([1, 2, 7, 64, 500])
    hist = {s: rng.choice([0, 1, 2, 3, 50, 10**9]) for s in range(cap + 1) if rng.random() < 0.7}
    took = defaultdict(int)
    bins = 0
    for n, items in expanded(P.plan(hist, cap), cap):
        bins += n
        for i in items:
            took[i] += n
    assert dict(took) == {s: n for s, n in hist.items() if s and n}
    total = sum(s * n for s, n in hist.items())
    halves = sum(n for s, n in hist.items() if 2 * s > cap)
    assert bins <= 1.25 * max(-(-total // cap), halves) + 3


def test_texts(spark):
    rng = random.Random(1)
    rows = [(i, " a" * (0 if rng.random() < 0.33 else rng.choice([1, 3, 10, 24, 31, 32, 64, 65, 200])), 5) for i in range(900)]
    rows += [(2000, None, 5), (2001, "", 5), (2001, "", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, container int").repartition(5)
    got = P.pack(d, capacity=64).collect()
    load, pieces = defaultdict(int), defaultdict(list)
    for r in got:
        load[r.container] += r.n_tokens
        pieces[r.doc_id].append((r.piece, r.first_token, r.n_tokens))
    assert max(load.values()) <= 64 and set(load) == set(range(len(load)))
    for i, t, _ in rows[:900]:
        n = len(t) // 2
        want = [(k, 64 * k, min(64, n - 64 * k)) for k in range(max(1, -(-n // 64)))]
        assert sorted(pieces[i]) == want
    assert len(pieces[2001]) == 2
    total = sum(load.values())
    assert len(load) <= 1.03 * total / 64 + 2


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, P.pack(d).collect())) == [(1, 0, 0, 0, 0), (2, 0, 0, 0, 0)]
    assert P.pack(d.limit(0)).collect() == []
    with pytest.raises(ValueError):
        P.pack(d, capacity=0)
