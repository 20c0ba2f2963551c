"""Distinct counts against brute force; runs round trip and merge."""

import datetime as dt
import random
from collections import defaultdict
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrille.llm import distinct_runs as R

SCHEMA = "t date, p string, src_file string, s string, o string, n int"


def brute(rows):
    seen = defaultdict(set)
    dims = ("t", "p", "src_file")
    for t, p, f, s, o, _ in rows:
        for k in (1, 2, 3):
            for c in combinations(range(3), k):
                g = tuple(x if i in c else None for i, x in enumerate((t, p, f)))
                for field, x in (("s", s), ("o", o)):
                    if x is not None:
                        seen[(",".join(dims[i] for i in c), *g, field)].add(x)
    return {k: len(v) for k, v in seen.items()}


def some(seed, n=3000):
    rng = random.Random(seed)
    day = lambda: rng.choice([None, dt.date(1, 1, 1), *[dt.date(2022, 1, 1)] * 6, *[dt.date(2022, 1, i) for i in range(1, 9)]])
    return [(day(), rng.choice(["a", "a", "a", "b", None]), rng.choice(["f", "g", None]), rng.choice(["hot", "hot", None, str(rng.randrange(500))]), rng.choice([None, str(rng.randrange(40))]), 1) for _ in range(n)]


def counted(df, width=None):
    return {(r.dims, r.t, r.p, r.src_file, r.field): r.n_distinct for r in R.count_runs(df, width).collect()}


def test_against_brute_force(spark):
    rows = some(1)
    d = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert counted(R.build_runs(d)) == brute(rows)


def test_partial_results_merge(spark, tmp_path):
    """Stored with different widths and different hot days, they give the counts of all rows."""
    rows = sorted(some(2), key=lambda r: (r[0] is None, r[0] or dt.date.max, str(r)))
    halves = [rows[:1200] + rows[2500:], rows[1000:2600]]
    for i, (h, width) in enumerate(zip(halves, (3, 16))):
        d = spark.createDataFrame(h, SCHEMA)
        assert R._cut(R._by_day(d), width, 300)[1]
        R.build_runs(d, width, 300).write.parquet(str(tmp_path / f"r{i}"))
    a, b = (spark.read.parquet(str(tmp_path / f"r{i}")) for i in (0, 1))
    days = [R._cut(R._by_day(spark.createDataFrame(h, SCHEMA)), 3, 300)[1] for h in halves]
    assert days[0] != days[1]
    for width, window in ((None, None), (1, 50), (16, 1000)):
        assert counted(R.merge_runs(a, b, width, window), width) == brute(rows)
        assert counted(R.merge_runs(a, a, width), width) == brute(halves[0])
    once = R.merge_runs(a, b, 5)
    assert counted(R.merge_runs(once, b, 7), 7) == brute(rows)
    assert counted(R.merge_runs(a.limit(0), a.limit(0))) == {}


def test_hot_day_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(R, "FLUSH", 500)
    rows = some(3)
    d = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(R, "WINDOW", 200)
    w, hot = R._cut(R._by_day(d), 3, 200)
    assert any(k > 1 for k in hot.values()) and w.parts > 1
    runs = R.build_runs(d, 3, 200)
    assert counted(runs, 3) == brute(rows)
    # no task holds more than a window at once, but for one day's or range's own spread
    sizes = [r.n for r in runs.groupBy("kind", "bucket", "field", "t", "win").agg(F.sum("n").alias("n")).collect()]
    assert max(sizes) <= 2 * 200


def test_tasks_grow_with_the_root():
    assert [R.Width(n, 8).tasks for n in (10, 10**6, 10**8, 10**10)] == [8, 17, 166, 1658]
    assert R.Width(10**10, 8).parts == 6 and R.Width(10**6, 8).parts == 1


def test_bound_and_empty(spark):
    d = spark.createDataFrame(some(4, 500), SCHEMA)
    for r in R.count_runs(R.build_runs(d)).collect():
        assert r.collision_bound == r.n_distinct * (r.n_distinct - 1) / 2.0**65
    assert R.count_runs(R.build_runs(d.limit(0))).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=30), min_size=1, max_size=12))
def test_runs_round_trip(sets):
    runs = [np.array(sorted(x), np.uint64) for x in sets]
    counts = np.array([len(r) for r in runs])
    data, offset = R.encode(np.concatenate(runs), np.cumsum(counts) - counts)
    assert (R.decode(data, offset[:-1], counts) == np.concatenate(runs)).all()
    assert len(data) == offset[-1] <= 9 * counts.sum()
