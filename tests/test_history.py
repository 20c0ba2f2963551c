"""Validity periods against plain replay."""

import datetime as dt
import random

import pytest

from quadrille.operators import history as H

D = lambda n: dt.date(2022, 1, 1) + dt.timedelta(days=n)
SCHEMA = "seq long, op string, s string, p string, o string, t date"


def replay(rows):
    """Periods by the definition: of a day the greatest seq decides, then day by day."""
    last = {}
    for seq, op, s, p, o, t in rows:
        if None in (op, s, p, o, t) or op.strip().upper() not in ("INSERT", "DELETE"):
            continue
        k = (s, p, o, t)
        if k not in last or seq > last[k][0]:
            last[k] = (seq, op.strip().upper())
    out, open_ = set(), {}
    for (s, p, o, t), (_, op) in sorted(last.items(), key=lambda x: x[0][3]):
        f = (s, p, o)
        if op == "INSERT":
            open_.setdefault(f, t)
        elif f in open_:
            out.add((*f, open_.pop(f), t))
    return out | {(*f, t, None) for f, t in open_.items()}


def some_log(seed, n=600, days=90):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        op = rng.choice(["INSERT", "DELETE", " insert ", "Delete\t", None, "UPDATE"])
        t = None if rng.random() < 0.02 else D(rng.randrange(days))
        rows.append((i, op, rng.choice(["a", "b", None]), "p", rng.choice("xyz"), t))
    rows += rng.sample(rows, 50)  # delivered again
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("every,full_every", [(10, 2), (182, 4)])
def test_same_as_replay(spark, seed, every, full_every):
    rows = some_log(seed)
    log = spark.createDataFrame(rows, SCHEMA)
    for df in (H.history(log), H.stored_history(log, every, full_every)):
        got = [tuple(r) for r in df.collect()]
        assert len(got) == len(set(got)) and set(got) == replay(rows)


@pytest.mark.parametrize("full_every", [1, 3, 100])
def test_version_from_nearest_full_version(spark, tmp_path, full_every):
    rows = some_log(4)
    path = str(tmp_path / "store")
    H.write_store(spark.createDataFrame(rows, SCHEMA), path, 10, full_every)
    periods = H._folders(spark, f"{path}/changes")
    assert H._folders(spark, f"{path}/full") == periods[full_every::full_every]
    for n in (-1, 0, 9, 10, 45, 89, 500):
        day = D(n)
        want = {(s, p, o, a) for s, p, o, a, b in replay(rows) if a <= day and (b is None or b > day)}
        got = H.read_version(spark, path, day.isoformat(), 10)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
        text = got._jdf.queryExecution().executedPlan().toString()  # the periods to read are picked by folder
        base = max((x for x in periods[full_every::full_every] if x <= H.period_of(day, 10)), default=-(2**31))
        assert f"<= {H.period_of(day, 10)})" in text and f">= {base})" in text
    assert {tuple(r) for r in H.read_history(spark, path).collect()} == replay(rows)


def test_patches_are_bounded(spark, tmp_path):
    rows = [(i, "INSERT" if i % 2 else "DELETE", "hot", "p", "o", D(i % 400)) for i in range(20000)]
    H.write_store(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "s"), 30, 2)
    store = spark.read.parquet(str(tmp_path / "s/changes")).collect()
    assert all(len(r.patches) <= 30 for r in store) and sum(len(r.patches) for r in store) == 400


def test_ties_nulls_and_empty(spark):
    rows = [(5, "DELETE", "a", "p", "x", D(1)), (5, "INSERT", "a", "p", "x", D(1)), (None, "DELETE", "a", "p", "x", D(1)), (1, "DELETE", "b", "p", "", D(1))]
    for f in (H.history, H.stored_history):
        assert {tuple(r) for r in f(spark.createDataFrame(rows, SCHEMA)).collect()} == {("a", "p", "x", D(1), None)}
        assert f(spark.createDataFrame([], SCHEMA)).collect() == []
    assert H.stored_version(spark.createDataFrame([], SCHEMA), "2022-01-01").collect() == []
    more = spark.createDataFrame([(*r, "INSERT", 1) for r in rows], SCHEMA + ", period string, since int")
    assert H.history(more).count() == 1 and H.stored_history(more).count() == 1
