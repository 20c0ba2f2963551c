"""Records that are the same but for spelling, against brute force."""

import json
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quadrille.llm import copies as C


def bare(x):
    return "".join(c for c in x if c.isalpha() or c.isdecimal()).upper().lower()


def spelt(rng, s, p, o):
    def mess(x):
        x = "".join(rng.choice([c.upper(), c.lower(), c]) for c in x)
        return rng.choice(["", " ", "(", "“"]) + x.replace("/", rng.choice(["/", "//", " "])) + rng.choice(["", ".", " !", " "])

    f = [(rng.choice([n, n.upper(), n.title()]), mess(v)) for n, v in zip(C.FIELDS, (s, p, o))]
    rng.shuffle(f)
    if rng.random() < 0.5:
        return json.dumps(dict(f), ensure_ascii=rng.random() < 0.5)
    return rng.choice(["|", " | "]).join(f"{k}{rng.choice(['=', ' = '])}{v}" for k, v in f)


def check(spark, recs, expected_key, **how):
    d = spark.createDataFrame([(i, x, 1, "c") for i, x in recs], "rec_id long, record string, n int, c string").repartition(4)
    got = {r.rec_id: (r.keep_id, r.n) for r in C.copies(d, **how).collect()}
    sets = defaultdict(list)
    for (i, x), k in zip(recs, expected_key):
        if x is not None:
            sets[k].append(i)
    assert got == {i: (min(v), len(v)) for v in sets.values() for i in v}


@pytest.mark.parametrize("seed,limit", [(1, 32 << 20), (2, 3000), (3, 400)])
def test_against_brute_force(spark, seed, limit):
    rng = random.Random(seed)
    facts = [(f"http://u{rng.randrange(3)}.ex/d{rng.randrange(4)}", f"ub:{rng.choice('ab')}", rng.choice(["Über É", "x1", "x 1", "SMÖRGÅS", ""]) + str(rng.randrange(40))) for _ in range(300)]
    recs, keys = [], []
    for i in range(2500):
        f = facts[0] if rng.random() < 0.35 else rng.choice(facts)
        recs.append((i, spelt(rng, *f)))
        keys.append(tuple(map(bare, f)))
    recs += [(5000 + i, None) for i in range(40)]
    check(spark, recs, [*keys, *[None] * 40], bucket_bytes=limit)


def weights(canon, tree, hot):
    """Bytes of each bucket that isn't hot, by the definition of a prefix."""
    rows = [bytes(r.c) for r in canon.select("c").collect()]
    key, *_ = tree.walk(pa.array(rows, pa.binary()))
    total = defaultdict(int)
    for k, c in zip(key.view("int64").tolist(), rows):
        total[k] += len(c) + C.OVERHEAD
    return {k: v for k, v in total.items() if k not in hot}


def test_a_hot_value_needs_no_shuffle(spark):
    d = spark.range(3000).selectExpr("id AS rec_id", "IF(id % 3 = 0, 'subject=a|predicate=b|object=c', CONCAT('subject=', id, '|predicate=b|object=c')) AS record")
    canon = C.canonical(d, "rec_id", "record")
    tree, hot = C.splits(canon, "rec_id", 2000, 3000 * (C.OVERHEAD + 8))
    assert list(hot.values()) == [(0, 1000)] and len(tree.hash) < 100
    got = C.copies(d, bucket_bytes=2000)
    assert got.where("keep_id = 0").count() == 1000 and got.where("n = 1").count() == 2000


@pytest.mark.parametrize("limit", [400, 3000])
def test_every_bucket_fits(spark, limit):
    """Whatever the number of buckets; a long shared prefix and values that are prefixes of others among them."""
    d = spark.range(4000).selectExpr("id AS rec_id", "CONCAT('subject=', REPEAT('long', 20), SUBSTRING(CONV(id * 7919, 10, 36), 1, CAST(id % 5 AS INT) + 1), '|predicate=b|object=') AS record")
    canon = C.canonical(d, "rec_id", "record")
    tree, hot = C.splits(canon, "rec_id", limit, 10**9)
    assert max(weights(canon, tree, hot).values()) <= limit and len(tree.hash) >= 5


def test_prefix_hashes_agree_with_bytes():
    """Records are in one bucket exactly if the tree's prefixes of them are equal."""
    rng = random.Random(9)
    rows = ["".join(rng.choices("ab", k=rng.randint(0, 9))).encode() for _ in range(500)]
    splits = {b"": 2, b"ab": 4, b"abba": 5, b"b": 3}
    tree = C.Tree()
    for level in ([b""], [b"ab", b"b"], [b"abba"]):
        key = lambda p: int(dict(zip(rows + [p], tree.walk(pa.array(rows + [p], pa.binary()))[0].tolist()))[p])  # noqa: B023, E731
        tree = tree.split(np.array([key(p) for p in level], np.uint64), np.array([splits[p] for p in level]))

    def leaf(c):
        p = b""
        while p in splits and c[: splits[p]] != p:
            p = c[: splits[p]]
        return p

    keys = tree.walk(pa.array([None, *rows], pa.binary()).slice(1))[0].tolist()
    assert len(set(zip(keys, map(leaf, rows)))) == len(set(keys)) == len(set(map(leaf, rows)))


def test_odd_records(spark):
    odd = [
        (1, '{"subject": "a", "predicate": "b", "object": "c"}'), (2, "OBJECT=C.|Subject = A | predicate=(b)"), (3, None), (4, ""), (5, " "),
        (6, "no fields"), (7, "NO fields!"), (8, '{"subject": "a"'), (9, '{"subject": "a", "predicate": "b"}'), (10, "x=" + "y" * 2_000_000),
        (11, '{"subject": "a", "Subject": "z", "predicate": "b", "object": "c"}'), (12, '{"subject": "ab", "predicate": "", "object": "c"}'), (13, '{"subject": null, "predicate": "ab", "object": "c"}'),
    ]
    keys = ["abc", "abc", None, "", "", "nf", "nf", 8, 9, 10, "abc", 12, 13]
    check(spark, odd, keys)
    check(spark, odd, keys, bucket_bytes=10)
    empty = spark.createDataFrame([], "rec_id long, record string")
    assert C.copies(empty).collect() == []


def test_trie_bursts():
    rng = random.Random(4)
    words = ["".join(rng.choices("ab", k=rng.randint(0, 16))).encode() for _ in range(60000)]
    words += [b"common" * 20 + str(i).encode() for i in range(20000)]
    t, at, least = C.Trie(), [], {}
    for i, w in enumerate(words):
        at.append(t.add(w, i))
        least.setdefault(w, i)
    assert type(t.roots[0]) is C.Trie.Branch
    assert all(t.least[n] == least[w] for n, w in zip(at, words))
    assert len(set(at)) == len(set(words)) and sum(t.count) == len(words)
