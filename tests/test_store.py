"""The store on small fixtures with answers worked by hand, and rules for cases that are easy to get wrong."""

import datetime as dt
import itertools
import random
import re
import time

import pytest

from quadrille.functions.shared import shared_dir
from quadrille.operators import statistics as S
from quadrille.plans.planner import Statistics, order
from quadrille.plans.sparql import parse
from quadrille.sources import saved
from quadrille.store import Store

D = dt.date
FACTS = [
    ("alice", "worksFor", "dept1", D(2022, 1, 10)), ("bob", "worksFor", "dept1", D(2022, 2, 10)), ("dept1", "partOf", "uni1", D(2022, 1, 10)),
    ("dept2", "partOf", "uni1", D(2022, 3, 10)), ("alice", "degreeFrom", "uni1", D(2022, 3, 10)), ("bob", "degreeFrom", "uni2", D(2022, 2, 10)),
    ("alice", "name", "Alice", D(2022, 1, 10)), ("alice", "worksFor", "dept1", D(2022, 4, 10)), ("carol", "worksFor", "dept2", D(2022, 5, 10)),
]
CHAIN = "SELECT ?x ?d { ?x <worksFor> ?d . ?d <partOf> <uni1> . filter (t = %s) }"
TRIANGLE = "SELECT ?x ?d ?u { ?x <worksFor> ?d . ?d <partOf> ?u . ?x <degreeFrom> ?u . filter (t = %s) }"
STAR = "SELECT ?x ?n { ?x <worksFor> <dept1> . ?x <name> ?n . filter (t = %s) }"


@pytest.fixture(scope="module")
def store(spark):
    return Store.of_quads(spark.createDataFrame(FACTS, "s string, p string, o string, t date"))


@pytest.fixture(scope="module")
def changing(spark):
    rows = [("INSERT", "a", "p", "b", D(2022, 1, 10), 1), ("INSERT", "a", "p", "c", D(2022, 2, 10), 2), ("DELETE", "a", "p", "b", D(2022, 3, 10), 3)]
    return Store.of_log(spark.createDataFrame(rows, "op string, s string, p string, o string, t date, seq long"))


def ask(store, text, mode="end"):
    return {tuple(r) for r in store.query(text, mode).collect()}


A, B, C = ("alice", "dept1"), ("bob", "dept1"), ("carol", "dept2")
T3 = {("alice", "dept1", "uni1")}


@pytest.mark.parametrize(
    "day,facts,chain,triangle,star",
    [
        ("2022-01-10", 3, {A}, set(), {("alice", "Alice")}), ("2022-02-10", 5, {A, B}, set(), {("alice", "Alice")}), ("2022-03-10", 7, {A, B}, T3, {("alice", "Alice")}),
        ("2022-04-10", 7, {A, B}, T3, {("alice", "Alice")}), ("2022-05-10", 8, {A, B, C}, T3, {("alice", "Alice")}), ("2022-01-09", 0, set(), set(), set()), ("2022-02-20", 5, {A, B}, set(), {("alice", "Alice")}),
    ],
)
def test_answers_at_days(store, day, facts, chain, triangle, star):
    assert len(ask(store, f"SELECT * {{ ?s ?p ?o . filter (t = {day}) }}")) == facts
    assert (ask(store, CHAIN % day), ask(store, TRIANGLE % day), ask(store, STAR % day)) == (chain, triangle, star)


@pytest.mark.parametrize("mode", ["end", "any"])
def test_range(store, mode):
    assert ask(store, CHAIN.replace("t = %s", "t >= 2022-02-10 and t <= 2022-03-10"), mode) == {A, B}


def test_deletes(changing):
    at = lambda day: {o for (o,) in ask(changing, f"SELECT ?o {{ <a> <p> ?o . filter (t = {day}) }}")}
    assert [at(f"2022-0{m}-10") for m in (1, 2, 3)] == [{"b"}, {"b", "c"}, {"c"}]
    q = "SELECT ?o { <a> <p> ?o . filter (t >= 2022-02-10 and t <= 2022-03-10) }"
    assert ask(changing, q) == {("c",)} and ask(changing, q, "any") == {("b",), ("c",)}
    # a day before a later state sees nothing of it
    assert at("2021-12-31") == set()


def test_no_time_is_the_current_state(store, changing):
    assert len(ask(store, "SELECT * { ?s ?p ?o }")) == 8
    assert ask(changing, "SELECT ?o { <a> <p> ?o }") == {("c",)}


def test_projection_hides_variables(store):
    assert ask(store, "SELECT ?u { ?x <worksFor> ?d . ?d <partOf> ?u }") == {("uni1",)}


def test_unconnected_patterns_are_a_product(store):
    assert ask(store, "SELECT ?x ?n { ?x <degreeFrom> ?u . ?y <name> ?n }") == {("alice", "Alice"), ("bob", "Alice")}


def test_constant_pattern_is_a_test(store):
    assert ask(store, "SELECT ?x { <dept1> <partOf> <uni1> . ?x <degreeFrom> ?u }") == {("alice",), ("bob",)}
    assert ask(store, "SELECT ?x { <dept1> <partOf> <uni1> . ?x <degreeFrom> ?u . filter (t = 2022-01-09) }") == set()
    assert ask(store, "SELECT ?x { <dept1> <partOf> <uni9> . ?x <degreeFrom> ?u }") == set()


def test_variable_predicate_and_repeated_variable(spark, store):
    assert ask(store, "SELECT ?p { <alice> ?p <uni1> }") == {("degreeFrom",)}
    s = Store.of_quads(spark.createDataFrame([("x", "p", "x", D(2022, 1, 1)), ("x", "p", "y", D(2022, 1, 1)), ("q", "q", "z", D(2022, 1, 1))], "s string, p string, o string, t date"))
    assert ask(s, "SELECT ?a { ?a <p> ?a }") == {("x",)}
    assert ask(s, "SELECT ?a { ?a ?a ?b }") == {("q",)}
    assert ask(s, "SELECT ?a ?b { ?a <p> ?b . ?a <p> ?a }") == {("x", "x"), ("x", "y")}


def test_unknown_terms_give_nothing(store):
    for q in ("SELECT ?x { ?x <nowhere> ?y }", "SELECT ?x { <nobody> <name> ?x . ?y <name> ?z }"):
        assert ask(store, q) == set()


def test_limit_and_duplicate_modes(store):
    assert store.query("SELECT ?s { ?s ?p ?o } LIMIT 2").count() == 2
    assert ask(store, "SELECT count ?d { ?x <worksFor> ?d }") == {("dept1", 2), ("dept2", 1)}
    assert ask(store, "SELECT duplicates ?d { ?x <worksFor> ?d }") == {("dept1",)}


def test_union_optional_filters(store):
    assert ask(store, "SELECT ?x { { ?x <worksFor> <dept2> } UNION { ?x <degreeFrom> <uni2> } }") == {("carol",), ("bob",)}
    assert ask(store, "SELECT ?x ?n { ?x <worksFor> ?d OPTIONAL { ?x <name> ?n } }") == {("alice", "Alice"), ("bob", None), ("carol", None)}
    assert ask(store, "SELECT ?x { ?x <worksFor> ?d . filter(?d not in <dept1>) }") == {("carol",)}
    assert ask(store, "SELECT ?x { ?x <name> ?n . filter(?n = \"Alice\") }") == {("alice",)}
    assert ask(store, "SELECT ?x { ?x <worksFor> ?d . filter(?no = <dept1>) }") == set()


def solutions(patterns, facts):
    out = [{}]
    for pattern in patterns:
        new = []
        for m in out:
            for f in facts:
                n = dict(m)
                if all(n.setdefault(a, b) == b if a[0] == "?" else a == b for a, b in zip(pattern, f)):
                    new.append(n)
        out = new
    return out


def test_variables_that_may_be_unbound(spark):
    """Optional parts that share them, against compatible mappings by definition."""
    rng = random.Random(8)
    facts = {(rng.choice("abc"), rng.choice("pqr"), rng.choice("abc")) for _ in range(14)}
    s = Store.of_quads(spark.createDataFrame([(*f, D(2022, 1, 1)) for f in facts], "s string, p string, o string, t date"))
    compatible = lambda m, n: all(m[k] == n[k] for k in m if k in n)
    base, one, two, three = (solutions(x, facts) for x in ([("?x", "p", "?d")], [("?x", "q", "?n")], [("?n", "r", "?m")], [("?n", "p", "?x")]))
    for q, parts in (("OPTIONAL { ?x <q> ?n } OPTIONAL { ?n <r> ?m }", (one, two)), ("OPTIONAL { ?x <q> ?n } OPTIONAL { ?n <p> ?x }", (one, three))):
        want = base
        for part in parts:
            want = [r for m in want for r in ([{**m, **n} for n in part if compatible(m, n)] or [m])]
        got = ask(s, f"SELECT ?x ?d ?n ?m {{ ?x <p> ?d {q} }}") if "?m" in q else ask(s, f"SELECT ?x ?d ?n {{ ?x <p> ?d {q} }}")
        assert got == {tuple(m.get(v) for v in ("?x", "?d", "?n", "?m")[: 4 if "?m" in q else 3]) for m in want}
    got = ask(s, "SELECT ?x ?d ?n { { ?x <p> ?d } UNION { ?x <q> ?n } { ?n <p> ?x } UNION { ?d <r> ?x } }")
    left = [*base, *one]
    right = [*three, *solutions([("?d", "r", "?x")], facts)]
    assert got == {tuple({**m, **n}.get(v) for v in ("?x", "?d", "?n")) for m in left for n in right if compatible(m, n)}


def test_reaches_ends_on_a_cycle(spark):
    rows = [("b", "sub", "c"), ("c", "sub", "d"), ("d", "sub", "b"), ("x", "sub", "y"), ("z", "other", "b")]
    s = Store.of_quads(spark.createDataFrame([(*r, D(2022, 1, 1)) for r in rows], "s string, p string, o string, t date"))
    assert ask(s, "SELECT ?x { ?x ?p ?o . filter(?x reaches <d> via <sub>) }") == {("b",), ("c",), ("d",)}


def test_reaches_along_a_long_path(spark, monkeypatch):
    monkeypatch.setattr("quadrille.operators.paths.FOLD", 3)
    rows = [(f"n{i}", "sub", f"n{i + 1}", D(2022, 1, 1)) for i in range(8)] + [("n2", "sub", "n0", D(2022, 1, 1))]
    s = Store.of_quads(spark.createDataFrame(rows, "s string, p string, o string, t date"))
    assert ask(s, "SELECT ?x { ?x ?p ?o . filter(?x reaches <n7> via <sub>) }") == {(f"n{i}",) for i in range(8)}


def test_pattern_order_does_not_matter(store):
    pats = ["?x <worksFor> ?d .", "?d <partOf> ?u .", "?x <degreeFrom> ?u ."]
    assert {frozenset(ask(store, f"SELECT ?x ?d ?u {{ {' '.join(p)} }}")) for p in itertools.permutations(pats)} == {frozenset(T3)}


def test_planner_starts_small_and_stays_connected():
    q = parse("SELECT * { ?x <big> ?y . ?y <small> ?z . ?z <mid> ?w . ?x <big> ?z }").where.patterns
    st = Statistics(counts={(None, "big", None): 1000, (None, "small", None): 3, (None, "mid", None): 50})
    names = [p.p.text for p in order(q, st)]
    assert names == ["small", "mid", "big", "big"]
    bound = set()
    for p in order(q, st):
        assert not bound or bound & set(p.vars)
        bound |= set(p.vars)


ADVISED = "SELECT * { ?y <teacherOf> ?z . ?x <advisor> ?y . ?x <takesCourse> ?z }"


def test_without_counts_a_triangle_begins_with_what_one_subject_has():
    """by the hub in its middle, teachers' courses would be joined to each of their students."""
    assert [p.p.text for p in order(parse(ADVISED).where.patterns)][-1] == "teacherOf"


def order_by_saved_counts(spark, path, text, rows):
    """The predicates of a triangle in the planned order, of a store that is saved in two steps."""
    schema = "s string, p string, o string, t date"
    Store.of_quads(spark.createDataFrame(rows[:-20], schema)).save(path)
    late = spark.createDataFrame(rows[-20:], schema).selectExpr("'INSERT' AS op", "s", "p", "o", "t", "CAST(1 AS BIGINT) AS seq")
    saved.Saved(spark, path).extend(late)
    patterns = parse(text).where.patterns
    st = Store.open(spark, path).estimates(patterns)
    assert {k: n for k, n in st.different.items()} == {((None, p, None), c): len({r["spo".index(c)] for r in rows if r[1] == p}) for p in {r[1] for r in rows} for c in "so"}
    return [p.p.text for p in order(patterns, st)]


def test_saved_counts_find_the_side_of_a_triangle_with_fewest_pairs(spark, tmp_path):
    """120 orders of three parts from few suppliers. By counts of predicates alone, the parts of a supplier came before those of an order."""
    lines = [(f"order{i // 3}", f"part{i % 37}", f"supplier{i % 5}") for i in range(360)]
    facts = [t for x, z, y in lines for t in ((x, "hasPart", z), (z, "soldBy", y), (x, "suppliedBy", y))]
    rows = [(*f, D(2022, 1, 1)) for f in sorted(set(facts))]
    names = order_by_saved_counts(spark, str(tmp_path / "s"), "SELECT * { ?x <hasPart> ?z . ?z <soldBy> ?y . ?x <suppliedBy> ?y }", rows)
    assert set(names[:2]) == {"hasPart", "suppliedBy"}  # 1,080 pairs; soldBy has fewest facts and was first


def test_saved_counts_keep_a_hub_for_the_end(spark, tmp_path):
    """60 students with two advisors and five courses each; four teachers with up to 50 courses."""
    rows = {(f"x{i}", "advisor", f"y{(i + k) % 4}") for i in range(60) for k in range(2)} | {(f"x{i}", "takesCourse", f"z{(7 * i + k) % 50}") for i in range(60) for k in range(5)}
    rows |= {(f"y{i}", "teacherOf", f"z{k}") for i in range(4) for k in range(50)}
    assert order_by_saved_counts(spark, str(tmp_path / "s"), ADVISED, [(*f, D(2022, 1, 1)) for f in sorted(rows)])[-1] == "teacherOf"


def test_many_patterns_are_ordered_step_by_step():
    q = parse("SELECT * { " + " . ".join(f"?x{i} <p{i}> ?x{i + 1}" for i in range(40)) + " }").where.patterns
    names = [p.p.text for p in order(q, Statistics(counts={(None, f"p{i}", None): 5 if i == 20 else 1000 for i in range(40)}))]
    assert names[0] == "p20" and set(names) == {f"p{i}" for i in range(40)}
    at = [int(n[1:]) for n in names]
    assert all(min(at[:i]) - 1 <= x <= max(at[:i]) + 1 for i, x in enumerate(at) if i)


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toString()
    return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", files))


def test_steps_of_saving_free_their_shuffles(spark, tmp_path):
    """else the disk holds the shuffles of log, periods and counts at once."""
    s = Store.of_quads(spark.range(2000).selectExpr("'s' || id % 700 AS s", "'p' || id % 3 AS p", "'o' || id AS o", "DATE'2022-01-01' + CAST(id % 50 AS INT) AS t"))
    there = shuffle_files(spark)
    s.save(str(tmp_path / "s"))
    for _ in range(50):  # they go in the background
        if not (left := shuffle_files(spark) - there):
            break
        time.sleep(0.2)
    assert not left
    opened = Store.open(spark, str(tmp_path / "s"))
    assert {tuple(r) for r in opened.periods.collect()} == {tuple(r) for r in s.validity().collect()} and opened.log.count() == 2000


def test_stated_periods_take_one_shuffle(spark):
    log = spark.createDataFrame([("INSERT", "a", "p", "b", D(2022, 2, 1), 0), ("INSERT", "a", "p", "b", D(2022, 1, 1), 0), ("INSERT", "a", "q", "b", D(2022, 3, 1), 0)], saved.LOG)
    d = saved._stated(log)
    assert plan(d).count("Exchange ") == 1
    assert {tuple(r) for r in d.collect()} == {("a", "p", "b", D(2022, 1, 1), None), ("a", "q", "b", D(2022, 3, 1), None)}


def test_updates(changing):
    day = D(2022, 6, 1)
    s = changing.update('INSERT DATA { <a> <p> <d> . <e> <q> "f" }', day)
    assert ask(s, "SELECT * { ?s ?p ?o }") == {("a", "p", "c"), ("a", "p", "d"), ("e", "q", "f")}
    assert ask(s, "SELECT * { ?s ?p ?o . filter (t = 2022-05-31) }") == {("a", "p", "c")}
    assert s.changes("DELETE DATA { <a> <p> <zzz> }", day).count() == 0
    s2 = s.update("DELETE { ?x <p> ?y } INSERT { ?y <was> ?x }", D(2022, 7, 1), 1 << 41)
    assert ask(s2, "SELECT * { ?s ?p ?o }") == {("c", "was", "a"), ("d", "was", "a"), ("e", "q", "f")}
    s3 = s2.update("DELETE { <c> <was> ?x } INSERT { <c> <was> ?x }", D(2022, 8, 1), 1 << 42)
    assert ("c", "was", "a") in ask(s3, "SELECT * { ?s ?p ?o }")
    assert s3.validity().where("s = 'c'").count() == 1


def test_insert_twice_changes_nothing(spark, store):
    again = spark.createDataFrame([("alice", "worksFor", "dept1"), ("alice", "worksFor", "dept1"), ("dora", "worksFor", "dept1")], "s string, p string, o string")
    s = store.insert(again, D(2023, 1, 1))
    assert s.triple_count() == 9
    assert {r.t_from for r in s.validity().where("s = 'alice' AND p = 'worksFor'").collect()} == {D(2022, 1, 10)}


@pytest.mark.parametrize("folders", [0, 5000])
def test_save_and_open(spark, changing, tmp_path, monkeypatch, folders):
    monkeypatch.setattr("quadrille.sources.saved.FOLDERS", folders)
    changing.update("INSERT DATA { <a> <12> <b> }", D(2022, 5, 1)).save(str(tmp_path / "s"))
    s = Store.open(spark, str(tmp_path / "s"))
    assert ask(s, "SELECT ?o { <a> <p> ?o . filter (t = 2022-02-10) }") == {("b",), ("c",)}
    assert ask(s, "SELECT ?p { ?s ?p ?o }") == {("p",), ("12",)}
    assert {tuple(r) for r in s.counts("op").collect()} == {("c", "p", 1), ("b", "12", 1)}
    text = plan(s.query("SELECT ?o { <a> <p> ?o . filter (t = 2022-02-10) }"))
    filters = text.split("PartitionFilters: [")[1].split("]")[0]
    assert ("= p" in filters) == (folders > 0)
    again = s.update("DELETE { <a> ?p ?o }", D(2022, 6, 1))
    assert again.stored is None and ask(again, "SELECT ?p { ?s ?p ?o }") == set()
    with pytest.raises(FileExistsError):
        s.save(str(tmp_path / "s"))
    s.update("DELETE { <a> <p> ?o }", D(2022, 6, 1)).save(str(tmp_path / "s"), "overwrite")
    assert ask(Store.open(spark, str(tmp_path / "s")), "SELECT ?p { ?s ?p ?o }") == {("12",)}
    assert ask(s, "SELECT ?p { ?s ?p ?o }") == {("p",), ("12",)}  # what was opened stays


def random_log(rng, n, days=28):
    return [(rng.choice(["INSERT", "DELETE", "insert ", None]), rng.choice(["a", "b", None]), rng.choice(["p", "q", "r"]), rng.choice("xyz"), rng.choice([None, *[D(2022, 1, 1 + rng.randrange(days))] * 9]), i) for i in range(n)]


@pytest.mark.parametrize("folders,parts", [(0, 16), (5000, 2)])
def test_extended_like_made_anew(spark, tmp_path, monkeypatch, folders, parts):
    """Extensions, with late changes among them, give the store that the whole log gives, counts too."""
    monkeypatch.setattr("quadrille.sources.saved.FOLDERS", folders)
    monkeypatch.setattr("quadrille.sources.saved.MOST_PARTS", parts)
    schema = "op string, s string, p string, o string, t date, seq long"
    rows, path = random_log(random.Random(5), 120), str(tmp_path / "s")
    Store.of_log(spark.createDataFrame(rows[:60], schema)).save(path)
    first = Store.open(spark, path)
    for a, b in ((60, 63), (63, 63), (63, 120)):
        saved.Saved(spark, path).extend(spark.createDataFrame(rows[a:b], schema))
    s, want = Store.open(spark, path), Store.of_log(spark.createDataFrame(rows, schema))
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    for t in (s, Store(spark, log=s.log, periods=saved.Saved(spark, path).compacted().periods())):
        assert same(t.log, want.log) and same(t.periods, want.periods)
    for name in saved.COUNTS:
        assert same(s.counts(name), want.counts(name).select(s.counts(name).columns))
        assert same(Store.open(spark, path).counts(name), s.counts(name))
    assert same(first.log, spark.createDataFrame(rows[:60], schema)) and s.stored.last_seq == 119


def test_one_writer_has_a_version(spark, changing, tmp_path):
    path = str(tmp_path / "s")
    changing.save(path)
    a, b = saved.Saved(spark, path), saved.Saved(spark, path)
    rows = spark.createDataFrame([("INSERT", "z", "p", "b", D(2022, 1, 10), 9)], "op string, s string, p string, o string, t date, seq long")
    a.extend(rows, ("feed", 0))
    with pytest.raises(saved.Conflict):
        b.extend(rows)
    again = saved.Saved(spark, path)
    assert again.extend(rows, ("feed", 0)).version == again.version == 1
    assert Store.open(spark, path).log.count() == 4


def test_stream_into_a_store_that_has_rows(spark, changing, tmp_path):
    from quadrille.streaming import log_stream

    path, feed = str(tmp_path / "s"), str(tmp_path / "feed")
    changing.save(path)
    for day, op, seq in ((4, "DELETE", 7), (5, "INSERT", 8)):
        spark.createDataFrame([(op, "a", "p", "c", D(2022, day, 10), seq)], "op string, s string, p string, o string, t date, seq long").write.mode("append").parquet(feed)
        log_stream.append(log_stream.read_log(spark, feed), path, str(tmp_path / "ck")).awaitTermination()
    s = Store.open(spark, path)
    assert s.log.count() == 5
    at = lambda day: {o for (o,) in ask(s, f"SELECT ?o {{ <a> <p> ?o . filter (t = {day}) }}")}
    assert [at(f"2022-0{m}-10") for m in (2, 3, 4, 5)] == [{"b", "c"}, {"c"}, set(), {"c"}]
    assert s.counts("sp").collect()[0].n == 1


def test_facts_that_are_not_touched_are_not_moved(spark, sf):
    """The periods of a store with few new rows are read past a broadcast of these, without an exchange."""
    s = Store.of_log(spark.read.parquet(f"{sf}/change_log.parquet"))
    path = shared_dir(spark, "store")
    s.save(path)
    s = Store.open(spark, path).update('INSERT DATA { <a> <ub:rank> "b" }', D(2030, 1, 1))
    text = plan(s.periods)
    kept = text.split("LeftAnti")[1].split("Union")[0].split("Sort")[0]
    assert "BroadcastHashJoin" in text.split("LeftAnti")[0].rsplit("\n", 1)[-1]
    assert "Exchange hashpartitioning" not in kept.split("BroadcastExchange")[0]


def test_cardinality(spark, store, changing, tmp_path):
    changing.save(str(tmp_path / "s"))
    stored = Store.open(spark, str(tmp_path / "s"))
    assert [store.cardinality(), store.cardinality(p="worksFor"), store.cardinality("alice", "worksFor"), store.cardinality(p="partOf", o="uni1"), store.cardinality(s="alice"), store.cardinality(p="no")] == [8, 3, 1, 2, 3, 0]
    assert [stored.cardinality(), stored.cardinality("a", "p"), stored.cardinality(p="p", o="c"), stored.cardinality(s="a"), stored.cardinality("a", "p", "b")] == [1, 1, 1, 1, 0]


def test_snapshot_positions(spark, store):
    assert [tuple(r) for r in S.choose_snapshots(store.quads).orderBy("t").collect()] == [(D(2022, 1, 10), 3), (D(2022, 2, 10), 5), (D(2022, 4, 10), 8)]
    one = store.quads.where("t = DATE'2022-01-10'")
    assert S.choose_snapshots(one).count() == 1 and S.choose_snapshots(one.limit(0)).count() == 0
    assert S.nearest_snapshot(store.quads, "2022-03-01").first().t == D(2022, 2, 10)


def test_states_grow_without_deletes_and_match_replay(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["INSERT", "DELETE"]), rng.choice("ab"), "p", rng.choice("xyz"), D(2022, 1, 1 + rng.randrange(28)), i) for i in range(300)]
    s = Store.of_log(spark.createDataFrame(rows, "op string, s string, p string, o string, t date, seq long"))
    for n in (1, 9, 17, 28):
        day, last = D(2022, 1, n), {}
        for op, a, p, o, t, seq in sorted(rows, key=lambda r: (r[4], r[5])):
            if t <= day:
                last[(a, p, o)] = op
        assert ask(s, f"SELECT * {{ ?s ?p ?o . filter (t = {day}) }}") == {k for k, op in last.items() if op == "INSERT"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # else the list of filters is cut in the plan's text
    s = Store.of_quads(spark.read.parquet(f"{sf}/temporal_quads.parquet"))
    p = plan(s.query("SELECT ?x { ?x <ub:advisor> ?y . filter (t = 2022-12-31) }"))
    assert "EqualTo(p,ub:advisor)" in p and "LessThanOrEqual(t,2022-12-31)" in p
    assert "quad_id" not in p.split("ReadSchema")[1] and "src_file" not in p
    p = plan(s.query("SELECT ?x { ?x <ub:advisor> ?y . ?y <ub:worksFor> ?d . filter (t = 2022-12-31) }"))
    assert "Cartesian" not in p and "PythonUDF" not in p and "Pandas" not in p


def test_edge_replaced(changing):
    s = changing.update_edge(("a", "p", "c"), ("a", "p", "new"), D(2022, 6, 1))
    assert ask(s, "SELECT ?o { <a> <p> ?o }") == {("new",)}
    assert ask(changing.update_edge(("a", "p", "no"), ("a", "p", "new"), D(2022, 6, 1)), "SELECT ?o { <a> <p> ?o }") == {("c",)}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import io

    from quadrille.__main__ import main

    at = lambda x: str(tmp_path / x)
    (tmp_path / "build.nt").write_text("<a> <p> <b> <2022-01-01> .\n<a> <p> .\n")
    (tmp_path / "more.nt").write_text("<a> <p> <c> .\n<a> <p> <b> .\n<a> <p .\n" + "".join(f"<a> <q> <c{i}> .\n" for i in range(30)))
    (tmp_path / "q").write_text("# a comment\nSELECT ?x\n{ <a> <p> ?x }")
    (tmp_path / "all").write_text("SELECT ?x { <a> <q> ?x }")
    main(["build", at("build.nt"), at("s")], spark)
    main(["insert", at("more.nt"), at("s"), "--day", "2022-05-01"], spark)
    assert {(r.line, r.reason) for r in spark.read.parquet(at("s-faulty")).collect()} == {("<a> <p> .", "missing object"), ("<a> <p .", "bad or missing predicate")}
    main(["query", at("s"), at("q"), "--repeat", "2"], spark)
    assert "2 rows" in capsys.readouterr().out
    main(["query", at("s"), at("all")], spark)
    assert capsys.readouterr().out.count("\nc") == 30  # the whole answer
    main(["query", at("s"), at("all"), "--out", at("o")], spark)
    assert spark.read.parquet(at("o/0-all")).count() == 30
    monkeypatch.setattr("sys.stdin", io.StringIO("SELECT ?x { <a> <p> ?x }\n\nnonsense\n\nDELETE { <a> <q> ?x }\n\nSELECT ?x { <a> ?y ?x }\n"))
    main(["shell", at("s")], spark)
    out = capsys.readouterr().out
    assert out.count("2 rows") == 2 and "error" in out and "version 2" in out
    main(["predicates", at("s")], spark)
    assert capsys.readouterr().out.split() == ["p", "n", "p", "2"]
    for verb in ("compact", "pages", "triples"):
        main([verb, at("s")], spark)
    assert '<a> <p> "b" .' in capsys.readouterr().out
    assert ask(Store.open(spark, at("s")), "SELECT ?x { <a> <p> ?x . filter (t = 2022-04-30) }") == {("b",)}
