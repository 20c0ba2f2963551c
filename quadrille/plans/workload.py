"""The graph workload: every operator of the engine as a query, with equal SQL over the same tables."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import shared
from quadrille.functions import terms as T
from quadrille.functions.shared import shared_dir, table, written
from quadrille.operators import log_pages
from quadrille.operators import statistics as S
from quadrille.plans import execute
from quadrille.plans.problems import _LINES, _SPELLS
from quadrille.plans.sparql import RDF_TYPE, Const, Pattern, Var, parse_file
from quadrille.sources import campus, mapping, saved, text, turtle
from quadrille.store import Store
from quadrille.streaming import log_stream

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

DAY = "2022-12-31"
DATES = [f"2022-{m:02d}-10" for m in (2, 5, 8, 11)] + ["2023-02-10"]
STUDENT = "http://univ1.example/dept8/student0"
DEPT, UNIV = "http://univ2.example/dept9", "http://univ2.example"
PREFIXES = "PREFIX rdf: <rdf:> PREFIX ub: <ub:> "


def lubm(spark: SparkSession, d: str) -> Store:
    return Store.of_quads(table(spark, d, "temporal_quads"))


def changing(spark: SparkSession, d: str) -> Store:
    return Store.of_log(table(spark, d, "change_log"))


def facts_sql(day: str | None = DAY) -> str:
    """The distinct facts of temporal_quads as of a day."""
    until = f" AND t <= DATE '{day}'" if day else ""
    return f"(SELECT DISTINCT s, p, o FROM temporal_quads WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL AND t IS NOT NULL{until})"


def held_sql(day: str | None) -> str:
    """The facts of change_log as of a day, or now."""
    cond = f"t_from <= DATE '{day}' AND (t_to IS NULL OR t_to > DATE '{day}')" if day else "t_to IS NULL"
    return f"(SELECT s, p, o FROM ({_SPELLS}) WHERE op = 'INSERT' AND {cond})"


def held_within(first: str, last: str) -> str:
    return f"(SELECT DISTINCT s, p, o FROM ({_SPELLS}) WHERE op = 'INSERT' AND t_from <= DATE '{last}' AND (t_to IS NULL OR t_to > DATE '{first}'))"


def when(day: str | None) -> str:
    return f" filter ( t = {day} ) ." if day else ""


def graph(name: str, query: str, sql: str | None, store=lubm, mode: str = "end", prefixes: str = PREFIXES) -> None:
    """Registers a graph query and its SQL."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return store(spark, d).query(prefixes + query, mode)

    run.__name__ = name
    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = sql


def other(name: str, sql: str | None = None):
    def add(f):
        f.__name__ = name
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _scan(name: str, pattern: str, shown: str, where: str, cols: str) -> None:
    graph(name, f"SELECT {shown} WHERE {{ {pattern} .{when(DAY)} }}", f"SELECT DISTINCT {cols} FROM {facts_sql()} WHERE {where}")


_scan("scan_o_by_sp", f"<{STUDENT}> ub:takesCourse ?o", "?o", f"s = '{STUDENT}' AND p = 'ub:takesCourse'", "o")
_scan("scan_s_by_po", "?s rdf:type ub:GraduateStudent", "?s", "p = 'rdf:type' AND o = 'ub:GraduateStudent'", "s")
_scan("scan_so_by_p", "?s ub:memberOf ?o", "?s ?o", "p = 'ub:memberOf'", "s, o")
_scan("scan_os_by_p", "?s ub:hasMember ?o", "?o ?s", "p = 'ub:hasMember'", "s, o")
_scan("scan_p_by_so", f"<{STUDENT}> ?p <http://univ2.example/dept12>", "?p", f"s = '{STUDENT}' AND o = 'http://univ2.example/dept12'", "p")
_scan("scan_s_by_p", "?s ub:advisor ?o", "?s", "p = 'ub:advisor'", "s")
_scan("scan_o_by_p", "?s ub:advisor ?o", "?o", "p = 'ub:advisor'", "o")
_scan("scan_p_by_s", f"<{STUDENT}> ?p ?o", "?p", f"s = '{STUDENT}'", "p")
_scan("scan_p_by_o", f"?s ?p <{UNIV}>", "?p", f"o = '{UNIV}'", "p")
_scan("scan_s_by_o", f"?s ?p <{DEPT}>", "?s", f"o = '{DEPT}'", "s")
_scan("scan_o_by_s", f"<{STUDENT}> ?p ?o", "?o", f"s = '{STUDENT}'", "o")
_scan("scan_sp_by_o", f"?s ?p <{DEPT}>", "?s ?p", f"o = '{DEPT}'", "s, p")
_scan("scan_ps_by_o", f"?s ?p <{UNIV}>", "?p ?s", f"o = '{UNIV}'", "p, s")
_scan("scan_po_by_s", f"<{STUDENT}> ?p ?o", "?p ?o", f"s = '{STUDENT}'", "p, o")
_scan("scan_op_by_s", "<http://univ1.example/dept3/student0> ?p ?o", "?o ?p", "s = 'http://univ1.example/dept3/student0'", "o, p")
_scan("scan_s", "?s ?p ?o", "?s", "true", "s")
_scan("scan_p", "?s ?p ?o", "?p", "true", "p")
_scan("scan_o", "?s ?p ?o", "?o", "true", "o")
_scan("scan_so", "?s ?p ?o", "?s ?o", "true", "s, o")
_scan("scan_sp", "?s ?p ?o", "?s ?p", "true", "s, p")
_scan("scan_po", "?s ?p ?o", "?p ?o", "true", "p, o")
_scan("scan_spo", "?s ?p ?o", "?s ?p ?o", "true", "s, p, o")
graph(
    "exists_spo",
    f"SELECT ?o WHERE {{ <http://registry.example/roll/main> ?any ?member . <{STUDENT}> ?p ?o . ?s rdf:type ub:University .{when(DAY)} }}",
    f"SELECT DISTINCT a.o FROM {facts_sql()} a WHERE a.s = '{STUDENT}' AND EXISTS (SELECT 1 FROM {facts_sql()} WHERE s = 'http://registry.example/roll/main') AND EXISTS (SELECT 1 FROM {facts_sql()} WHERE p = 'rdf:type' AND o = 'ub:University')",
)
graph("exists_spo_absent", f"SELECT ?x WHERE {{ <{UNIV}> ub:advisor <{UNIV}> . ?x rdf:type ub:Course .{when(DAY)} }}", f"SELECT s AS x FROM {facts_sql()} WHERE p = 'rdf:type' AND o = 'ub:Course' AND EXISTS (SELECT 1 FROM {facts_sql()} WHERE s = '{UNIV}' AND p = 'ub:advisor' AND o = '{UNIV}')")


@other("scan_range", f"SELECT DISTINCT s, o FROM {facts_sql()} WHERE p = 'ub:worksFor' AND o BETWEEN 'http://univ1.example/dept1' AND 'http://univ1.example/dept5'")
def scan_range(spark, d):
    state = lubm(spark, d).as_of(dt.date.fromisoformat(DAY))
    return execute.scan_between(state, Pattern(Var("s"), Const("ub:worksFor"), Var("o")), "o", "http://univ1.example/dept1", "http://univ1.example/dept5")


# when facts hold

_MEMBER = "SELECT ?s ?o WHERE {{ ?s ub:memberOf ?o .{0} }}"
for _name, _day in (("asof_exact_date", "2022-05-10"), ("asof_between_dates", "2022-03-17"), ("asof_before_first", "1900-01-01"), ("asof_after_last", "2200-01-01")):
    graph(_name, _MEMBER.format(when(_day)), f"SELECT s, o FROM {facts_sql(_day)} WHERE p = 'ub:memberOf'")
_RANGE = " filter ( t >= 2022-03-10 and t <= 2022-09-10 ) ."
graph("range_end", _MEMBER.format(_RANGE), f"SELECT s, o FROM {facts_sql('2022-09-10')} WHERE p = 'ub:memberOf'")
graph("range_any", _MEMBER.format(_RANGE), f"SELECT s, o FROM {facts_sql('2022-09-10')} WHERE p = 'ub:memberOf'", mode="any")
graph("no_filter_current", _MEMBER.format(""), f"SELECT s, o FROM {facts_sql(None)} WHERE p = 'ub:memberOf'")
_WORKS = "SELECT ?s ?o WHERE {{ ?s ub:worksFor ?o .{0} }}"
graph("asof_with_deletes", _WORKS.format(when(DAY)), f"SELECT s, o FROM {held_sql(DAY)} WHERE p = 'ub:worksFor'", changing)
graph("current_with_deletes", _WORKS.format(""), f"SELECT s, o FROM {held_sql(None)} WHERE p = 'ub:worksFor'", changing)
graph("range_end_with_deletes", _WORKS.format(_RANGE), f"SELECT s, o FROM {held_sql('2022-09-10')} WHERE p = 'ub:worksFor'", changing)
graph("range_any_with_deletes", _WORKS.format(_RANGE), f"SELECT s, o FROM {held_within('2022-03-10', '2022-09-10')} WHERE p = 'ub:worksFor'", changing, "any")
graph(
    "star_with_deletes",
    f"SELECT ?x ?d ?r WHERE {{ ?x ub:worksFor ?d . ?x ub:rank ?r .{when(DAY)} }}",
    f"WITH f AS {held_sql(DAY)} SELECT a.s AS x, a.o AS d, b.o AS r FROM f a JOIN f b ON a.s = b.s WHERE a.p = 'ub:worksFor' AND b.p = 'ub:rank'",
    changing,
)


@other("fact_history", f"SELECT s, p, o, t_from, t_to FROM ({_SPELLS}) WHERE op = 'INSERT'")
def fact_history(spark, d):
    return changing(spark, d).validity()


@other("fact_history_insert_only", "SELECT s, p, o, min(t) AS t_from, CAST(NULL AS DATE) AS t_to FROM temporal_quads WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL AND t IS NOT NULL GROUP BY s, p, o")
def fact_history_insert_only(spark, d):
    return lubm(spark, d).validity()


_BY_DAY = "SELECT t, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY t) AS BIGINT) AS total FROM temporal_quads WHERE t IS NOT NULL GROUP BY t"
_SNAPS = "SELECT t, total FROM (SELECT *, max(total) OVER () AS whole FROM ({0})), (VALUES (1), (3), (5)) v(m) WHERE total * 6 >= m * whole AND (total - n) * 6 < m * whole".format(_BY_DAY)


@other("log_counts_by_date", "SELECT t, count(*) AS n FROM temporal_quads WHERE t IS NOT NULL GROUP BY t")
def log_counts_by_date(spark, d):
    return S.by_day(table(spark, d, "temporal_quads")).select("t", "n")


@other("log_running_total", _BY_DAY)
def log_running_total(spark, d):
    return S.by_day(table(spark, d, "temporal_quads"))


@other("snapshot_positions", f"SELECT DISTINCT t, total FROM ({_SNAPS})")
def snapshot_positions(spark, d):
    return S.choose_snapshots(table(spark, d, "temporal_quads"))


@other("nearest_snapshot", f"SELECT t, abs(total - (SELECT count(*) FROM temporal_quads WHERE t <= DATE '2022-06-30')) AS distance FROM ({_SNAPS}) ORDER BY 2, 1 LIMIT 1")
def nearest_snapshot(spark, d):
    return S.nearest_snapshot(table(spark, d, "temporal_quads"), "2022-06-30")


@other("snapshot_materialized", f"SELECT p, count(*) AS n FROM {facts_sql(DAY)} GROUP BY p")
def snapshot_materialized(spark, d):
    kept = written(lubm(spark, d).as_of(dt.date.fromisoformat(DAY)).facts.distinct(), "snapshot")
    return kept.groupBy("p").agg(F.count("*").alias("n"))


@other("log_time_sorted", "SELECT t, s, p, o FROM temporal_quads WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL AND t IS NOT NULL")
def log_time_sorted(spark, d):
    return lubm(spark, d).quads.orderBy("t", "s", "p", "o").select("t", "s", "p", "o")


_CLEAN = """SELECT page_no, pid, next_page_no, used_space, least(min_ts, max_ts) AS lo, CASE WHEN max_ts IS NOT NULL AND min_ts IS NOT NULL THEN greatest(min_ts, max_ts) ELSE max_ts END AS hi
FROM log_chunk_meta WHERE page_no IS NOT NULL AND pid IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY page_no ORDER BY used_space DESC NULLS LAST, hi DESC NULLS LAST, lo DESC NULLS LAST, next_page_no DESC NULLS LAST, pid DESC) = 1"""
_SECONDS = (1654041600, 1656633600)  # June 2022


@other("log_pages_in_range", f"SELECT page_no, pid FROM ({_CLEAN}) WHERE (lo IS NULL OR lo <= {_SECONDS[1]}) AND (hi IS NULL OR hi >= {_SECONDS[0]})")
def log_pages_in_range(spark, d):
    return log_pages.overlapping(table(spark, d, "log_chunk_meta"), *_SECONDS).select("page_no", "pid")


@other(
    "log_page_directory",
    f"SELECT pid, count(*) AS pages, CAST(sum(CASE WHEN next_page_no = -1 THEN 1 ELSE 0 END) AS BIGINT) AS chains, CAST(sum(used_space) AS BIGINT) AS space, CAST(sum(4096 - used_space) AS BIGINT) AS free FROM ({_CLEAN}) GROUP BY pid",
)
def log_page_directory(spark, d):
    return log_pages.directory(table(spark, d, "log_chunk_meta"))


# shapes of joins

LUBM = f"PREFIX rdf: <{campus.RDF}> PREFIX ub: <{campus.UB}> "
CAMPUS_DAY = "2022-05-10"
CAMPUS_DATES = [f"2022-{m:02d}-10" for m in range(1, 6)]
#: The seven benchmark queries (fixed values).
TEMPLATES = {
    "bgp1_star_semijoin": """SELECT ?x WHERE { ?x rdf:type ub:ResearchGroup . ?x ub:subOrganizationOf <http://www.Department0.University0.edu> .WHEN }""",
    "bgp2_star_two_attributes": """SELECT ?x ?y1 ?y2 WHERE { ?x rdf:type ub:FullProfessor . ?x ub:name ?y1 . ?x ub:emailAddress ?y2 . ?x ub:worksFor <http://www.Department0.University0.edu> .WHEN }""",
    "bgp3_member_triangle": """SELECT ?x ?y ?z WHERE { ?x rdf:type ub:UndergraduateStudent . ?y rdf:type ub:University . ?z rdf:type ub:Department . ?x ub:memberOf ?z . ?z ub:subOrganizationOf ?y . ?x ub:undergraduateDegreeFrom ?y .WHEN }""",
    "bgp4_star_three_attributes": """SELECT ?x ?y1 ?y2 ?y3 WHERE { ?x ub:worksFor <http://www.Department0.University0.edu> . ?x rdf:type ub:FullProfessor . ?x ub:name ?y1 . ?x ub:emailAddress ?y2 . ?x ub:telephone ?y3 .WHEN }""",
    "bgp5_degree_triangle": """SELECT ?x ?y ?z WHERE { ?x ub:memberOf ?z . ?x rdf:type ub:GraduateStudent . ?z ub:subOrganizationOf ?y . ?x ub:undergraduateDegreeFrom ?y . ?y rdf:type ub:University . ?z rdf:type ub:Department .WHEN }""",
    "bgp6_advisor_triangle": """SELECT ?x ?y ?z WHERE { ?x rdf:type ub:UndergraduateStudent . ?y rdf:type ub:FullProfessor . ?z rdf:type ub:Course . ?y ub:teacherOf ?z . ?x ub:advisor ?y . ?x ub:takesCourse ?z .WHEN }""",
    "bgp7_chain_const_end": """SELECT ?x ?y WHERE { ?x ub:worksFor ?y . ?x rdf:type ub:FullProfessor . ?y ub:subOrganizationOf <http://www.University0.edu> . ?y rdf:type ub:Department .WHEN }""",
}


def on_campus(spark: SparkSession, d: str, planned: bool = False) -> Store:
    return Store.of_quads(campus.quads(spark, d), planned)


def campus_sql(query: str, day: str = CAMPUS_DAY) -> str:
    """The joins of a query's patterns in SQL, put together from the words of its text."""
    words = query.split("{")[1].split("}")[0].replace("WHEN", "").split()
    full = lambda w: w[1:-1] if w[0] == "<" else w.replace("rdf:", campus.RDF).replace("ub:", campus.UB)
    at, conds, froms = {}, [], []
    for i in range(0, len(words), 4):
        n = f"f{i // 4}"
        froms.append(f"f {n}")
        for c, w in zip("spo", words[i : i + 3]):
            if w[0] == "?":
                conds += [f"{n}.{c} = {at[w]}"] if w in at else []
                at.setdefault(w, f"{n}.{c}")
            else:
                conds.append(f"{n}.{c} = '{full(w)}'")
    shown = query.split("WHERE")[0].split()[1:]
    return f"WITH f AS (SELECT DISTINCT s, p, o FROM ({campus.sql()}) WHERE t <= DATE '{day}') SELECT DISTINCT {', '.join(f'{at[v]} AS {v[1:]}' for v in shown)} FROM {', '.join(froms)} WHERE {' AND '.join(conds)}"


for _name, _q in TEMPLATES.items():
    graph(_name, _q.replace("WHEN", when(CAMPUS_DAY)), campus_sql(_q), on_campus, prefixes=LUBM)

_kept: dict = {}


def saved_store(name: str, make):
    """A store that is built, saved and opened when it is first asked for in a session."""

    def get(spark: SparkSession, d: str, planned: bool = True) -> Store:
        key = (name, d, spark.sparkContext.applicationId)
        if _kept.get(key) not in shared._made:
            _kept[key] = shared_dir(spark, name)
            make(spark, d).save(_kept[key])
        return Store.open(spark, _kept[key], planned)

    return get


saved_campus = saved_store("campus", on_campus)
for _i in (3, 5, 6):
    _name, _q = next((n, q) for n, q in TEMPLATES.items() if n.startswith(f"bgp{_i}"))
    graph(f"bgp_planned_saved_{_i}", _q.replace("WHEN", when(CAMPUS_DAY)), campus_sql(_q), saved_campus, prefixes=LUBM)
    graph(f"bgp_unplanned_saved_{_i}", _q.replace("WHEN", when(CAMPUS_DAY)), campus_sql(_q), lambda spark, d: saved_campus(spark, d, False), prefixes=LUBM)
_PLANNED = TEMPLATES["bgp3_member_triangle"]
graph("bgp_planned_by_statistics", _PLANNED.replace("WHEN", when(CAMPUS_DAY)), campus_sql(_PLANNED), lambda spark, d: on_campus(spark, d, True), prefixes=LUBM)
for _name, _q in {
    "bgp_join_sp": "SELECT ?p ?c ?x WHERE { ?p rdf:type ?c . ?x ?p <http://www.Course1.edu> .WHEN }",
    "bgp_join_op": "SELECT ?p ?u ?x WHERE { ?u ub:uses ?p . ?x ?p <http://www.Course1.edu> .WHEN }",
    "bgp_two_key_close": "SELECT ?x ?y ?z WHERE { ?x ub:memberOf ?z . ?z ub:subOrganizationOf ?y . ?x ub:undergraduateDegreeFrom ?y .WHEN }",
    "bgp_four_cycle": "SELECT ?x ?y ?u ?w WHERE { ?x ub:advisor ?y . ?y ub:worksFor ?w . ?x ub:memberOf ?u . ?w ub:subOrganizationOf ?v . ?u ub:subOrganizationOf ?v .WHEN }",
    "scan_repeated_var": "SELECT ?x ?p WHERE { ?x ?p ?x .WHEN }",
}.items():
    graph(_name, _q.replace("WHEN", when(CAMPUS_DAY)), campus_sql(_q), on_campus, prefixes=LUBM)


@other("cardinalities", f"WITH f AS (SELECT DISTINCT s, p, o FROM ({campus.sql()})) SELECT 'all' AS asked, count(*) AS n FROM f UNION ALL SELECT 'p', count(*) FROM f WHERE p = '{campus.UB}worksFor' UNION ALL SELECT 's p', count(*) FROM f WHERE s = 'http://www.Student4.edu' AND p = '{campus.UB}takesCourse' UNION ALL SELECT 'p o', count(*) FROM f WHERE p = '{campus.UB}memberOf' AND o = 'http://www.Department3.University1.edu' UNION ALL SELECT 's', count(*) FROM f WHERE s = 'http://www.Student4.edu'")
def cardinalities(spark, d):
    s, ub = saved_campus(spark, d), campus.UB
    rows = {"all": {}, "p": {"p": ub + "worksFor"}, "s p": {"s": "http://www.Student4.edu", "p": ub + "takesCourse"}, "p o": {"p": ub + "memberOf", "o": "http://www.Department3.University1.edu"}, "s": {"s": "http://www.Student4.edu"}}
    return spark.createDataFrame([(k, s.cardinality(**v)) for k, v in rows.items()], "asked string, n long")


def pair(name: str, query: str, on: str, where: str, shown: str) -> None:
    graph(name, query.replace("WHEN", when(DAY)), f"WITH f AS {facts_sql()} SELECT DISTINCT {shown} FROM f a JOIN f b ON {on} WHERE {where}")


pair("bgp_join_ss", "SELECT ?x ?a ?b WHERE { ?x ub:name ?a . ?x ub:emailAddress ?b .WHEN }", "a.s = b.s", "a.p = 'ub:name' AND b.p = 'ub:emailAddress'", "a.s AS x, a.o AS a, b.o AS b")
pair("bgp_join_oo", "SELECT ?x ?y ?z WHERE { ?x ub:teacherOf ?z . ?y ub:takesCourse ?z .WHEN }", "a.o = b.o", "a.p = 'ub:teacherOf' AND b.p = 'ub:takesCourse'", "a.s AS x, b.s AS y, a.o AS z")
pair("bgp_join_so", "SELECT ?x ?y ?z WHERE { ?x ub:advisor ?y . ?y ub:teacherOf ?z .WHEN }", "a.o = b.s", "a.p = 'ub:advisor' AND b.p = 'ub:teacherOf'", "a.s AS x, a.o AS y, b.o AS z")
pair("bgp_join_pp", f"SELECT ?p ?o WHERE {{ <{STUDENT}> ?p ?a . <http://univ1.example/dept3/student0> ?p ?o .WHEN }}", "a.p = b.p", f"a.s = '{STUDENT}' AND b.s = 'http://univ1.example/dept3/student0'", "a.p AS p, b.o AS o")
pair("bgp_cross", "SELECT ?x ?y WHERE { ?x rdf:type ub:University . ?y rdf:type ub:ResearchGroup .WHEN }", "true", "a.p = 'rdf:type' AND a.o = 'ub:University' AND b.p = 'rdf:type' AND b.o = 'ub:ResearchGroup'", "a.s AS x, b.s AS y")


@other("join_reduced_both", f"WITH f AS {facts_sql()}, a AS (SELECT s AS y, o AS z FROM f WHERE p = 'ub:teacherOf'), b AS (SELECT s AS x, o AS y FROM f WHERE p = 'ub:advisor') SELECT 'left' AS side, y, z AS other FROM a WHERE y IN (SELECT y FROM b) UNION ALL SELECT 'right', y, x FROM b WHERE y IN (SELECT y FROM a)")
def join_reduced_both(spark, d):
    state = lubm(spark, d).as_of(dt.date.fromisoformat(DAY))
    a, b = execute.reduced(execute.scan(state, Pattern(Var("y"), Const("ub:teacherOf"), Var("z"))), execute.scan(state, Pattern(Var("x"), Const("ub:advisor"), Var("y"))), ["y"])
    return a.select(F.lit("left").alias("side"), "y", F.col("z").alias("other")).unionAll(b.select(F.lit("right").alias("side"), "y", F.col("x").alias("other")))


# tables seen as quads


def mapped(*predicates: str):
    return lambda spark, d: Store.of_quads(mapping.quads(spark, d, predicates))


graph(
    "bgp3_triangle",
    "SELECT ?o ?c ?s ?n WHERE { ?o <placedBy> ?c . ?o <suppliedBy> ?s . ?c <inNation> ?n . ?s <inNation> ?n . filter ( t = 2000-01-01 ) . }",
    """SELECT DISTINCT 'order/' || o_orderkey AS o, 'customer/' || c_custkey AS c, 'supplier/' || s_suppkey AS s, 'nation/' || s_nationkey AS n
       FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey
       WHERE CAST(o_orderdate AS DATE) <= DATE '2000-01-01' AND CAST(l_shipdate AS DATE) <= DATE '2000-01-01'""",
    mapped("placedBy", "suppliedBy", "inNation"),
)
graph(
    "mapped_chain",
    "SELECT ?x ?y WHERE { ?x <placedBy> ?y . ?y <inNation> <nation/3> . filter ( t = 1998-01-01 ) . }",
    "SELECT DISTINCT 'order/' || o_orderkey AS x, 'customer/' || c_custkey AS y FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3 AND CAST(o_orderdate AS DATE) <= DATE '1998-01-01'",
    mapped("placedBy", "inNation"),
)
#: The seven shapes over tables: (patterns, SQL of the joined tables).
_O, _S = "CAST(o_orderdate AS DATE) <= DATE '{0}'", "CAST(l_shipdate AS DATE) <= DATE '{0}'"
MAPPED = {
    "shape1_star_semijoin": ("SELECT ?x WHERE {{ ?x a <Supplier> . ?x <inNation> <nation/3> .{0} }}", "SELECT 'supplier/' || s_suppkey AS x FROM supplier WHERE s_nationkey = 3", (RDF_TYPE, "inNation")),
    "shape2_star_two_attributes": ("SELECT ?x ?y1 ?y2 WHERE {{ ?x a <Customer> . ?x <inNation> <nation/5> . ?x <name> ?y1 . ?x <segment> ?y2 .{0} }}", "SELECT 'customer/' || c_custkey AS x, c_name AS y1, c_mktsegment AS y2 FROM customer WHERE c_nationkey = 5", (RDF_TYPE, "inNation", "name", "segment")),
    "shape3_triangle_types": ("SELECT ?x ?y ?z WHERE {{ ?x a <Order> . ?y a <Supplier> . ?z a <Part> . ?x <hasPart> ?z . ?z <soldBy> ?y . ?x <suppliedBy> ?y .{0} }}", f"""WITH l AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE {_S})
        SELECT DISTINCT 'order/' || o_orderkey AS x, 'supplier/' || c.l_suppkey AS y, 'part/' || a.l_partkey AS z FROM orders JOIN l a ON a.l_orderkey = o_orderkey JOIN l b ON b.l_partkey = a.l_partkey JOIN l c ON c.l_orderkey = o_orderkey AND c.l_suppkey = b.l_suppkey WHERE {_O}""", (RDF_TYPE, "hasPart", "soldBy", "suppliedBy")),
    "shape4_star_three_attributes": ("SELECT ?x ?y1 ?y2 ?y3 WHERE {{ ?x a <Order> . ?x <status> \"F\" . ?x <priority> ?y1 . ?x <placedBy> ?y2 . ?x <suppliedBy> ?y3 .{0} }}", f"SELECT DISTINCT 'order/' || o_orderkey AS x, o_orderpriority AS y1, 'customer/' || o_custkey AS y2, 'supplier/' || l_suppkey AS y3 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND {_O} AND {_S}", (RDF_TYPE, "status", "priority", "placedBy", "suppliedBy")),
    "shape5_triangle_reordered": ("SELECT ?x ?y ?z WHERE {{ ?x <suppliedBy> ?y . ?z <soldBy> ?y . ?x <hasPart> ?z . ?x <status> \"O\" .{0} }}", f"""WITH l AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE {_S})
        SELECT DISTINCT 'order/' || o_orderkey AS x, 'supplier/' || c.l_suppkey AS y, 'part/' || a.l_partkey AS z FROM orders JOIN l a ON a.l_orderkey = o_orderkey JOIN l b ON b.l_partkey = a.l_partkey JOIN l c ON c.l_orderkey = o_orderkey AND c.l_suppkey = b.l_suppkey WHERE o_orderstatus = 'O' AND {_O}""", ("suppliedBy", "soldBy", "hasPart", "status")),
    "shape6_triangle_same_nation": ("SELECT ?x ?y ?z ?n WHERE {{ ?x <placedBy> ?y . ?x <suppliedBy> ?z . ?y <inNation> ?n . ?z <inNation> ?n . ?n <inRegion> <region/2> .{0} }}", f"""SELECT DISTINCT 'order/' || o_orderkey AS x, 'customer/' || c_custkey AS y, 'supplier/' || s_suppkey AS z, 'nation/' || n_nationkey AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
        JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 2 AND {_O} AND {_S}""", ("placedBy", "suppliedBy", "inNation", "inRegion")),
    "shape7_chain_const_end": ("SELECT ?x ?y WHERE {{ ?x <placedBy> ?y . ?x a <Order> . ?y <inNation> <nation/7> . ?y a <Customer> .{0} }}", f"SELECT DISTINCT 'order/' || o_orderkey AS x, 'customer/' || c_custkey AS y FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 7 AND {_O}", ("placedBy", RDF_TYPE, "inNation")),
}
for _name, (_q, _sql, _preds) in MAPPED.items():
    graph(_name, _q.format(when("1999-06-10")), _sql.format("1999-06-10"), mapped(*_preds))
for _i in (3, 4, 5):
    _name, (_q, _sql, _preds) = next((n, x) for n, x in MAPPED.items() if n.startswith(f"shape{_i}"))
    _store = saved_store(f"shape{_i}", mapped(*_preds))
    graph(f"saved_{_name}", _q.format(when("1999-06-10")), _sql.format("1999-06-10"), _store)
    graph(f"saved_{_name}_uncounted", _q.format(when("1999-06-10")), _sql.format("1999-06-10"), lambda spark, d, store=_store: store(spark, d, False))
graph("mapped_type", "SELECT ?x ?n WHERE { ?x a <Nation> ; <name> ?n . }", "SELECT 'nation/' || n_nationkey AS x, n_name AS n FROM nation", mapped(RDF_TYPE, "name"))
graph(
    "mapped_duplicates",
    "SELECT count ?u ?k WHERE { ?u <did> ?k . filter ( t = 2024-01-15 ) . }",
    "SELECT DISTINCT 'user/' || user_id AS u, event_type AS k, CAST(1 AS BIGINT) AS n FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-15'",
    mapped("did"),
)
_ACTIVE = """SELECT s, t, op FROM (SELECT 'user/' || user_id AS s, CAST(ts AS DATE) AS t, arg_max(CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'INSERT' END, event_id) AS op
FROM events WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY 1, 2)"""
graph(
    "mapped_activity_asof",
    "SELECT ?u WHERE { ?u <active> <yes> . filter ( t = 2024-01-15 ) . }",
    f"SELECT s AS u FROM (SELECT s, arg_max(op, t) AS op FROM ({_ACTIVE}) WHERE t <= DATE '2024-01-15' GROUP BY s) WHERE op = 'INSERT'",
    lambda spark, d: Store.of_log(mapping.activity_log(spark, d)),
)

# projections, duplicates, limits

_F = facts_sql()
graph("select_star", f"SELECT * WHERE {{ ?x ub:advisor ?d . ?d ub:teacherOf ?u .{when(DAY)} }}", f"WITH f AS {_F} SELECT a.s AS x, a.o AS d, b.o AS u FROM f a JOIN f b ON a.o = b.s WHERE a.p = 'ub:advisor' AND b.p = 'ub:teacherOf'")
graph("select_subset", f"SELECT ?u WHERE {{ ?x ub:advisor ?d . ?d ub:teacherOf ?u .{when(DAY)} }}", f"WITH f AS {_F} SELECT DISTINCT b.o AS u FROM f a JOIN f b ON a.o = b.s WHERE a.p = 'ub:advisor' AND b.p = 'ub:teacherOf'")
graph("mod_distinct", f"SELECT distinct ?d WHERE {{ ?x ub:worksFor ?d .{when(DAY)} }}", f"SELECT DISTINCT o AS d FROM {_F} WHERE p = 'ub:worksFor'")
graph("mod_reduced", f"SELECT reduced ?d WHERE {{ ?x ub:memberOf ?d .{when(DAY)} }}", f"SELECT DISTINCT o AS d FROM {_F} WHERE p = 'ub:memberOf'")
graph("mod_count", f"SELECT count ?d WHERE {{ ?x ub:memberOf ?d .{when(DAY)} }}", f"SELECT o AS d, count(*) AS n FROM {_F} WHERE p = 'ub:memberOf' GROUP BY o")
graph("mod_duplicates", f"SELECT duplicates ?d WHERE {{ ?x ub:memberOf ?d .{when(DAY)} }}", f"SELECT o AS d FROM {_F} WHERE p = 'ub:memberOf' GROUP BY o HAVING count(*) > 1")
graph("mod_limit", "SELECT ?r ?n WHERE { ?r <name> ?n . ?r a <Region> . } LIMIT 10", "SELECT 'region/' || r_regionkey AS r, r_name AS n FROM region", mapped("name", RDF_TYPE))
_COURSES = f"SELECT DISTINCT s AS x FROM {_F} WHERE p = 'rdf:type' AND o = 'ub:Course'"


@other("mod_limit_cuts", f"SELECT least(7, count(*)) AS n, least(7, count(*)) AS of_them FROM ({_COURSES})")
def mod_limit_cuts(spark, d):
    """How many rows a limit leaves, and how many of them are among the answers without it."""
    q = PREFIXES + f"SELECT ?x WHERE {{ ?x rdf:type ub:Course .{when(DAY)} }}"
    s = lubm(spark, d)
    few = written(s.query(q + " LIMIT 7"), "few").withColumn("few", F.lit(1))
    return few.join(s.query(q).withColumn("there", F.lit(1)), "x", "left").agg(F.count("few").alias("n"), F.count("there").alias("of_them"))


# filters on values

graph("filter_eq", f"SELECT ?x ?d WHERE {{ ?x ub:worksFor ?d . filter( ?d = <{DEPT}> ) .{when(DAY)} }}", f"SELECT s AS x, o AS d FROM {_F} WHERE p = 'ub:worksFor' AND o = '{DEPT}'")
graph("filter_ne", f"SELECT ?x ?d WHERE {{ ?x ub:worksFor ?d . filter( ?d != <{DEPT}> ) .{when(DAY)} }}", f"SELECT s AS x, o AS d FROM {_F} WHERE p = 'ub:worksFor' AND o <> '{DEPT}'")
graph("filter_in", f"SELECT ?x ?c WHERE {{ ?x rdf:type ?c . filter( ?c in ub:Lecturer, ub:University, <nowhere> ) .{when(DAY)} }}", f"SELECT s AS x, o AS c FROM {_F} WHERE p = 'rdf:type' AND o IN ('ub:Lecturer', 'ub:University', 'nowhere')")
graph("filter_not_in", f"SELECT ?x ?c WHERE {{ ?x rdf:type ?c . filter( ?c not in ub:Course, ub:UndergraduateStudent ) .{when(DAY)} }}", f"SELECT s AS x, o AS c FROM {_F} WHERE p = 'rdf:type' AND o NOT IN ('ub:Course', 'ub:UndergraduateStudent')")
graph("filter_var_eq", f"SELECT ?x ?a WHERE {{ ?x ub:memberOf ?a . ?x ub:memberOf ?b . filter( ?a = ?b ) .{when(DAY)} }}", f"SELECT s AS x, o AS a FROM {_F} WHERE p = 'ub:memberOf'")
graph("filter_var_ne", f"SELECT ?x ?a ?b WHERE {{ ?x ub:worksFor ?a . ?x ub:worksFor ?b . filter( ?a != ?b ) .{when(DAY)} }}", f"WITH f AS {_F} SELECT a.s AS x, a.o AS a, b.o AS b FROM f a JOIN f b ON a.s = b.s AND a.o <> b.o WHERE a.p = 'ub:worksFor' AND b.p = 'ub:worksFor'")
graph("filter_literal", f"SELECT ?x WHERE {{ ?x ub:telephone ?n . filter( ?n = \"n/a\" ) .{when(DAY)} }}", f"SELECT s AS x FROM {_F} WHERE p = 'ub:telephone' AND o = 'n/a'")
graph(
    "filter_reaches",
    f"SELECT ?x WHERE {{ ?x ub:subOrganizationOf ?d . filter( ?x reaches <{DEPT}> via ub:subOrganizationOf ) .{when(DAY)} }}",
    f"WITH RECURSIVE f AS {_F}, r(node) AS (SELECT '{DEPT}' UNION SELECT f.s FROM f JOIN r ON f.o = r.node WHERE f.p = 'ub:subOrganizationOf') SELECT DISTINCT s AS x FROM f WHERE p = 'ub:subOrganizationOf' AND s IN (SELECT node FROM r)",
)

graph("filter_unbound", f"SELECT ?x WHERE {{ ?x ub:worksFor ?d . filter( ?no = <{DEPT}> ) .{when(DAY)} }}", f"SELECT s AS x FROM {_F} WHERE false")

# groups

graph("union2", f"SELECT ?x WHERE {{ {{ ?x ub:worksFor <{DEPT}> }} UNION {{ ?x ub:memberOf <{DEPT}> }}{when(DAY)} }}", f"SELECT DISTINCT s AS x FROM {_F} WHERE p IN ('ub:worksFor', 'ub:memberOf') AND o = '{DEPT}'")
graph("union3", f"SELECT ?x ?y WHERE {{ {{ ?x ub:advisor ?y }} UNION {{ ?x ub:teacherOf ?y }} UNION {{ ?y ub:worksFor ?x }}{when(DAY)} }}", f"WITH f AS {_F} SELECT s AS x, o AS y FROM f WHERE p IN ('ub:advisor', 'ub:teacherOf') UNION SELECT o, s FROM f WHERE p = 'ub:worksFor'")
graph("union_joined", f"SELECT ?x ?c WHERE {{ ?x ub:teacherOf ?c . {{ ?x ub:worksFor <{DEPT}> }} UNION {{ ?x ub:memberOf <{DEPT}> }}{when(DAY)} }}", f"WITH f AS {_F} SELECT DISTINCT a.s AS x, a.o AS c FROM f a JOIN f b ON a.s = b.s WHERE a.p = 'ub:teacherOf' AND b.p IN ('ub:worksFor', 'ub:memberOf') AND b.o = '{DEPT}'")
graph("union_partial", f"SELECT ?x ?y ?z WHERE {{ {{ ?x ub:advisor ?y }} UNION {{ ?x ub:worksFor ?z }}{when(DAY)} }}", f"WITH f AS {_F} SELECT s AS x, o AS y, CAST(NULL AS VARCHAR) AS z FROM f WHERE p = 'ub:advisor' UNION ALL SELECT s, NULL, o FROM f WHERE p = 'ub:worksFor'")
graph("nested_group", f"SELECT ?x ?d ?c WHERE {{ ?x ub:advisor ?d . {{ ?d ub:worksFor ?w . {{ ?d ub:teacherOf ?c .{when(DAY)} }} }} }}", f"WITH f AS {_F} SELECT DISTINCT a.s AS x, a.o AS d, c.o AS c FROM f a JOIN f b ON a.o = b.s JOIN f c ON a.o = c.s WHERE a.p = 'ub:advisor' AND b.p = 'ub:worksFor' AND c.p = 'ub:teacherOf'")
graph("optional_left", f"SELECT ?x ?d ?c WHERE {{ ?x ub:worksFor ?d . OPTIONAL {{ ?x ub:teacherOf ?c }}{when(DAY)} }}", f"WITH f AS {_F} SELECT a.s AS x, a.o AS d, b.o AS c FROM (SELECT * FROM f WHERE p = 'ub:worksFor') a LEFT JOIN (SELECT * FROM f WHERE p = 'ub:teacherOf') b ON a.s = b.s")
graph(
    "optional_chained",
    f"SELECT ?x ?d ?c ?y WHERE {{ ?x ub:worksFor ?d . OPTIONAL {{ ?x ub:teacherOf ?c }} OPTIONAL {{ ?y ub:takesCourse ?c . ?y ub:memberOf ?d }}{when(DAY)} }}",
    f"""WITH f AS {_F}, a AS (SELECT s AS x, o AS d FROM f WHERE p = 'ub:worksFor'), b AS (SELECT s AS x, o AS c FROM f WHERE p = 'ub:teacherOf'),
        y AS (SELECT t.s AS y, t.o AS c, m.o AS d FROM f t JOIN f m ON t.s = m.s WHERE t.p = 'ub:takesCourse' AND m.p = 'ub:memberOf'), ab AS (SELECT a.*, b.c FROM a LEFT JOIN b USING (x))
        SELECT DISTINCT ab.x, ab.d, coalesce(ab.c, y.c) AS c, y.y FROM ab LEFT JOIN y ON y.d = ab.d AND (ab.c IS NULL OR y.c = ab.c)""",
)
graph("lists_semicolon_comma", f"SELECT ?x ?a ?b WHERE {{ ?x ub:teacherOf ?a , ?b ; ub:worksFor <{DEPT}> .{when(DAY)} }}", f"WITH f AS {_F} SELECT a.s AS x, a.o AS a, b.o AS b FROM f a JOIN f b ON a.s = b.s JOIN f c ON a.s = c.s WHERE a.p = 'ub:teacherOf' AND b.p = 'ub:teacherOf' AND c.p = 'ub:worksFor' AND c.o = '{DEPT}'")
graph("blank_nodes", f"SELECT ?d WHERE {{ [ ub:worksFor ?d ; ub:teacherOf [] ] ub:teacherOf _:c .{when(DAY)} }}", f"WITH f AS {_F} SELECT DISTINCT a.o AS d FROM f a JOIN f b ON a.s = b.s WHERE a.p = 'ub:worksFor' AND b.p = 'ub:teacherOf'")
graph("unknown_constant_empty", f"SELECT ?x ?y WHERE {{ ?x ub:worksFor <nowhere> . ?x ub:teacherOf ?y .{when(DAY)} }}", f"WITH f AS {_F} SELECT a.s AS x, b.o AS y FROM f a JOIN f b ON a.s = b.s WHERE a.p = 'ub:worksFor' AND a.o = 'nowhere' AND b.p = 'ub:teacherOf'")

# updates on the changing store; the facts that hold afterwards

_NOW = held_sql(None)


def updated(name: str, text_: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return changing(spark, d).update(PREFIXES + text_, dt.date(2030, 1, 1)).query("SELECT ?s ?p ?o WHERE { ?s ?p ?o }")

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = sql


updated("upd_insert_data", 'INSERT DATA { <new/1> ub:rank "Lecturer" . <new/1> ub:worksFor <new/2> . }', f"SELECT s, p, o FROM {_NOW} UNION SELECT * FROM (VALUES ('new/1', 'ub:rank', 'Lecturer'), ('new/1', 'ub:worksFor', 'new/2'))")
updated("upd_delete_pattern", 'DELETE { ?x ub:rank "Senior Lecturer" . }', f"SELECT s, p, o FROM {_NOW} WHERE NOT (p = 'ub:rank' AND o = 'Senior Lecturer')")
updated("upd_delete_insert", 'DELETE { ?x ub:rank "Senior Lecturer" } INSERT { ?x ub:rank "Reader" . }', f"WITH n AS {_NOW} SELECT s, p, o FROM n WHERE NOT (p = 'ub:rank' AND o = 'Senior Lecturer') UNION SELECT s, p, 'Reader' FROM n WHERE p = 'ub:rank' AND o = 'Senior Lecturer'")
updated("upd_delete_data", 'DELETE DATA { <nobody> ub:rank "Reader" . <http://univ1.example/dept0/prof1> ub:rank "Full Professor" . }', f"SELECT s, p, o FROM {_NOW} WHERE NOT (s = 'http://univ1.example/dept0/prof1' AND p = 'ub:rank' AND o = 'Full Professor')")


@other("upd_reinsert_idempotent", f"SELECT s, p, o FROM {facts_sql(None)}")
def upd_reinsert(spark, d):
    s = lubm(spark, d)
    return s.insert(s.quads.where("p = 'ub:worksFor'"), dt.date(2030, 1, 1)).query("SELECT ?s ?p ?o WHERE { ?s ?p ?o }")


@other("upd_log_rows", f"SELECT 'DELETE' AS op, s, p, o, DATE '2030-01-01' AS t, CAST(5 AS BIGINT) AS seq FROM {_NOW} WHERE p = 'ub:officeRoom'")
def upd_log_rows(spark, d):
    return changing(spark, d).changes(PREFIXES + "DELETE { ?s ub:officeRoom ?o }", dt.date(2030, 1, 1), 5)


@other("upd_edge", f"""SELECT s, p, o FROM {_NOW} WHERE NOT (s = 'http://univ1.example/dept0/prof1' AND p = 'ub:rank' AND o = 'Full Professor')
    UNION SELECT 'http://univ1.example/dept0/prof1', 'ub:rank', 'Emeritus' FROM {_NOW} WHERE s = 'http://univ1.example/dept0/prof1' AND p = 'ub:rank' AND o = 'Full Professor'""")
def upd_edge(spark, d):
    who = "http://univ1.example/dept0/prof1"
    s = changing(spark, d).update_edge((who, "ub:rank", "Full Professor"), (who, "ub:rank", "Emeritus"), dt.date(2030, 1, 1))
    return s.query("SELECT ?s ?p ?o WHERE { ?s ?p ?o }")


@other("upd_today", "SELECT 'INSERT' AS op, 'a' AS s, 'p' AS p, 'b' AS o, current_date AS t, CAST(0 AS BIGINT) AS seq")
def upd_today(spark, d):
    return changing(spark, d).changes("INSERT DATA { <a> <p> <b> }")


def _log(spark, d):
    return table(spark, d, "change_log").select("op", "s", "p", "o", "t", "seq")


def early_store(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """A new store of the log rows that arrived first, and the rows that came later."""
    path, log = shared_dir(spark, "store"), _log(spark, d)
    late = F.coalesce(F.pmod("seq", F.lit(10)) == 3, F.lit(True))
    Store.of_log(log.where(~late)).save(path)
    return path, log.where(late)


_ALL_THAT_IS = f"SELECT s, p, o, t_from, t_to FROM ({_SPELLS}) WHERE op = 'INSERT'"


@other("upd_saved_store", _ALL_THAT_IS)
def upd_saved_store(spark, d):
    """Saved, extended, opened again."""
    path, late = early_store(spark, d)
    saved.Saved(spark, path).extend(late)
    return Store.open(spark, path).periods


@other("upd_saved_counts", f"SELECT s, p, count(*) AS n FROM {held_sql(None)} GROUP BY s, p")
def upd_saved_counts(spark, d):
    path, late = early_store(spark, d)
    saved.Saved(spark, path).extend(late)
    return Store.open(spark, path).counts("sp")


@other("upd_saved_compacted", _ALL_THAT_IS)
def upd_saved_compacted(spark, d):
    path, late = early_store(spark, d)
    saved.Saved(spark, path).extend(late).compacted()
    return Store.open(spark, path).periods


@other("stream_into_store", f"SELECT s, o FROM {held_sql(DAY)} WHERE p = 'ub:worksFor'")
def stream_into_store(spark, d):
    """Later rows come as a stream of files into a store that has rows."""
    path, late = early_store(spark, d)
    feed = shared_dir(spark, "feed")
    late.write.parquet(feed)
    log_stream.append(log_stream.read_log(spark, feed), path, shared_dir(spark, "progress")).awaitTermination()
    return Store.open(spark, path).query(PREFIXES + _WORKS.format(when(DAY)))


# statistics

for _by in ("p", "sp", "op", "s", "o", "so"):
    _cols = ", ".join(_by)
    other(f"stat_{_by}", f"SELECT {_cols}, count(*) AS n FROM {facts_sql(None)} GROUP BY {_cols}")(lambda spark, d, by=_by: lubm(spark, d).statistics(*by))


@other("triple_count", f"SELECT count(*) AS n FROM {facts_sql(None)}")
def triple_count(spark, d):
    return lubm(spark, d).current().facts.distinct().agg(F.count("*").alias("n"))


@other("predicate_dump", f"SELECT DISTINCT p FROM {facts_sql(None)}")
def predicate_dump(spark, d):
    return lubm(spark, d).query("SELECT ?p WHERE { ?s ?p ?o }")


@other("node_edges", f"WITH f AS {facts_sql(None)} SELECT node, CAST(sum(a) AS BIGINT) AS n_out, CAST(sum(b) AS BIGINT) AS n_in FROM (SELECT s AS node, 1 AS a, 0 AS b FROM f UNION ALL SELECT o, 0, 1 FROM f) GROUP BY node")
def node_edges(spark, d):
    return S.node_edges(lubm(spark, d).current().facts.distinct())


@other("var_ranges", f"SELECT p, min(s) AS s_min, max(s) AS s_max, min(o) AS o_min, max(o) AS o_max FROM {facts_sql(None)} GROUP BY p")
def var_ranges(spark, d):
    f = lubm(spark, d).current().facts
    return f.groupBy("p").agg(F.min("s").alias("s_min"), F.max("s").alias("s_max"), F.min("o").alias("o_min"), F.max("o").alias("o_max"))


# dictionaries and terms

_TERMS = "(SELECT s AS term FROM temporal_quads WHERE s IS NOT NULL UNION SELECT o FROM temporal_quads WHERE o IS NOT NULL)"


def _terms(spark, d):
    q = table(spark, d, "temporal_quads")
    return q.select(F.col("s").alias("term")).unionAll(q.select("o"))


@other("dict_ids", f"SELECT row_number() OVER (ORDER BY encode(term)) AS id, term FROM {_TERMS}")
def dict_ids(spark, d):
    return T.dictionary(_terms(spark, d))


@other("dict_roundtrip", "SELECT s, p, o, t FROM temporal_quads WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL AND t IS NOT NULL")
def dict_roundtrip(spark, d):
    q = lubm(spark, d).quads
    nodes, preds = T.dictionary(_terms(spark, d)), T.dictionary(q, "p")
    return T.decode(T.encode(q, nodes, preds), nodes, preds).select("s", "p", "o", "t")


@other("iri_prefix_split", f"SELECT term, CASE WHEN regexp_matches(term, '^.*/.+$') THEN regexp_extract(term, '^(.*)/.+$', 1) ELSE 'single' END AS prefix, CASE WHEN regexp_matches(term, '^.*/.+$') THEN regexp_extract(term, '^.*/(.+)$', 1) ELSE term END AS suffix FROM {_TERMS}")
def iri_prefix_split(spark, d):
    t = _terms(spark, d).where("term IS NOT NULL").distinct()
    return t.select("term", T.iri_prefix(F.col("term")).alias("prefix"), T.iri_suffix(F.col("term")).alias("suffix"))


_LITERALS = "(SELECT DISTINCT x FROM (SELECT o AS x FROM change_log UNION ALL SELECT CAST(l_quantity AS BIGINT)::VARCHAR FROM lineitem UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION ALL SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') FROM events) WHERE x IS NOT NULL)"


def _literals(spark, d):
    parts = [
        table(spark, d, "change_log").select(F.col("o").alias("x")),
        table(spark, d, "lineitem").select(F.col("l_quantity").cast("bigint").cast("string")),
        table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd")),
        table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.where("x IS NOT NULL").distinct()


@other(
    "literal_classify",
    f"""SELECT x, CASE WHEN regexp_matches(x, '^[+-]?[0-9]+$') THEN 'integer' WHEN regexp_matches(x, '^[+-]?([0-9]+[.][0-9]*|[.][0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'double'
        WHEN x IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(x, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN 'date'
        WHEN regexp_matches(x, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}$') THEN 'datetime' ELSE 'string' END AS kind FROM {_LITERALS}""",
)
def literal_classify(spark, d):
    return _literals(spark, d).select("x", T.literal_kind(F.col("x")).alias("kind"))


@other("datetime_to_number", f"SELECT x, CAST(regexp_replace(x, '[^0-9]', '', 'g') AS DOUBLE) AS number FROM {_LITERALS} WHERE regexp_matches(x, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}$')")
def datetime_to_number(spark, d):
    return _literals(spark, d).select("x", T.datetime_number(F.col("x")).alias("number")).where("number IS NOT NULL")


@other("integer_width", f"SELECT x, CASE WHEN try_cast(x AS HUGEINT) BETWEEN -2147483648 AND 2147483647 THEN 'int' WHEN try_cast(x AS HUGEINT) BETWEEN 0 AND 4294967295 THEN 'unsigned' ELSE 'long' END AS width FROM {_LITERALS} WHERE regexp_matches(x, '^[+-]?[0-9]+$')")
def integer_width(spark, d):
    return _literals(spark, d).select("x", T.integer_width(F.col("x")).alias("width")).where("width IS NOT NULL")


@other("reification_test", "SELECT p, regexp_matches(p, '#(Statement|subject|predicate|object)$') AS about FROM predicate_dict")
def reification_test(spark, d):
    return table(spark, d, "predicate_dict").select("p", T.about_statement(F.col("p")).alias("about"))


@other("dict_hash_collisions", f"SELECT CAST('0x' || substr(md5(term), 1, 4) AS BIGINT) AS id, count(*) AS n FROM {_TERMS} GROUP BY 1 HAVING count(*) > 1")
def dict_hash_collisions(spark, d):
    """With 16 bits, so that there are some."""
    return T.collisions(_terms(spark, d), hashed=lambda c: F.conv(F.substring(F.md5(c), 1, 4), 16, 10).cast("long"))


@other("dict_hashed_ids", f"SELECT count(*) AS terms, count(*) AS ids FROM {_TERMS}")
def dict_hashed_ids(spark, d):
    t = _terms(spark, d).where("term IS NOT NULL")
    return t.agg(F.count_distinct("term").alias("terms"), F.count_distinct(T.hashed_id(F.col("term"))).alias("ids"))


@other("numbers_near", "SELECT l_quantity, count(*) AS n FROM lineitem WHERE abs(l_extendedprice / l_quantity - round(l_extendedprice / l_quantity)) <= 1e-8 GROUP BY 1")
def numbers_near(spark, d):
    x = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, d, "lineitem").where(T.near(x, F.round(x))).groupBy("l_quantity").agg(F.count("*").alias("n"))


# text in and out

@other(
    "quads_as_lines",
    r"""SELECT '<' || s || '> <' || p || '> ' || CASE WHEN regexp_matches(o, '^[^ \t<>"]*:[^ \t<>"]*$') THEN '<' || o || '>'
        ELSE '"' || replace(replace(replace(replace(replace(o, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"' END || ' <' || strftime(t, '%Y-%m-%d') || '> .' AS value
        FROM temporal_quads WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL AND t IS NOT NULL""",
)
def quads_as_lines(spark, d):
    return text.as_lines(lubm(spark, d).quads)


@other("source_quads", f"SELECT regexp_extract(line, '^[ \\t]*<([^>]+)>', 1) AS s, count(*) AS n FROM ({_LINES}) WHERE says AND good GROUP BY 1")
def source_quads(spark, d):
    """Build files, read with their faulty lines."""
    path = shared_dir(spark, "lines")
    table(spark, d, "quad_lines").select("line").write.text(path)
    return text.read_quads(spark, path).where("reason IS NULL").groupBy("s").agg(F.count("*").alias("n"))


@other("source_triples", f"SELECT s, p, o, CAST(NULL AS VARCHAR) AS reason FROM {facts_sql()} UNION ALL SELECT NULL, NULL, NULL, 'bad or missing object' UNION ALL SELECT NULL, NULL, NULL, 'missing dot or surplus term'")
def source_triples(spark, d):
    """Insert files: facts written as lines, with two faulty ones among them."""
    path = shared_dir(spark, "triples")
    bad = spark.createDataFrame([("<a> <b> .",), ("<a> <b> <c> <2022-01-01> .",), ("# a note",), ("",)], "value string")
    text.as_triples(lubm(spark, d).as_of(dt.date.fromisoformat(DAY)).facts.distinct()).unionAll(bad).write.text(path)
    return text.read_triples(spark, path).select("s", "p", "o", "reason")


@other("source_turtle", f"SELECT s, p, o, CAST(NULL AS VARCHAR) AS error FROM {facts_sql()} WHERE p = 'rdf:type'")
def source_turtle(spark, d):
    """Turtle files of typed things, a prefix and a list of predicates each."""
    path = shared_dir(spark, "turtle")
    f = lubm(spark, d).as_of(dt.date.fromisoformat(DAY)).facts.where("p = 'rdf:type'").distinct()
    body = f.select(F.concat(F.lit("<"), "s", F.lit("> r:type <"), "o", F.lit("> .")).alias("line"))
    files = body.groupBy(F.pmod(F.xxhash64("line"), F.lit(8)).alias("file")).agg(F.concat_ws("\n", F.lit("@prefix r: <rdf:> ."), F.array_join(F.collect_list("line"), "\n")).alias("value"))
    files.write.partitionBy("file").text(path)
    return turtle.read_turtle(spark, path).select("s", "p", "o", "error")


@other("source_query_file", f"SELECT s, o FROM {facts_sql()} WHERE p = 'ub:worksFor'")
def source_query_file(spark, d):
    """A query out of a file on the driver, with comments and line breaks."""
    with tempfile.NamedTemporaryFile("w", suffix=".rq") as f:
        f.write("# who works where\n" + PREFIXES + "\nSELECT ?s ?o WHERE\n{\n\t?s ub:worksFor ?o .  # one pattern\n" + when(DAY) + "\n}\n")
        f.flush()
        return lubm(spark, d).answer(parse_file(f.name))


@other("built_store_query", f"SELECT s, o FROM {held_sql(DAY)} WHERE p = 'ub:worksFor'")
def built_store_query(spark, d):
    """Builds the store on disk from the log, opens it and queries it as of a day."""
    path = shared_dir(spark, "store")
    changing(spark, d).save(path)
    return Store.open(spark, path).query(PREFIXES + _WORKS.format(when(DAY)))


@other("stream_changes_by_day", "SELECT t AS day, upper(trim(op)) AS op, count(*) AS n FROM change_log WHERE t IS NOT NULL GROUP BY 1, 2")
def stream_changes_by_day(spark, d):
    """The log read as a stream to its end; the result is as small as the calendar."""
    from pathlib import Path

    path = Path(f"{d}/change_log.parquet")
    source = log_stream.read_log(spark, str(path)) if path.is_dir() else log_stream.read_log(spark, d, pathGlobFilter=path.name)
    name = f"by_day_{uuid.uuid4().hex[:8]}"
    q = log_stream.changes_by_day(source).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
