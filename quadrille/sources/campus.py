"""Relational tables seen as the facts of universities, in the vocabulary of a public benchmark ontology.

Nations are departments, regions universities, suppliers professors, customers students and parts
courses and research groups.  The rules are SQL that Spark and other engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.functions.shared import table

# fixed values
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
UB = "http://swat.cse.lehigh.edu/onto/univ-bench.owl#"

_DAY = "DATE '2022-01-01' + CAST({0} % 150 AS INT)"
_UNIV = "'http://www.University' || CAST({0} AS STRING) || '.edu'"
_DEPT = "'http://www.Department' || CAST(n_nationkey AS STRING) || '.University' || CAST(n_regionkey AS STRING) || '.edu'"
_PROF, _COURSE, _GROUP = ("'http://www." + x + "' || CAST({0} AS STRING) || '.edu'" for x in ("Professor", "Course", "Group"))
_STUDENT = "'http://www.Student' || CAST(c_custkey AS STRING) || '.edu'"
_NATION = {"supplier": "s_nationkey", "customer": "c_nationkey", "part": "(p_size % 25)"}


def _rule(p: str, s: str, o: str, day: str, tables: str, where: str = "") -> tuple[str, str]:
    return p, f"SELECT {s} AS s, '{p}' AS p, {o} AS o, {_DAY.format(day)} AS t FROM {tables}{where}"


def _type(s: str, cls: str, day: str, tables: str, where: str = "") -> tuple[str, str]:
    return _rule(RDF + "type", s, f"'{UB}{cls}'", day, tables, where)


def _in(name: str) -> str:
    return f"{{{name}}} JOIN {{nation}} ON n_nationkey = {_NATION[name]}"


_LINES = "{lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey"
#: (predicate, SELECT of s, p, o, t); tables stand in braces.
RULES = [
    _type(_UNIV.format("r_regionkey"), "University", "r_regionkey", "{region}"),
    _type(_DEPT, "Department", "n_nationkey", "{nation}"),
    _rule(UB + "subOrganizationOf", _DEPT, _UNIV.format("n_regionkey"), "n_nationkey", "{nation}"),
    _type(_GROUP.format("p_partkey"), "ResearchGroup", "p_partkey", "{part}"),
    _rule(UB + "subOrganizationOf", _GROUP.format("p_partkey"), _DEPT, "p_partkey", _in("part")),
    _type(_COURSE.format("p_partkey"), "Course", "p_partkey", "{part}"),
    _type(_PROF.format("s_suppkey"), "FullProfessor", "s_suppkey", "{supplier}"),
    _rule(UB + "worksFor", _PROF.format("s_suppkey"), _DEPT, "s_suppkey", _in("supplier")),
    _rule(UB + "name", _PROF.format("s_suppkey"), "s_name", "s_suppkey", "{supplier}"),
    _rule(UB + "emailAddress", _PROF.format("s_suppkey"), "'p' || CAST(s_suppkey AS STRING) || '@campus.example'", "s_suppkey", "{supplier}"),
    _rule(UB + "telephone", _PROF.format("s_suppkey"), "'tel ' || CAST(s_suppkey % 997 AS STRING)", "s_suppkey", "{supplier}"),
    _type(_STUDENT, "UndergraduateStudent", "c_custkey", "{customer}", " WHERE c_custkey % 3 > 0"),
    _type(_STUDENT, "GraduateStudent", "c_custkey", "{customer}", " WHERE c_custkey % 3 = 0"),
    _rule(UB + "memberOf", _STUDENT, _DEPT, "c_custkey", _in("customer")),
    _rule(UB + "undergraduateDegreeFrom", _STUDENT, _UNIV.format("(c_custkey % 5)"), "c_custkey", "{customer}"),
    _rule(UB + "teacherOf", _PROF.format("l_suppkey"), _COURSE.format("l_partkey"), "l_partkey", "{lineitem}"),
    _rule(UB + "takesCourse", _STUDENT, _COURSE.format("l_partkey"), "l_orderkey", _LINES),
    _rule(UB + "advisor", _STUDENT, _PROF.format("l_suppkey"), "l_orderkey", _LINES, " WHERE l_linenumber = 1"),
    # what the predicates are, which makes them subjects and objects too; a region lies in itself
    _type(f"'{UB}takesCourse'", "Property", "r_regionkey", "{region}"),
    _rule(UB + "uses", _UNIV.format("r_regionkey"), f"'{UB}takesCourse'", "r_regionkey", "{region}"),
    _rule(UB + "partOf", _UNIV.format("r_regionkey"), _UNIV.format("(r_regionkey % 3)"), "r_regionkey", "{region}"),
]
TABLES = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem")


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``s, p, o, t`` of the tables; facts may be repeated. A pattern's constants reach the rules, so only the tables it needs are read."""
    return spark.sql(sql("{{{0}}}"), **{n: table(spark, sf_dir, n) for n in TABLES})


def sql(name: str = "{0}") -> str:
    """The rules as one query over the tables."""
    return " UNION ALL ".join(q.format(**{n: name.format(n) for n in TABLES}) for _, q in RULES)
