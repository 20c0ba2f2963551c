"""Text, Turtle, terms, log pages and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quadrille.functions import terms as T
from quadrille.operators import log_pages
from quadrille.plans.sparql import RDF_TYPE, ParseError
from quadrille.sources import text, turtle
from quadrille.store import Store
from quadrille.streaming import log_stream

D = dt.date


def test_quads_written_and_read(spark, tmp_path):
    rows = [("http://a/x", "ub:p", "http://a/y", D(2022, 1, 1)), ("s", "p", 'say "no" \\ or\ttab\nline', D(2024, 2, 29)), ("s", "p", "é 表", D(1, 1, 1)), (None, "p", "o", D(2022, 1, 1))]
    d = spark.createDataFrame(rows, "s string, p string, o string, t date")
    text.write_quads(d, str(tmp_path / "q"))
    got = text.read_quads(spark, str(tmp_path / "q"))
    assert {(r.s, r.p, r.o, r.t) for r in got.collect()} == set(rows[:3])
    (tmp_path / "bad").write_text("<a> <b> <c> .\n\n# note\n<a> <b> <c> <2022-01-01> .\n")
    assert sorted((r.s or "", r.reason or "") for r in text.read_quads(spark, str(tmp_path / "bad")).collect()) == [("", "missing time"), ("a", "")]


def test_triples(spark, tmp_path):
    (tmp_path / "t").write_text('<a> <p> <b> .\n<a> <p> "l \\"x\\""@en.\nnothing\n<a> <p> .\n\n# note\n<a> <p> <o> <t> .\n<a> <p> "\x01\\\\n\\n\\\\" .\n')
    got = text.read_triples(spark, str(tmp_path / "t")).collect()
    assert {(r.s, r.p, r.o) for r in got if not r.reason} == {("a", "p", "b"), ("a", "p", 'l "x"'), ("a", "p", "\x01\\n\n\\")}
    assert {(r.line, r.reason) for r in got if r.reason} == {("nothing", "bad or missing subject"), ("<a> <p> .", "bad or missing object"), ("<a> <p> <o> <t> .", "missing dot or surplus term")}


TTL = """@prefix ex: <http://ex.org/> . @base <http://b.org/> . # note
PREFIX q: <q:>
ex:a a ex:C ; ex:p <rel> , "lit"@en , 'x'^^ex:t , 5 , -1.5e3 , true ; .
<full:iri> q:r [ ex:p ex:b ; ex:q _:n ] . _:n ex:l ( 1 ex:z ) .
[] ex:p \"\"\"long "quoted"
text\\u00e9\"\"\" .
"""


def test_turtle(spark, tmp_path):
    got = list(turtle.triples(TTL))
    e = "http://ex.org/"
    assert got[:7] == [(e + "a", RDF_TYPE, e + "C"), (e + "a", e + "p", "http://b.org/rel"), (e + "a", e + "p", "lit"), (e + "a", e + "p", "x"), (e + "a", e + "p", "5"), (e + "a", e + "p", "-1.5e3"), (e + "a", e + "p", "true")]
    assert ("full:iri", "q:r", "_:g1") in got and ("_:g1", e + "q", "_:n") in got
    assert got[-1][2] == 'long "quoted"\ntexté' and len(got) == 16
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.ttl").write_text(TTL)
    (tmp_path / "f" / "b.ttl").write_text("nope:x <p> <o> .")
    d = turtle.read_turtle(spark, str(tmp_path / "f"))
    assert d.where("error IS NULL").count() == 16 and d.where("error IS NOT NULL").count() == 1
    with pytest.raises(ParseError):
        turtle.triples("<a> <b>")
    (tmp_path / "g").mkdir()
    for n in "ab":
        (tmp_path / "g" / n).write_text("[] <p> _:b .")
    assert len({r.s for r in turtle.read_turtle(spark, str(tmp_path / "g")).collect()}) == 2 == len({r.o for r in turtle.read_turtle(spark, str(tmp_path / "g")).collect()})


def test_terms(spark):
    d = spark.createDataFrame([("http://a/b/c",), ("http://a/b/",), ("abc",), ("/x",), ("2022-01-10",), ("2022-01-10 11:12:13",), ("-5",), ("3000000000",), ("99999999999",), ("1" * 25,), ("4.5e3",), ("true",), (None,)], "x string")
    x = F.col("x")
    rows = {r.x: r for r in d.select("x", T.iri_prefix(x).alias("pre"), T.iri_suffix(x).alias("suf"), T.literal_kind(x).alias("kind"), T.datetime_number(x).alias("num"), T.integer_width(x).alias("w")).collect()}
    assert (rows["http://a/b/c"].pre, rows["http://a/b/c"].suf) == ("http://a/b", "c")
    assert (rows["http://a/b/"].pre, rows["http://a/b/"].suf) == ("http://a", "b/")
    assert (rows["abc"].pre, rows["abc"].suf, rows["/x"].pre) == ("single", "abc", "")
    assert rows["2022-01-10 11:12:13"].num == 20220110111213.0 and rows["abc"].num is None
    assert [rows[k].kind for k in ("2022-01-10", "2022-01-10 11:12:13", "-5", "4.5e3", "true", "abc")] == ["date", "datetime", "integer", "double", "boolean", "string"]
    assert [rows[k].w for k in ("-5", "3000000000", "99999999999", "1" * 25, "abc")] == ["int", "unsigned", "long", "double", None]
    assert spark.range(1).select(T.near(F.lit(1.0), F.lit(1.0 + 1e-9))).first()[0]


def test_dictionary(spark):
    d = spark.createDataFrame([("b",), ("a",), (None,), ("a",), ("",)], "term string")
    assert sorted(map(tuple, T.dictionary(d).collect())) == [(1, ""), (2, "a"), (3, "b")]
    assert T.dictionary(d.limit(0)).collect() == []


def test_log_pages(spark):
    rows = [(1, 2, 7, 100, 10, 20), (1, 2, 7, 90, 10, 15), (2, -1, 7, 4096, 40, 30), (3, -1, 8, 5, 50, None), (4, -1, None, 5, 1, 2)]
    d = spark.createDataFrame(rows, "page_no long, next_page_no long, pid long, used_space long, min_ts long, max_ts long")
    assert {r.page_no for r in log_pages.overlapping(d, 18, 35).collect()} == {1, 2}
    assert {r.page_no for r in log_pages.overlapping(d, 60, 70).collect()} == {3}
    assert {tuple(r) for r in log_pages.directory(d).collect()} == {(7, 2, 1, 4196, 3996), (8, 1, 1, 5, 4091)}


def test_streams(spark, tmp_path):
    rows = [("INSERT", "a", "p", "b", D(2022, 1, 1), 1), ("DELETE", "a", "p", "b", D(2022, 1, 2), 2), ("INSERT", "a", "p", "b", D(2022, 1, 1), 1), ("INSERT", "z", "p", "b", D(2022, 3, 1), 3)]
    src = str(tmp_path / "in")
    for i, r in enumerate(rows):
        spark.createDataFrame([r], log_stream.LOG).coalesce(1).write.mode("append").parquet(src)
    q = log_stream.append(log_stream.deduplicated(log_stream.read_log(spark, src)), str(tmp_path / "store"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert Store.open(spark, str(tmp_path / "store")).log.count() == 3
    q = log_stream.append(log_stream.read_log(spark, src), str(tmp_path / "store2"), str(tmp_path / "cp2"))
    q.awaitTermination()
    q = log_stream.append(log_stream.read_log(spark, src), str(tmp_path / "store2"), str(tmp_path / "cp2"))
    q.awaitTermination()
    assert Store.open(spark, str(tmp_path / "store2")).log.count() == 4
    q = log_stream.changes_by_day(log_stream.read_log(spark, src)).writeStream.format("memory").queryName("by_day").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("by_day").collect()} == {(D(2022, 1, 1), "INSERT", 2), (D(2022, 1, 2), "DELETE", 1)}
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "a.nt").write_text("<a> <b> <c> <2022-01-01> .\n<a> <b> .\n")
    q = log_stream.read_lines(spark, str(lines)).writeStream.format("memory").queryName("lines").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.s, r.reason) for r in spark.table("lines").collect()} == {("a", None), (None, "missing object")}
