"""Parsing quad lines: good lines, reasons, odd input."""

import datetime as dt
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quadrille.sources import quad_lines as L

GOOD = [
    ("<a> <b> <c> <2022-01-10> .", ("a", "b", "c")),
    ('<a> <b> "x" <2022-01-10> .', ("a", "b", "x")),
    ('\t<a>  <b>\t"x y"@de-AT <2022-01-10>.\r', ("a", "b", "x y")),
    ('<a> <b> "say \\"no\\" \\\\ <or> not ."^^<xsd:string> <2024-02-29> . ', ("a", "b", 'say "no" \\ <or> not .')),
    ('<a> <b> "x\\ty" <2022-01-10> .', ("a", "b", "x\ty")),
    ('<a> <b> "x\ny" <2022-01-10> .', ("a", "b", "x\ny")),
]
BAD = {
    "<a> <b> <c> .": "missing time",
    "<a> <b> .": "missing object",
    "<a> .": "missing predicate",
    ".": "missing subject",
    "<> <b> <c> <2022-01-10> .": "empty subject",
    '<a> <b> "" <2022-01-10> .': "empty object",
    "<a> <b> <c> <> .": "empty time",
    '"a" <b> <c> <2022-01-10> .': "subject not in angle brackets",
    "<a> <b> c <2022-01-10> .": "object not delimited",
    '<a> <b> "c <2022-01-10> .': "object not closed",
    "<a <b> <c> <2022-01-10> .": "subject not closed",
    "<a b> <b> <c> <2022-01-10> .": "character not allowed in subject",
    "<a> <b> <c> <d> <2022-01-10> .": "surplus term",
    "<a> <b> <c> <2022-1-10> .": "time is not a day YYYY-MM-DD",
    "<a> <b> <c> <2022-02-30> .": "no such day",
    "<a> <b> <c> <0000-01-01> .": "no such day",
    "<a> <b> <c> 2022-01-10 .": "time not in angle brackets",
    "<a> <b> <c> <2022-01-10>": "missing dot",
    "<a> <b> <c> <2022-01-10> . x": "text after the dot",
    '<a> <b> "c"@ <2022-01-10> .': "bad language or type tag",
    '<a> <b> "c" @en <2022-01-10> .': "time not in angle brackets",
    "<a><b> <c> <2022-01-10> .": "terms not parted",
    "<a> <b> <2022-01-10> .": "missing object",
}


def a_day(text):
    try:
        return bool(dt.date.fromisoformat(text))
    except ValueError:
        return False


def frame(spark, lines):
    return spark.createDataFrame([(i, "f", x, "s") for i, x in enumerate(lines)], "line_id long, file_name string, line string, s string")


def test_good_lines(spark):
    rows = L.parse_quads(frame(spark, [x for x, _ in GOOD])).orderBy("line_id").collect()
    assert [(r.s, r.p, r.o) for r in rows] == [x for _, x in GOOD]
    assert all(r.reason is None and isinstance(r.t, dt.date) for r in rows)


def test_reasons(spark):
    rows = L.faulty(frame(spark, list(BAD))).orderBy("line_id").collect()
    assert {list(BAD)[r.line_id]: r.reason for r in rows} == BAD
    assert set(BAD.values()) <= set(L.REASONS)


@pytest.mark.parametrize("share", [0.0, 0.03, 0.5, 1.0])
def test_bisection_finds_exactly_the_faulty_ones(spark, share):
    rng = random.Random(5)
    lines = [rng.choice(list(BAD)) if rng.random() < share else rng.choice(GOOD)[0] for _ in range(3000)]
    bad = {i for i, x in enumerate(lines) if x in BAD}
    assert {r.line_id for r in L.faulty(frame(spark, lines)).collect()} == bad
    assert L.parse_quads(frame(spark, lines)).where("reason IS NULL").count() == len(lines) - len(bad)


def test_lines_that_say_nothing_and_odd_tables(spark):
    odd = frame(spark, ["", "  \t", "# <a> <b> <c> .", None, "\r", "<a> <b> <c> <2022-01-10> ."])
    assert [r.line_id for r in L.parse_quads(odd).collect()] == [5]
    assert L.parse_quads(odd.limit(0)).collect() == []
    clash = L.parse_quads(odd, keep=("line_id", "s"))
    assert clash.columns == ["line_id", "in_s", "s", "p", "o", "t", "reason"]
    long = '<a> <b> "' + "x" * 3_000_000 + '" <2022-01-10> .'
    got = L.parse_quads(frame(spark, [long, long, "<a>" * 1000])).collect()
    assert sorted(len(r.o or "") for r in got) == [0, 3_000_000, 3_000_000]


def test_strict_scanner_agrees_with_the_block_parser():
    rng = random.Random(9)
    parts = ["<a>", "<b c>", "<>", '"x"', '"x\\"', '"x\\\\"', " ", "\t", ".", "<2022-01-10>", "<2022-13-01>", "@en", "^^<t>", "#", "\r", "<", ">", '"', "é"]
    for _ in range(20000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        m = re.fullmatch(L.LINE, x)
        assert (L.diagnose(x) is None) == bool(m and a_day(m["t"])), x
    base = "<a> <b> <c> <2022-01-10> ."
    for i in range(len(base)):
        for c in ' <>".\tx':
            x = base[:i] + c + base[i + 1 :]
            m = re.fullmatch(L.LINE, x)
            assert (L.diagnose(x) is None) == bool(m and a_day(m["t"])), x


def test_columns_agree_with_the_expression():
    """The columnar path takes exactly the good lines and takes them apart alike, whatever lines stand around them."""
    rng = random.Random(10)
    parts = ["<a>", "<b c>", "<é>", "<>", '"x"', '"x\\"', '"x\\\\"', '"<\\"é>"', " ", "  ", "\t", ".", "<2022-01-10>", "<2023-02-29>", "<2024-02-29>", "<0000-01-01>", "@en", "@en-GB-1", "@1", "^^<t>", "^^t", "#", "\r", "\n", "<", ">", '"', "\\"]
    shape = lambda: rng.choice(["{0} {1} {2} {3} .", " {0}\t{1} {2}{4} {3}.\r", "{0} {1} {2}  {3} . ", "{0}{1} {2} {3} .", "{0} {1} {2} {3} ..", "{0} {1} {2} {3} .\n"]).format(*(rng.choice(["<a>", "<é>", "<a.b>", "<b c>"]) for _ in range(2)), rng.choice(parts[:8]), rng.choice(parts[12:16]), rng.choice(parts[16:21]))
    lines = [shape() if rng.random() < 0.7 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(30000)]
    lines += [*BAD, *(x for x, _ in GOOD), ""]
    block = L.Columns(pa.array(lines, pa.string()))
    rows = np.flatnonzero(block.good)
    s, p, o, t = (x.to_pylist() for x in block.of(rows))
    got = dict(zip(rows.tolist(), zip(s, p, o, t)))
    assert len(got) > 1000
    for i, x in enumerate(lines):
        m = re.fullmatch(L.LINE, x) if not x.endswith("\n") else None
        want = (m["s"], m["p"], m["iri"] or L.unescaped(m["lit"]), dt.date.fromisoformat(m["t"])) if m and a_day(m["t"]) else None
        assert got.get(i) == want, x
    whole, alone = L.isolate(block, len(lines), 64)
    assert alone == [i for i in range(len(lines)) if i not in got] and sum(b - a for a, b in whole) == len(got)
    assert L.Columns(pa.array([], pa.string())).good.tolist() == []


def test_counts_by_file(spark):
    d = spark.createDataFrame([(1, "f", "<a>"), (2, "f", GOOD[0][0]), (3, None, "<a>")], "line_id long, file_name string, line string")
    assert {tuple(r) for r in L.fault_counts(d).collect()} == {("f", "missing predicate", 1), ("f", "", 1), (None, "missing predicate", 1)}
