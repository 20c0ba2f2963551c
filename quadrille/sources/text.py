"""Text files of quads and triples, and writing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.shared import present
from quadrille.sources.quad_lines import TAG, parse_quads

_TRIPLE = rf'^[ \t]*<([^ \t<>"]+)>[ \t]+<([^ \t<>"]+)>[ \t]+(?:<([^ \t<>"]+)>|"((?:[^"\\]|\\.)+)"(?:{TAG})?)[ \t]*\.[ \t]*\r?$'
#: What faulty triple lines lack, first to last: each pattern is the beginning of a good line.
_STEPS = (
    ("subject", r'^[ \t]*<[^ \t<>"]+>([ \t]|$)'),
    ("predicate", r'^[ \t]*<[^ \t<>"]+>[ \t]+<[^ \t<>"]+>([ \t]|$)'),
    ("object", rf'^[ \t]*<[^ \t<>"]+>[ \t]+<[^ \t<>"]+>[ \t]+(?:<[^ \t<>"]+>|"(?:[^"\\]|\\.)+"(?:{TAG})?)([ \t.]|$)'),
)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="\n").select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file_name"))


def read_quads(spark: SparkSession, path: str) -> DataFrame:
    """``file_name, line, s, p, o, t, reason`` of build files, one row per line that says anything; faulty lines have a reason."""
    return parse_quads(_lines(spark, path), keep=("file_name", "line"))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """``file_name, line, s, p, o, reason`` of insert files, whose lines are ``<s> <p> <o> .`` or have a literal.

    Faulty lines have a reason instead of terms; blank lines and comments say nothing. Stays in the JVM.
    """
    return parse_triples(_lines(spark, path))


def parse_triples(lines: DataFrame) -> DataFrame:
    """The same for lines that are there as ``line, file_name``."""
    v, good = F.col("line"), F.col("line").rlike(_TRIPLE)
    part = lambda i: F.when(good, F.regexp_extract(v, _TRIPLE, i))
    o = F.when(part(3) != "", part(3)).otherwise(_plain(part(4)))
    why = F.lit("missing dot or surplus term")
    for name, step in reversed(_STEPS):
        why = F.when(~v.rlike(step), f"bad or missing {name}").otherwise(why)
    said = lines.where(v.isNotNull() & ~v.rlike(r"^[ \t\r\n]*$") & ~v.startswith("#"))
    return said.select("file_name", "line", part(1).alias("s"), part(2).alias("p"), F.when(good, o).alias("o"), F.when(~good, why).alias("reason"))


def _plain(c: Column) -> Column:
    """A literal with its escapes undone: split at escaped backslashes, so that nothing stands in for them."""

    def plain(x: Column) -> Column:
        for a, b in (('\\"', '"'), ("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return F.regexp_replace(x, r"\\(.)", "$1")

    return F.array_join(F.transform(F.split(c, r"\\\\", -1), plain), "\\")


def _quoted(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), c, F.lit('"'))


def _triple(quads: DataFrame) -> list[Column]:
    """The parts of a line up to the object; objects that can be an IRI without blanks and have a colon are written as one."""
    iri = F.col("o").rlike(r'^[^ \t<>"]*:[^ \t<>"]*$')
    o = F.when(iri, F.concat(F.lit("<"), F.col("o"), F.lit(">"))).otherwise(_quoted(F.col("o")))
    return [F.lit("<"), F.col("s"), F.lit("> <"), F.col("p"), F.lit("> "), o]


def as_lines(quads: DataFrame) -> DataFrame:
    """``value``: the line of each quad."""
    return quads.select(F.concat(*_triple(quads), F.lit(" <"), F.date_format("t", "yyyy-MM-dd"), F.lit("> .")).alias("value"))


def as_triples(facts: DataFrame) -> DataFrame:
    """``value``: the line of each triple."""
    return facts.select(F.concat(*_triple(facts), F.lit(" .")).alias("value"))


def write_quads(quads: DataFrame, path: str, mode: str = "errorifexists") -> None:
    as_lines(present(quads.select("s", "p", "o", "t"), "s", "p", "o", "t")).write.mode(mode).text(path)
