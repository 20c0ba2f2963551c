"""Updates as rows for the log; nothing is changed in place."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.plans import execute
from quadrille.plans.sparql import Const, Pattern, Update


def _rows(spark: SparkSession, patterns: list[Pattern]) -> DataFrame:
    rows = list(dict.fromkeys((p.s.text, p.p.text, p.o.text) for p in patterns))
    return spark.createDataFrame(rows, "s string, p string, o string")


def _filled(bindings: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """The patterns with each solution put in; a solution that gives the same fact twice gives it once."""
    value = lambda x: F.lit(x.text) if isinstance(x, Const) else F.col(x.name)
    each = F.explode(F.array(*[F.struct(value(p.s).alias("s"), value(p.p).alias("p"), value(p.o).alias("o")) for p in patterns]))
    return bindings.select(each.alias("x")).select("x.*").distinct()


def log_rows(spark: SparkSession, state: execute.State, u: Update, day: dt.date, seq: int) -> DataFrame:
    """``op, s, p, o, t, seq`` of an update on the facts that hold now.

    INSERT DATA states its triples; DELETE DATA ends those that hold; DELETE ends all facts that match
    its patterns; with INSERT, the second patterns are then stated for each match, with a later ``seq``.
    """
    facts = state.facts if state.is_set else state.facts.distinct()
    cols = ["s", "p", "o"]

    def made(df: DataFrame, op: str, n: int) -> DataFrame:
        return df.select(F.lit(op).alias("op"), *cols, F.lit(day).alias("t"), F.lit(n).cast("long").alias("seq"))

    if u.data:
        if u.insert:
            return made(_rows(spark, u.insert), "INSERT", seq)
        return made(facts.join(F.broadcast(_rows(spark, u.delete)), cols, "left_semi"), "DELETE", seq)  # as many rows as the text has triples
    needed = {v for p in [*u.delete, *u.insert] for v in p.vars}
    found = execute.basic(state, u.delete, needed, True).df
    out = made(_filled(found, u.delete), "DELETE", seq)
    return out.unionByName(made(_filled(found, u.insert), "INSERT", seq + 1)) if u.insert else out
