"""A temporal graph: an append-only log of facts that begin and cease to hold, queried as of any day.

A store is a description of DataFrames, not data: ``insert_only`` logs are queried straight from the
scan (a fact holds at a day if it was stated up to it), logs with deletes through validity periods.
Stores on disk are extended in place; see ``quadrille.sources.saved``.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.shared import present, written
from quadrille.operators import history as H
from quadrille.operators import statistics as S
from quadrille.operators import update as U
from quadrille.plans import execute, planner
from quadrille.plans.sparql import Const, Pattern, Select, Times, Update, parse
from quadrille.sources import saved

FACT = ("s", "p", "o")


@dataclass(frozen=True)
class Store:
    """``quads`` (s, p, o, t) of an insert-only store, or ``log`` (op, s, p, o, t, seq) and its ``periods``."""

    spark: SparkSession
    quads: DataFrame | None = None
    log: DataFrame | None = None
    periods: DataFrame | None = None
    planned: bool = False  # look up counts before ordering patterns
    stored: saved.Saved | None = None  # the store on disk that has count tables for this very state

    # making stores

    @staticmethod
    def of_quads(quads: DataFrame, planned: bool = False) -> Store:
        """An insert-only store; rows with a null in s, p, o or t aren't facts."""
        q = present(quads.select("s", "p", "o", F.col("t").cast("date").alias("t")), "s", "p", "o", "t")
        return Store(quads.sparkSession, quads=q, planned=planned)

    @staticmethod
    def of_log(log: DataFrame, planned: bool = False) -> Store:
        """A store with deletes; see ``history`` for which rows count."""
        return Store(log.sparkSession, log=log.select("op", "s", "p", "o", F.col("t").cast("date").alias("t"), "seq"), periods=H.history(log), planned=planned)

    @staticmethod
    def open(spark: SparkSession, path: str, planned: bool = True) -> Store:
        """The latest version of a store that ``save`` has written; later extensions don't change what was opened."""
        d = saved.Saved(spark, path)
        return Store(spark, log=d.log(), periods=d.periods(), planned=planned, stored=d)

    # what holds when

    def as_of(self, day: dt.date) -> execute.State:
        """The facts that hold at the end of a day; any day will do, whether the log has it or not."""
        d = F.lit(day)
        if self.quads is not None:
            return execute.State(self.quads.where(F.col("t") <= d).select("s", "p", "o"), False)
        v = self.periods.where((F.col("t_from") <= d) & (F.col("t_to").isNull() | (F.col("t_to") > d)))
        return execute.State(v.select("s", "p", "o"), True)

    def during(self, first: dt.date, last: dt.date) -> execute.State:
        """The facts that held at the end of some day from ``first`` to ``last``."""
        if self.quads is not None:
            return self.as_of(last)
        v = self.periods.where((F.col("t_from") <= F.lit(last)) & (F.col("t_to").isNull() | (F.col("t_to") > F.lit(first))))
        return execute.State(v.select("s", "p", "o"), False)

    def current(self) -> execute.State:
        if self.quads is not None:
            return execute.State(self.quads.select("s", "p", "o"), False)
        return execute.State(self.periods.where(F.col("t_to").isNull()).select("s", "p", "o"), True)

    def at(self, times: Times | None, mode: str = "end") -> execute.State:
        """No time: the current facts. One day: as of it. A range: as of its end, or with ``any`` what held within."""
        if times is None:
            return self.current()
        return self.during(times.first, times.last) if mode == "any" and times.first != times.last else self.as_of(times.last)

    def validity(self) -> DataFrame:
        """``s, p, o, t_from, t_to``."""
        if self.quads is not None:
            return self.quads.groupBy("s", "p", "o").agg(F.min("t").alias("t_from")).withColumn("t_to", F.lit(None).cast("date"))
        return self.periods

    # queries and updates

    def query(self, text: str, mode: str = "end") -> DataFrame:
        """The answer of a query, a column for each variable. Values are strings."""
        q = parse(text)
        if not isinstance(q, Select):
            raise execute.UnsupportedQuery("an update isn't a query")
        return self.answer(q, mode)

    def answer(self, q: Select, mode: str = "end") -> DataFrame:
        """The answer of a parsed query; with ``planned``, all its patterns are looked up first, whatever group they are in."""
        state = self.at(q.times, mode)
        st = self.estimates(q.where.all_patterns()) if self.planned else None
        return execute.run(state, q, st)

    def counts(self, name: str) -> DataFrame:
        """Current facts by ``p``, ``sp`` or ``op``, read if they were saved."""
        if self.stored:
            return self.stored.counts(name)
        return S.counts(self.facts(), saved.COUNTS[name])

    def facts(self) -> DataFrame:
        """The facts that hold now, each once."""
        s = self.current()
        return s.facts if s.is_set else s.facts.distinct()

    def estimates(self, patterns: list[Pattern]) -> planner.Statistics:
        """How many current facts match the constants of patterns, in one small job: from the count tables of a saved store, else from one scan."""
        if self.stored:
            return planner.look_up(patterns, *(self.counts(name) for name in saved.COUNTS))
        return planner.counted(patterns, self.facts())

    def cardinality(self, s: str | None = None, p: str | None = None, o: str | None = None) -> int:
        """How many facts that hold now have the given terms; all of them if none is given."""
        key = (s, p, o)
        pattern = Pattern(*(Const(x) if x is not None else planner.Var(n) for x, n in zip(key, FACT)))
        got = self.estimates([pattern]).counts.get(key)
        if got is None:
            cond = F.lit(True)
            for c, x in zip(FACT, key):
                cond = cond & (F.col(c) == x) if x is not None else cond
            got = self.facts().where(cond).count()
        return got

    def changes(self, text: str, day: dt.date | None = None, seq: int = 0) -> DataFrame:
        """The log rows an update amounts to; ``day`` is today if not given."""
        u = parse(text)
        if not isinstance(u, Update):
            raise execute.UnsupportedQuery("a query isn't an update")
        return U.log_rows(self.spark, self.current(), u, day or dt.date.today(), seq)

    def update(self, text: str, day: dt.date | None = None, seq: int = 1 << 40) -> Store:
        """The store after an update; ``seq`` must lie beyond those in use."""
        return self.append(self.changes(text, day, seq))

    def update_edge(self, old: tuple[str, str, str], new: tuple[str, str, str], day: dt.date | None = None, seq: int = 1 << 40) -> Store:
        """The store with one fact in place of another, if that holds."""
        day = day or dt.date.today()
        was = U.log_rows(self.spark, self.current(), Update([Pattern(*map(Const, old))], [], True), day, seq)
        rows = was.unionByName(was.select(F.lit("INSERT").alias("op"), *[F.lit(x).alias(c) for c, x in zip("spo", new)], "t", (F.col("seq") + 1).alias("seq")))
        return self.append(rows)

    def append(self, rows: DataFrame) -> Store:
        """The store with log rows added.

        Only the facts the rows name get a new history, out of their own part of the log; the periods
        of all others stay as they are. The rows are written once, so their size is known: where they
        are few, facts that aren't touched aren't moved either.
        """
        rows = written(rows.select("op", "s", "p", "o", F.col("t").cast("date").alias("t"), F.col("seq").cast("long").alias("seq")), "changes")
        touched = rows.select(*FACT).distinct()
        if self.log is None:
            old = self.quads.select(F.lit("INSERT").alias("op"), "s", "p", "o", "t", F.lit(0).cast("long").alias("seq"))
        else:
            old = self.log
        kept = self.validity().join(touched, list(FACT), "left_anti")
        new = H.history(old.join(touched, list(FACT), "left_semi").unionByName(rows))
        return replace(self, quads=None, log=old.unionByName(rows), periods=kept.unionByName(new), stored=None)

    def insert(self, triples: DataFrame, day: dt.date | None = None, seq: int = 1 << 40) -> Store:
        """Triples that hold from a day on, today if not given; stating a fact that holds changes nothing."""
        return self.append(inserts(triples, day, seq))

    # storage

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """Log, periods and counts as Parquet; see ``saved.create``."""
        log = self.log
        if log is None:
            log = self.quads.select(F.lit("INSERT").alias("op"), "s", "p", "o", "t", F.lit(0).cast("long").alias("seq"))
        saved.create(self.spark, path, log, self.periods, mode)

    def statistics(self, *by: str) -> DataFrame:
        """Facts that hold now, counted by some of s, p, o."""
        return S.counts(self.facts(), by)

    def triple_count(self) -> int:
        return self.facts().count()


def inserts(triples: DataFrame, day: dt.date | None = None, seq: int = 1 << 40) -> DataFrame:
    """Log rows that state triples from a day on, today if not given."""
    d = triples.select(F.lit("INSERT").alias("op"), "s", "p", "o", F.lit(day or dt.date.today()).alias("t"), F.lit(seq).cast("long").alias("seq"))
    return present(d, "s", "p", "o").dropDuplicates(["s", "p", "o"])
