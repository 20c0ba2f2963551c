"""The algebra lowered to DataFrames.

A pattern is a filtered, pruned scan of the state; patterns are natural-joined on their shared
variables.  A pattern that brings no variable that is still needed becomes a left-semi join, so its
rows are never multiplied.  Join strategies are left to Catalyst and adaptive execution.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.paths import reaching
from quadrille.plans import planner
from quadrille.plans.sparql import Among, Compare, Const, Filter, Group, Pattern, Reaches, Select, Var


class UnsupportedQuery(ValueError):
    """The query is well-formed but has no defined result here."""


@dataclass
class State:
    """The facts a query sees: columns s, p, o; ``is_set`` tells that none is repeated."""

    facts: DataFrame
    is_set: bool


@dataclass
class Rows:
    """Solutions; ``sure`` are the variables that are bound in every one."""

    df: DataFrame
    sure: set[str]

    @property
    def vars(self) -> list[str]:
        return self.df.columns


def scan(state: State, p: Pattern, needed: set[str] | None = None) -> DataFrame:
    """The distinct bindings of a pattern's variables (of those that are needed); one column ``__there`` if none is."""
    d, first = state.facts, {}
    cond = F.lit(True)
    for c, x in zip("spo", (p.s, p.p, p.o)):
        if isinstance(x, Const):
            cond = cond & (F.col(c) == x.text)
        elif x.name in first:
            cond = cond & (F.col(c) == F.col(first[x.name]))
        else:
            first[x.name] = c
    keep = {v: c for v, c in first.items() if needed is None or v in needed}
    d = d.where(cond)
    if not keep:
        return d.select(F.lit(1).alias("__there")).limit(1)
    d = d.select(*[F.col(c).alias(v) for v, c in keep.items()])
    return d if state.is_set and len(keep) == len(first) else d.distinct()


def scan_between(state: State, p: Pattern, var: str, low: str, high: str) -> DataFrame:
    """The bindings of a pattern whose value of one variable lies in a range, both ends included."""
    return scan(state, p).where(F.col(var).between(low, high))


def reduced(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides without the rows that find no partner on the other."""
    return a.join(b, keys, "left_semi"), b.join(a, keys, "left_semi")


def _exists(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` if ``one`` (at most one row) has a row, else nothing."""
    return df.withColumn("__there", F.lit(1)).join(F.broadcast(one), "__there", "left_semi").drop("__there")


def _cases(r: Rows, shared: list[str]) -> list[tuple[set[str], DataFrame]]:
    """The rows by which of their shared variables are bound: one case where all always are."""
    unsure = [v for v in shared if v not in r.sure]
    out = []
    for n in range(1 << len(unsure)):
        free = [v for i, v in enumerate(unsure) if n >> i & 1]
        df = r.df
        for v in unsure:
            df = df.where(F.col(v).isNull() if v in free else F.col(v).isNotNull())
        out.append((set(shared) - set(free), df))
    return out


def join(a: Rows, b: Rows) -> Rows:
    """The compatible pairs: variables that both sides bind are equal, what one side binds is taken from it."""
    shared = [v for v in a.vars if v in b.vars]
    if not shared:
        return Rows(a.df.crossJoin(b.df), a.sure | b.sure)  # the product that unconnected patterns mean
    if set(shared) <= a.sure & b.sure:
        return Rows(a.df.join(b.df, shared), a.sure | b.sure)
    parts = []
    for bound_a, x in _cases(a, shared):
        for bound_b, y in _cases(b, shared):
            keys = [v for v in shared if v in bound_a & bound_b]
            x_ = x.drop(*[v for v in shared if v not in bound_a])
            y_ = y.drop(*[v for v in shared if v not in keys and (v in bound_a or v not in bound_b)])
            parts.append(x_.join(y_, keys) if keys else x_.crossJoin(y_))
    names = [*a.vars, *(v for v in b.vars if v not in a.vars)]
    kinds = {**dict(b.df.dtypes), **dict(a.df.dtypes)}
    whole = [p.select(*[F.col(v) if v in p.columns else F.lit(None).cast(kinds[v]).alias(v) for v in names]) for p in parts]
    return Rows(reduce(DataFrame.unionAll, whole), a.sure | b.sure)


def optional(a: Rows, b: Rows) -> Rows:
    """The compatible pairs, and the rows of ``a`` that have none."""
    shared = [v for v in a.vars if v in b.vars]
    if shared and set(shared) <= a.sure & b.sure:
        return Rows(a.df.join(b.df, shared, "left"), a.sure)
    alone = []
    for bound_a, x in _cases(a, shared):
        for bound_b, y in _cases(b, shared):
            keys = [v for v in shared if v in bound_a & bound_b]
            if keys:
                x = x.join(y, keys, "left_anti")
            else:  # any row of y fits all of x
                some = F.broadcast(y.select(F.lit(1).alias("__there")).limit(1))
                x = x.withColumn("__there", F.lit(1)).join(some, "__there", "left_anti").drop("__there")
        alone.append(x)
    return Rows(join(a, b).df.unionByName(reduce(DataFrame.unionAll, alone), allowMissingColumns=True), a.sure)


def basic(state: State, patterns: list[Pattern], needed: set[str], bag: bool, st=None) -> Rows | None:
    """The natural join of patterns; None if there are none."""
    acc: Rows | None = None
    uses = Counter(v for p in dict.fromkeys(patterns) for v in p.vars)
    wanted = {v for v in uses if bag or v in needed or uses[v] > 1}
    tests = []
    for p in planner.order(patterns, st):
        d = scan(state, p, wanted)
        if "__there" in d.columns:
            tests.append(d)
        elif acc is None:
            acc = Rows(d, set(d.columns))
        elif set(d.columns) <= set(acc.vars):
            acc = Rows(acc.df.join(d, d.columns, "left_semi"), acc.sure)
        else:
            acc = join(acc, Rows(d, set(d.columns)))
    if tests and acc is None:
        acc = Rows(tests.pop(), {"__there"})
        for t in tests:
            acc = Rows(acc.df.join(F.broadcast(t), "__there", "left_semi"), acc.sure)
    else:
        for t in tests:
            acc = Rows(_exists(acc.df, t), acc.sure)
    return acc


def keep(state: State, rows: Rows, f: Filter) -> Rows:
    """The rows a filter accepts: none if a variable of it isn't bound in the group."""
    if {f.var, getattr(getattr(f, "other", None), "name", f.var)} - set(rows.vars):
        return Rows(rows.df.where(F.lit(False)), rows.sure)
    if isinstance(f, Reaches):
        near = reaching(state.facts, f.target, f.via).select(F.col("node").alias(f.var))
        return Rows(rows.df.join(near, f.var, "left_semi"), rows.sure)
    c = F.col(f.var)
    if isinstance(f, Among):
        return Rows(rows.df.where(c.isin(*f.values) if f.inside else ~c.isin(*f.values)), rows.sure)
    assert isinstance(f, Compare)
    if isinstance(f.other, Var):
        other = F.col(f.other.name)
    else:
        other = F.lit(f.other.text)
    return Rows(rows.df.where(c == other if f.equal else c != other), rows.sure)


def evaluate(state: State, g: Group, needed: set[str], bag: bool = False, st=None) -> Rows:
    """All solutions of a group, with at least the needed variables it binds."""
    inner = {v for f in g.filters for v in (f.var, getattr(getattr(f, "other", None), "name", f.var))}
    parts = [h for u in g.unions for h in u] + g.optional
    across = {v for h in parts for v in h.all_vars()}
    want = needed | inner | across
    acc = basic(state, g.patterns, want, bag, st)
    for u in g.unions:
        rows = [evaluate(state, h, want | {v for p in g.patterns for v in p.vars}, bag, st) for h in u]
        df = rows[0].df
        for r in rows[1:]:
            df = df.unionByName(r.df, allowMissingColumns=True)
        one = Rows(df, set.intersection(*(r.sure for r in rows)))
        acc = one if acc is None else join(acc, one)
    if acc is None:
        raise UnsupportedQuery("a group needs a pattern outside OPTIONAL")
    for h in g.optional:
        acc = optional(acc, evaluate(state, h, want, bag, st))
    for f in g.filters:
        acc = keep(state, acc, f)
    return acc


def run(state: State, q: Select, st=None) -> DataFrame:
    """The answer: a set of rows over the projected variables; ``count`` adds n, ``duplicates`` keeps answers met more than once."""
    bag = q.mode in ("count", "duplicates")
    rows = evaluate(state, q.where, set(q.vars), bag, st)
    names = [v for v in q.vars if v in rows.vars]
    if bag:
        out = rows.df.groupBy(*names).agg(F.count("*").alias("n"))
        out = out.where("n > 1").drop("n") if q.mode == "duplicates" else out
    elif names == rows.vars and not q.where.unions and state.is_set:
        out = rows.df  # a join of sets is a set
    else:
        out = rows.df.select(*names).distinct()
    return out.limit(q.limit) if q.limit else out
