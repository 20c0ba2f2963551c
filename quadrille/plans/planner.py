"""The order in which patterns are joined: the one whose intermediate results are expected to be smallest together, always connected ones first."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.plans.sparql import Const, Pattern, Var

#: Up to so many patterns every order is weighed; with more, the next one is always the one that leaves fewest solutions.
MOST_WEIGHED = 10
#: Share of rows that is left per bound position when nothing is known: a subject has few facts, an object may be shared by many.
GUESS = {"s": 1e-5, "p": 1e-1, "o": 1e-3}


@dataclass
class Statistics:
    """Counts looked up once for the constants of a query; small, whatever the store's size."""

    total: float = 1e6
    counts: dict[tuple[str | None, str | None, str | None], int] = field(default_factory=dict)

    different: dict[tuple[tuple[str | None, ...], str], int] = field(default_factory=dict)

    def estimate(self, p: Pattern) -> float:
        """Rows of a pattern."""
        key = constants(p)
        n = self.counts.get(key)
        if n is None:
            n = self.total
            for name, k in zip("spo", key):
                n *= GUESS[name] if k is not None else 1
        return n

    def values(self, p: Pattern, place: str, is_object: bool) -> float:
        """Different terms at a place of a pattern. Where they aren't counted, one that is an object elsewhere is taken for one of few."""
        key = constants(p)
        known = self.different.get((key, place))
        if known is None:
            known = self.estimate(p) if sum(k is None for k in key) == 1 else 1 / GUESS["o" if place == "s" and is_object else place]
        return max(1.0, known)


def constants(p: Pattern) -> tuple[str | None, ...]:
    return tuple(x.text if isinstance(x, Const) else None for x in (p.s, p.p, p.o))


def _matches(key: tuple[str | None, ...], cols: str) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & (F.col(c) == key["spo".index(c)])
    return cond


def look_up(patterns: list[Pattern], by_p: DataFrame, by_sp: DataFrame, by_op: DataFrame) -> Statistics:
    """Statistics for the constants of some patterns out of the three count tables: one job, whose filters reach the scans."""
    st = Statistics()
    keys = {constants(p) for p in patterns}
    asked = [
        (by_p, "p", {k for k in keys if k[1] is not None and k[0] is None and k[2] is None}),
        (by_sp, "sp", {k for k in keys if None not in k[:2] and k[2] is None}),
        (by_op, "po", {k for k in keys if None not in k[1:] and k[0] is None}),
    ]
    none = [F.lit(None).cast("string").alias(c) for c in "spo"]
    parts = []
    for c, df in (("s", by_sp), ("o", by_op)):  # a row for each subject, or object, of a predicate
        if ps := sorted(k[1] for k in asked[0][2]):
            parts.append(df.where(F.col("p").isin(ps)).groupBy("p").agg(F.count("*").alias("n")).select(none[0], "p", none[2], "n", F.lit(c).alias("place")))
    for df, cols, ks in asked:
        if ks:
            st.counts |= dict.fromkeys(ks, 0)
            cond = reduce(Column.__or__, [_matches(k, cols) for k in sorted(ks, key=str)])
            parts.append(df.where(cond).select(*[F.col(c).alias(c) if c in cols else F.lit(None).cast("string").alias(c) for c in "spo"], "n", F.lit(None).cast("string").alias("place")))
    parts.append(by_p.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(*none, "n", F.lit(None).cast("string").alias("place")))
    for r in reduce(DataFrame.unionAll, parts).collect():  # at most three rows for each key asked for
        key = (r["s"], r["p"], r["o"])
        if r["place"]:
            st.different[key, r["place"]] = r["n"]
        else:
            st.counts[key] = r["n"]
    st.total = max(st.counts[None, None, None], 1)
    return st


def counted(patterns: list[Pattern], facts: DataFrame) -> Statistics:
    """The same for facts without count tables: one scan, whatever the number of patterns."""
    st = Statistics()
    keys = sorted({constants(p) for p in patterns if any(k is not None for k in constants(p))}, key=str)
    if keys:
        conds = [_matches(k, "".join(c for c, x in zip("spo", k) if x is not None)) for k in keys]
        sums = [F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(f"n{i}") for i, c in enumerate(conds)]
        st.counts = dict(zip(keys, facts.where(reduce(Column.__or__, conds)).agg(*sums).first()))
    return st


def _sizes(patterns: list[Pattern], st: Statistics) -> Callable[[frozenset[int]], float]:
    """The expected solutions of some of the patterns together: every place of a variable but the one with fewest different terms divides the product."""
    objects = {p.o.name for p in patterns if isinstance(p.o, Var) and len(set(p.vars)) > 1}
    rows = [st.estimate(p) for p in patterns]
    places = [[(x.name, st.values(p, c, x.name in objects)) for c, x in zip("spo", (p.s, p.p, p.o)) if isinstance(x, Var)] for p in patterns]

    def size(chosen: frozenset[int]) -> float:
        by: dict[str, list[float]] = {}
        for i in sorted(chosen):
            for v, d in places[i]:
                by.setdefault(v, []).append(d)
        return prod(rows[i] for i in sorted(chosen)) / prod(prod(sorted(ds)[1:]) for ds in by.values())

    return size


def order(patterns: list[Pattern], st: Statistics | None = None) -> list[Pattern]:
    """Patterns without variables first, then the order with the fewest solutions summed over all its steps, of connected patterns where there are any."""
    st = st or Statistics()
    rest = list(dict.fromkeys(patterns))
    out, rest = [p for p in rest if not p.vars], [p for p in rest if p.vars]
    size, names = _sizes(rest, st), [set(p.vars) for p in rest]
    best: dict[frozenset[int], tuple] = {frozenset(): (0.0, ())}
    for _ in rest:  # the cheapest way to each set of patterns, one pattern larger each time
        larger: dict[frozenset[int], tuple] = {}
        for chosen, (cost, way) in best.items():
            bound = set().union(*(names[i] for i in chosen))
            left = [i for i in range(len(rest)) if i not in chosen]
            for i in [i for i in left if names[i] & bound] or left:
                now = chosen | {i}
                closes = len(names[i]) if names[i] <= bound else 0  # of equal ways, the one that closes a cycle earlier, then begins with smaller patterns
                one = (float(f"{cost + size(now):.9g}"), (*way, (-closes, st.estimate(rest[i]), i)))
                if now not in larger or one < larger[now]:
                    larger[now] = one
        best = larger if len(rest) <= MOST_WEIGHED else dict([min(larger.items(), key=lambda x: x[1])])
    return out + [rest[i] for *_, i in next(iter(best.values()))[1]]
