"""Relational tables seen as temporal quads, so that every graph query has an equal join query."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.shared import table
from quadrille.plans.sparql import RDF_TYPE

START = "1995-01-01"

#: (table, subject prefix and key, predicate, object prefix and column or None and text, day column or None)
RULES = [
    ("orders", "order", "o_orderkey", "placedBy", "customer", "o_custkey", "o_orderdate"),
    ("orders", "order", "o_orderkey", "status", None, "o_orderstatus", "o_orderdate"),
    ("orders", "order", "o_orderkey", "priority", None, "o_orderpriority", "o_orderdate"),
    ("lineitem", "order", "l_orderkey", "hasPart", "part", "l_partkey", "l_shipdate"),
    ("lineitem", "order", "l_orderkey", "suppliedBy", "supplier", "l_suppkey", "l_shipdate"),
    ("lineitem", "part", "l_partkey", "soldBy", "supplier", "l_suppkey", "l_shipdate"),
    ("customer", "customer", "c_custkey", "inNation", "nation", "c_nationkey", None),
    ("customer", "customer", "c_custkey", "segment", None, "c_mktsegment", None),
    ("customer", "customer", "c_custkey", "name", None, "c_name", None),
    ("supplier", "supplier", "s_suppkey", "inNation", "nation", "s_nationkey", None),
    ("supplier", "supplier", "s_suppkey", "name", None, "s_name", None),
    ("nation", "nation", "n_nationkey", "inRegion", "region", "n_regionkey", None),
    ("nation", "nation", "n_nationkey", "name", None, "n_name", None),
    ("region", "region", "r_regionkey", "name", None, "r_name", None),
    ("part", "part", "p_partkey", "brand", None, "p_brand", None),
    ("part", "part", "p_partkey", "ptype", None, "p_type", None),
    ("events", "user", "user_id", "did", None, "event_type", "ts"),
]
#: (table, subject prefix and key, class, day column or None)
CLASSES = [
    ("orders", "order", "o_orderkey", "Order", "o_orderdate"),
    ("customer", "customer", "c_custkey", "Customer", None),
    ("supplier", "supplier", "s_suppkey", "Supplier", None),
    ("nation", "nation", "n_nationkey", "Nation", None),
    ("region", "region", "r_regionkey", "Region", None),
    ("part", "part", "p_partkey", "Part", None),
]


def quads(spark: SparkSession, sf_dir: str, predicates: Iterable[str] | None = None) -> DataFrame:
    """``s, p, o, t`` of the tables; of the given predicates only, whose tables alone are read."""
    want = None if predicates is None else set(predicates)
    parts = []
    for name, kind, key, p, target, value, day in RULES:
        if want is None or p in want:
            o = F.concat(F.lit(f"{target}/"), F.col(value).cast("string")) if target else F.col(value)
            t = F.to_date(day) if day else F.to_date(F.lit(START))
            parts.append(table(spark, sf_dir, name).select(F.concat(F.lit(f"{kind}/"), F.col(key).cast("string")).alias("s"), F.lit(p).alias("p"), o.alias("o"), t.alias("t")))
    for name, kind, key, cls, day in CLASSES:
        if want is None or RDF_TYPE in want:
            t = F.to_date(day) if day else F.to_date(F.lit(START))
            parts.append(table(spark, sf_dir, name).select(F.concat(F.lit(f"{kind}/"), F.col(key).cast("string")).alias("s"), F.lit(RDF_TYPE).alias("p"), F.lit(cls).alias("o"), t.alias("t")))
    return reduce(DataFrame.unionAll, parts)


def activity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with deletes: a user becomes active by signing up or buying and stops by an error."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "purchase", "error"))
    op = F.when(F.col("event_type") == "error", "DELETE").otherwise("INSERT")
    return e.select(op.alias("op"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("s"), F.lit("active").alias("p"), F.lit("yes").alias("o"), F.to_date("ts").alias("t"), F.col("event_id").alias("seq"))
