"""Counts that describe a store, for planning and for reports; all combine in each task before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def counts(facts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Facts for each value of some of s, p, o: the columns and ``n``."""
    return facts.groupBy(*by).agg(F.count("*").alias("n"))


def by_day(log: DataFrame) -> DataFrame:
    """``t, n, total``: records of each day and up to it. One row a day goes through the ordered window."""
    d = log.where(F.col("t").isNotNull()).groupBy("t").agg(F.count("*").alias("n"))
    return d.withColumn("total", F.sum("n").over(Window.orderBy("t")))


def choose_snapshots(log: DataFrame, k: int = 3) -> DataFrame:
    """``t, total``: up to ``k`` days for snapshots, each at the middle of one of ``k`` equal parts of the log.

    Part i of k (from 0) has its middle at (2i+1)/2k of all records; the first day by which so many
    have come is chosen. Fewer days come out when parts share one; an empty log gives none.
    """
    d = by_day(log)
    days = d.withColumn("all", F.max("total").over(Window.partitionBy()))
    mid = F.explode(F.array(*[F.lit(2 * i + 1) for i in range(k)]))
    hit = days.select("*", mid.alias("m")).where((F.col("total") * (2 * k) >= F.col("m") * F.col("all")) & ((F.col("total") - F.col("n")) * (2 * k) < F.col("m") * F.col("all")))
    return hit.select("t", "total").distinct()


def nearest_snapshot(log: DataFrame, day: str, k: int = 3) -> DataFrame:
    """``t, distance``: the snapshot with the fewest records between it and the day; of equally near ones the earlier."""
    upto = log.where(F.col("t") <= F.to_date(F.lit(day))).agg(F.count("*").alias("here"))
    near = choose_snapshots(log, k).join(F.broadcast(upto))  # one row
    return near.select("t", F.abs(F.col("total") - F.col("here")).alias("distance")).orderBy("distance", "t").limit(1)


def node_edges(facts: DataFrame) -> DataFrame:
    """``node, n_out, n_in``: how many facts begin and end at each node."""
    d = facts.select(F.explode(F.array(F.struct(F.col("s").alias("node"), F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.col("o").alias("node"), F.lit(0).alias("a"), F.lit(1).alias("b")))).alias("x")).select("x.*")
    return d.groupBy("node").agg(F.sum("a").cast("long").alias("n_out"), F.sum("b").cast("long").alias("n_in"))
