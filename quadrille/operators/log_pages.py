"""Page headers of the change log: which pages a time range needs, and the chains they form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = 4096


def clean(pages: DataFrame) -> DataFrame:
    """One header a page: of several copies the one with most space used (then the latest times); swapped bounds put right.

    Headers with a null page or predicate say nothing. A null end of a range is open.
    """
    low = F.least("min_ts", "max_ts")
    high = F.when(F.col("max_ts").isNotNull() & F.col("min_ts").isNotNull(), F.greatest("min_ts", "max_ts")).otherwise(F.col("max_ts"))
    d = pages.where(F.col("page_no").isNotNull() & F.col("pid").isNotNull())
    d = d.select("page_no", "next_page_no", "pid", "used_space", low.alias("min_ts"), high.alias("max_ts"))
    best = F.max(F.struct("used_space", "max_ts", "min_ts", "next_page_no", "pid")).alias("h")
    return d.groupBy("page_no").agg(best).select("page_no", "h.pid", "h.next_page_no", "h.used_space", "h.min_ts", "h.max_ts")


def overlapping(pages: DataFrame, first: int, last: int) -> DataFrame:
    """The pages that may hold records from ``first`` to ``last`` (epoch seconds)."""
    c = clean(pages)
    return c.where((F.col("min_ts").isNull() | (F.col("min_ts") <= last)) & (F.col("max_ts").isNull() | (F.col("max_ts") >= first)))


def directory(pages: DataFrame) -> DataFrame:
    """``pid, pages, chains, space, free``: the page directory by predicate; a chain has one page with no next."""
    c = clean(pages)
    return c.groupBy("pid").agg(
        F.count("*").alias("pages"),
        F.sum((F.col("next_page_no") == -1).cast("long")).alias("chains"),
        F.sum("used_space").alias("space"),
        F.sum(F.lit(PAGE).cast("long") - F.col("used_space")).alias("free"),
    )
