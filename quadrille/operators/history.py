"""History of changing attribute values: the periods in which each fact was valid.

Method (checkpoints and deltas).  Time is cut into periods of ``every`` days.  A change that decides
a day becomes a *patch*; ``changes`` has one row for every fact and period in which it changes, with
the list of its patches.  At every ``full_every``-th period that has changes a *full version* is stored:
every fact that holds when the period begins, and since when.  Each full version is made from the one
before and the patches since, so building is linear in the log.  The time from one full version to
the next is a *stretch*.  Validity rows come from folding the patches of a fact in a stretch forward
from the full version at its beginning: what ends within is given there, what is still open goes on
in the next full version, and in the last stretch stays open.  Stretches and facts are folded
independently of each other, and a version at any day reads one full version and the patches of at
most ``full_every`` periods.

Scale.  Redelivered and same-day changes are combined before the shuffle by a hash aggregate over
fixed-width state.  What remains has at most one patch a fact and day; a fold has at most
``every * full_every`` of them.  Full versions are as many as the calendar has stretches.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.functions.shared import file_system, present, shared_dir

FACT = ("s", "p", "o")
EVERY, FULL_EVERY = 91, 2
_PATCHES = "array<struct<t:date,on:boolean>>"
CHANGES = f"s string, p string, o string, patches {_PATCHES}, period int"
FULL = "s string, p string, o string, since date, period int"


def deciding_patches(log: DataFrame) -> DataFrame:
    """``s, p, o, t, on``: of the changes of a fact on one day the one with the greatest ``seq`` decides.

    Rows with a null in op, s, p, o or t, or an op other than INSERT and DELETE, don't count. A null
    ``seq`` comes before all others. Of changes with the same ``seq`` an INSERT wins.
    """
    op = F.upper(F.regexp_replace("op", r"^\s+|\s+$", ""))
    d = log.select(*FACT, F.col("t").cast("date").alias("t"), op.alias("op"), F.coalesce(F.col("seq").cast("long"), F.lit(-(2**61))).alias("seq"))
    d = present(d, *FACT, "t").where(F.col("op").isin("INSERT", "DELETE"))
    # one long keeps the aggregate in its fixed-width fast path
    code = F.col("seq") * 2 + (F.col("op") == "INSERT").cast("long")
    return d.groupBy(*FACT, "t").agg(F.max(code).alias("code")).select(*FACT, "t", (F.pmod("code", F.lit(2)) == 1).alias("on"))


def history(log: DataFrame) -> DataFrame:
    """Every period in which a fact was valid: ``s, p, o, t_from DATE, t_to DATE`` (null while open), by one ordered pass over a fact's patches.

    A period begins on the day of an INSERT when the fact doesn't hold and ends on the day of the
    next DELETE; changes without effect give nothing; a value that returns gives several rows.
    Values of one attribute don't end each other. Columns other than op, s, p, o, t, seq are ignored;
    an empty log gives no rows. Nothing is stored; see ``write_store`` for histories that are kept.
    """
    w = Window.partitionBy(*FACT).orderBy("t")
    d = deciding_patches(log).repartition(*FACT).withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(False))).where("on <> was")
    return d.withColumn("t_to", F.lead("t").over(w)).where("on").select(*FACT, F.col("t").alias("t_from"), "t_to")


# the store of full versions and patches


def period_of(day: date, every: int) -> int:
    return (day - date(1970, 1, 1)).days // every


def fold(since: Column, patches: Column) -> Column:
    """``since`` after the patches (null when the fact doesn't hold) and ``done``, the validity periods that ended."""
    span = "array<struct<a:date,b:date>>"
    zero = F.struct(since.cast("date").alias("since"), F.array().cast(span).alias("done"))

    def step(acc, x):
        ends = (~x["on"]) & acc["since"].isNotNull()
        closed = F.concat(acc["done"], F.array(F.struct(acc["since"].alias("a"), x["t"].alias("b"))))
        now = F.when(x["on"], F.coalesce(acc["since"], x["t"])).otherwise(F.lit(None).cast("date"))
        return F.struct(now.alias("since"), F.when(ends, closed).otherwise(acc["done"]).alias("done"))

    return F.aggregate(patches, zero, step)


def _gathered(full: DataFrame, changes: DataFrame, *by: str) -> DataFrame:
    """A row for each fact (and stretch) of a full version or with patches: ``since`` and all its patches in order of time."""
    a = full.select(*FACT, *by, "since", F.lit(None).cast(_PATCHES).alias("patches"))
    b = changes.select(*FACT, *by, F.lit(None).cast("date").alias("since"), "patches")
    g = a.unionByName(b).groupBy(*FACT, *by)
    return g.agg(F.max("since").alias("since"), F.sort_array(F.flatten(F.collect_list("patches"))).alias("patches"))


def advanced(full: DataFrame, changes: DataFrame) -> DataFrame:
    """``s, p, o, since``: the full version after some changes. Facts that don't change are passed through."""
    d = _gathered(full, changes).withColumn("f", fold(F.col("since"), F.col("patches")))
    return d.select(*FACT, F.col("f.since").alias("since")).where(F.col("since").isNotNull())


def write_store(log: DataFrame, path: str, every: int = EVERY, full_every: int = FULL_EVERY) -> None:
    """Stores the patches, one folder a period, and a full version at every ``full_every``-th period that has changes."""
    spark = log.sparkSession
    d = deciding_patches(log).withColumn("period", F.floor(F.unix_date("t") / every).cast("int"))
    d = d.groupBy(*FACT, "period").agg(F.sort_array(F.collect_list(F.struct("t", "on"))).alias("patches"))
    d.write.partitionBy("period").mode("overwrite").parquet(f"{path}/changes")
    changes = spark.read.schema(CHANGES).parquet(f"{path}/changes")
    periods = _folders(spark, f"{path}/changes")
    starts = periods[::full_every]
    full = spark.createDataFrame([], FULL)
    for a, b in zip(starts, starts[1:]):
        now = advanced(full, changes.where((F.col("period") >= a) & (F.col("period") < b)))
        now.write.mode("overwrite").parquet(f"{path}/full/period={b}")
        full = spark.read.schema(FULL).parquet(f"{path}/full").where(F.col("period") == b)


def _folders(spark: SparkSession, path: str) -> list[int]:
    """The periods that have a folder; as many as the calendar has at most."""
    fs, p = file_system(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removeprefix("period=")) for n in names if n.startswith("period="))


def _read(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    fs, p = file_system(spark, f"{path}/{name}")
    return spark.read.schema(schema).parquet(f"{path}/{name}") if fs.exists(p) else spark.createDataFrame([], schema)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """``s, p, o, t_from, t_to`` of a stored history: every stretch folded forward from its full version."""
    fulls = _folders(spark, f"{path}/full")
    stretch = F.coalesce(F.array_max(F.filter(F.array(*map(F.lit, fulls)), lambda x: x <= F.col("period"))), F.lit(-(2**31))) if fulls else F.lit(-(2**31))
    by = lambda df: df.withColumn("stretch", stretch)
    d = _gathered(by(_read(spark, path, "full", FULL)), by(_read(spark, path, "changes", CHANGES)), "stretch")
    d = d.withColumn("f", fold(F.col("since"), F.col("patches")))
    last = F.col("stretch") == F.lit(fulls[-1] if fulls else -(2**31))
    still = F.when(last & F.col("f.since").isNotNull(), F.array(F.struct(F.col("f.since").alias("a"), F.lit(None).cast("date").alias("b"))))
    rows = F.explode(F.concat("f.done", F.coalesce(still, F.array().cast("array<struct<a:date,b:date>>"))))
    return d.select(*FACT, rows.alias("v")).select(*FACT, F.col("v.a").alias("t_from"), F.col("v.b").alias("t_to"))


def read_version(spark: SparkSession, path: str, day: str, every: int = EVERY) -> DataFrame:
    """``s, p, o, t_from``: the facts that hold at the end of a day, from the full version before it and the patches since."""
    period = period_of(date.fromisoformat(day), every)
    base = max((x for x in _folders(spark, f"{path}/full") if x <= period), default=None)
    changes = _read(spark, path, "changes", CHANGES).where((F.col("period") <= period) & (F.col("period") >= (base if base is not None else -(2**31))))
    upto = changes.withColumn("patches", F.filter("patches", lambda x: x["t"] <= F.to_date(F.lit(day))))
    full = _read(spark, path, "full", FULL).where(F.col("period") == base) if base is not None else spark.createDataFrame([], FULL)
    return advanced(full, upto).select(*FACT, F.col("since").alias("t_from"))


def stored_history(log: DataFrame, every: int = EVERY, full_every: int = FULL_EVERY) -> DataFrame:
    """``history`` by way of a store in the shared folder; the rows don't depend on ``every`` and ``full_every`` (both at least 1)."""
    path = shared_dir(log.sparkSession, "history")
    write_store(log, path, every, full_every)
    return read_history(log.sparkSession, path)


def stored_version(log: DataFrame, day: str, every: int = EVERY, full_every: int = FULL_EVERY) -> DataFrame:
    """The facts that hold at the end of a day, by way of such a store."""
    path = shared_dir(log.sparkSession, "history")
    write_store(log, path, every, full_every)
    return read_version(log.sparkSession, path, day, every)
