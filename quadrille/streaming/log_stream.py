"""Taking in a change log continuously (goes beyond batch loading; facts and queries are the same)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quadrille.sources.quad_lines import parse_quads
from quadrille.sources.saved import LOG, PERIODS, Saved, create, exists


def read_log(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream of Parquet log files that arrive in a folder."""
    return spark.readStream.schema(LOG).options(**options).parquet(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of quads out of build files that arrive in a folder; faulty lines carry their reason."""
    lines = spark.readStream.text(path).select(F.col("value").alias("line"))
    return parse_quads(lines, keep=())


def append(stream: DataFrame, path: str, checkpoint: str, name: str = "log") -> StreamingQuery:
    """Adds a stream of log rows to a saved store, an empty one if there is none; periods and counts follow.

    Each batch extends the store by one version, which also notes the batch's number under the
    stream's ``name``; a batch that is delivered again after a failure is recognised and adds nothing.
    """

    spark = stream.sparkSession
    if not exists(spark, path):
        create(spark, path, spark.createDataFrame([], LOG), spark.createDataFrame([], PERIODS))

    def add(batch: DataFrame, number: int) -> None:
        Saved(batch.sparkSession, path).extend(batch, (name, number))

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Rows without redeliveries (same ``seq``) that come within ``late`` of the latest day; state beyond is forgotten."""
    return stream.withColumn("at", F.to_timestamp("t")).withWatermark("at", late).dropDuplicatesWithinWatermark(["seq"]).drop("at")


def changes_by_day(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """``day, op, n``: changes of each day, given out when no more can come."""
    d = stream.withColumn("at", F.to_timestamp("t")).withWatermark("at", late)
    return d.groupBy(F.window("at", "1 day").alias("w"), F.upper(F.trim("op")).alias("op")).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "op", "n")
