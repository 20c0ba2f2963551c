"""Reachability along one predicate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quadrille.functions.shared import partitions, shared_dir

NODE = "node string"
#: After so many rounds the nodes found so far are written as one part.
FOLD = 16


def reaching(facts: DataFrame, target: str, via: str, most_rounds: int = 10_000) -> DataFrame:
    """``node``: the target and every node from which a path of ``via`` facts leads to it.

    Breadth first, from the target backwards: each round joins only the new nodes with the edges and
    takes away those already known, so cycles end and no edge is followed twice.  Edges are kept in
    order of where they lead, so a round with few new nodes skips most of them by statistics.  A round
    is one job, which writes its nodes to the shared folder and counts them; now and then all that is
    known becomes one part, so rounds don't read ever more files.  The loop ends when a round finds
    nothing new.
    """
    spark = facts.sparkSession
    edges, path = shared_dir(spark, "edges"), shared_dir(spark, "reached")
    d = facts.where((F.col("p") == via) & F.col("s").isNotNull() & F.col("o").isNotNull()).select("s", "o").distinct()
    d.repartitionByRange(partitions(spark), "o").sortWithinPartitions("o").write.parquet(edges)
    edges = spark.read.schema("s string, o string").parquet(edges)
    read = lambda *parts: spark.read.schema(NODE).parquet(*[f"{path}/{p}" for p in parts])
    spark.createDataFrame([(target,)], NODE).write.parquet(f"{path}/0")
    parts = ["0"]
    for i in range(1, most_rounds + 1):
        seen = Observation()
        step = edges.join(read(parts[-1]), F.col("o") == F.col("node"), "left_semi").select(F.col("s").alias("node")).distinct()
        step.join(read(*parts), "node", "left_anti").observe(seen, F.count("*").alias("n")).write.parquet(f"{path}/{i}")
        if not seen.get["n"]:
            return read(*parts)
        if len(parts) >= FOLD:
            read(*parts).write.parquet(f"{path}/upto-{i}")
            parts = [f"upto-{i}"]
        parts.append(str(i))
    raise RuntimeError(f"no end after {most_rounds} rounds")
