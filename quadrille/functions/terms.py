"""Terms: parts of IRIs, kinds of literals, dictionaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.functions.shared import partitions, written


def iri_prefix(c: Column) -> Column:
    """What stands before the last slash (one at the end doesn't count); ``single`` if there is none."""
    m = F.regexp_extract(c, r"^(.*)/.+$", 1)
    return F.when(c.rlike(r"^.*/.+$"), m).otherwise(F.lit("single"))


def iri_suffix(c: Column) -> Column:
    """What follows that slash; the whole term if there is none."""
    return F.when(c.rlike(r"^.*/.+$"), F.regexp_extract(c, r"^.*/(.+)$", 1)).otherwise(c)


def literal_kind(c: Column) -> Column:
    """``integer``, ``double``, ``boolean``, ``date``, ``datetime`` or ``string``, by its form."""
    return (
        F.when(c.rlike(r"^[+-]?[0-9]+$"), "integer")
        .when(c.rlike(r"^[+-]?([0-9]+[.][0-9]*|[.][0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$"), "double")
        .when(c.rlike(r"^(true|false)$"), "boolean")
        .when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "date")
        .when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"), "datetime")
        .otherwise("string")
    )


def integer_width(c: Column) -> Column:
    """The narrowest of ``int``, ``unsigned``, ``long`` that holds an integer literal, ``double`` beyond, null for others."""
    n = c.try_cast("decimal(38,0)")
    width = F.when(n.between(-(2**31), 2**31 - 1), "int").when(n.between(0, 2**32 - 1), "unsigned").when(n.between(-(2**63), 2**63 - 1), "long").otherwise("double")
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), width)


def datetime_number(c: Column) -> Column:
    """``yyyyMMddHHmmss`` of a datetime literal as a double, null for others."""
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"), F.regexp_replace(c, "[^0-9]", "").cast("double"))


def about_statement(c: Column) -> Column:
    """Whether a predicate belongs to the reification vocabulary."""
    return c.rlike(r"#(Statement|subject|predicate|object)$")


def near(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Whether two numbers are equal but for rounding."""
    return F.abs(a - b) <= eps


def dictionary(terms: DataFrame, column: str = "term") -> DataFrame:
    """``id LONG, term``: dense ids from 1 in the order of the distinct non-null terms.

    Terms are range partitioned and numbered within partitions; the running sum of the partitions'
    sizes, one row each, gives the offsets.
    """
    spark = terms.sparkSession
    d = terms.select(F.col(column).alias("term")).where(F.col("term").isNotNull()).distinct()
    d = d.repartitionByRange(partitions(spark), "term").sortWithinPartitions("term")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            k = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(k, part, np.int32)), pa.array(np.arange(n, n + k))], ["term", "part", "i"])
            n += k

    d = written(d.mapInArrow(number, "term string, part int, i long"), "terms")
    sizes = d.groupBy("part").agg(F.count("*").alias("n"))
    offset = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return d.join(offset, "part").select((F.col("before") + F.col("i") + 1).alias("id"), "term")


def hashed_id(c: Column) -> Column:
    """An id that needs no dictionary to be made, only to be read back; see ``collisions``."""
    return F.xxhash64(c)


def collisions(terms: DataFrame, column: str = "term", hashed: Callable[[Column], Column] = hashed_id) -> DataFrame:
    """``id, n``: hashed ids that more than one term has. With 64 bits almost surely none below a billion terms."""
    d = terms.select(F.col(column).alias("term")).where(F.col("term").isNotNull()).distinct()
    return d.groupBy(hashed(F.col("term")).alias("id")).agg(F.count("*").alias("n")).where("n > 1")


def encode(quads: DataFrame, nodes: DataFrame, predicates: DataFrame) -> DataFrame:
    """Quads with ids in place of terms; subjects and objects share one dictionary."""
    n = lambda c: nodes.select(F.col("id").alias(f"{c}_id"), F.col("term").alias(c))
    p = predicates.select(F.col("id").alias("p_id"), F.col("term").alias("p"))
    return quads.join(n("s"), "s").join(n("o"), "o").join(p, "p").drop("s", "p", "o")


def decode(ids: DataFrame, nodes: DataFrame, predicates: DataFrame) -> DataFrame:
    n = lambda c: nodes.select(F.col("id").alias(f"{c}_id"), F.col("term").alias(c))
    p = predicates.select(F.col("id").alias("p_id"), F.col("term").alias("p"))
    return ids.join(n("s"), "s_id").join(n("o"), "o_id").join(p, "p_id").drop("s_id", "p_id", "o_id")
