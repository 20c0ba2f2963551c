"""Per-key results when a few keys hold most rows.

Method.  Rows are range partitioned on the composite (key, secondary order, tie-breaker); Spark
samples the quantiles of that composite, so a heavy key is cut across as many partitions as its
rows need.  Each partition is sorted by the same composite and passes once, vectorised, over its
rows: for each key it holds it emits one partial state (rows, runs of equal secondary values, first
and last of them).  Two partitions that share a key can share at most the value at their border, so
stitching needs only the states in partition order: a run that goes on across the border is counted
once.  There are at most (partitions + keys) states, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quadrille.functions.shared import partitions, written


def _codes(carry: pa.Scalar | None, col: pa.Array) -> np.ndarray:
    """Equal values have equal codes, null too; the first code is that of ``carry``."""
    both = pa.concat_arrays([pa.array([carry.as_py() if carry is not None else None], col.type), col])
    return both.dictionary_encode(null_encoding="encode").indices.to_numpy()


def _states(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        open_: list | None = None  # key, rows, runs, first, last, vsum, last value
        for batch in batches:
            if not batch.num_rows:
                continue
            key, sec, val = batch.columns
            n = batch.num_rows
            k = _codes(open_[0] if open_ else None, key)
            c = _codes(open_[4] if open_ else None, sec)
            new_key = k[1:] != k[:-1]
            new_run = new_key | (c[1:] != c[:-1])
            if open_ is None:
                new_key[0] = new_run[0] = True
            there = pc.is_valid(sec).to_numpy(zero_copy_only=False)
            v = pc.fill_null(val, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.append(new_run[1:], False)  # the last run of a batch stays open
            counted = np.where(there & ends, v, 0)
            starts = np.flatnonzero(new_key)
            cuts = starts if len(starts) and starts[0] == 0 else np.concatenate([[0], starts])
            rows = np.diff(np.append(cuts, n))
            runs = np.add.reduceat((new_run & there).astype(np.int64), cuts)
            vsum = np.add.reduceat(counted, cuts)
            last = np.append(cuts[1:], n) - 1
            done = []
            if open_ is not None:
                if new_run[0] and open_[4].is_valid:
                    open_[5] += open_[6]  # the run that was open has ended
                if new_key[0]:
                    done.append([part, open_[0].as_py(), *open_[1:3], open_[3].as_py(), open_[4].as_py(), open_[5], open_[6]])
                    open_ = None
            first = sec.take(pa.array(cuts))
            if open_ is not None:
                rows[0] += open_[1]
                runs[0] += open_[2]
                vsum[0] += open_[5]
            firsts = first.to_pylist()
            if open_ is not None:
                firsts[0] = open_[3].as_py()
            keys, lasts = key.take(pa.array(cuts)), sec.take(pa.array(last))
            m = len(cuts) - 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], f.type) for i, f in enumerate(schema)], schema=schema)
            if m:
                cols = [pa.array(np.full(m, part)), keys.slice(0, m), pa.array(rows[:m]), pa.array(runs[:m]), pa.array(firsts[:m], sec.type), lasts.slice(0, m), pa.array(vsum[:m]), pa.array(v[last[:m]])]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(cols, schema)], schema=schema)
            open_ = [keys[m], int(rows[m]), int(runs[m]), pa.scalar(firsts[m], sec.type), lasts[m], int(vsum[m]), int(v[last[m]])]
        if open_ is not None:
            total = open_[5] + (open_[6] if open_[4].is_valid else 0)
            one = [part, open_[0].as_py(), open_[1], open_[2], open_[3].as_py(), open_[4].as_py(), total, open_[6]]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(one, schema)], schema=schema)

    return run


def partial_states(df: DataFrame, key: str, secondary: str | None, *, value: str | None = None, tie: Sequence[str | Column] = (), width: int | None = None) -> DataFrame:
    """One state per key and range partition; see :func:`per_key`."""
    from pyspark.sql.pandas.types import to_arrow_schema

    sec = F.col(secondary) if secondary else F.lit(None).cast("long")
    val = F.col(value).cast("long") if value else F.lit(0).cast("long")
    ties = [F.col(t) if isinstance(t, str) else t for t in tie]
    d = df.select(F.col(key).alias("k"), sec.alias("c"), val.alias("v"), *[t.alias(f"x{i}") for i, t in enumerate(ties)])
    d = d.withColumn("v", F.coalesce("v", F.lit(0).cast("long")))
    if not ties:  # rows with equal content can stand for each other, so where a task that runs again numbers them anew nothing changes
        d = df.select(F.col(key).alias("k"), sec.alias("c"), val.alias("v"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("x0"), F.monotonically_increasing_id().alias("x1"))
        d = d.withColumn("v", F.coalesce("v", F.lit(0).cast("long")))
    order = ["k", "c", "v", *[c for c in d.columns if c[0] == "x"]]
    d = d.repartitionByRange(width or partitions(df.sparkSession), *order).sortWithinPartitions(*order).select("k", "c", "v")
    out = T.StructType().add("part", "integer").add("k", d.schema["k"].dataType).add("n", "long").add("runs", "long").add("c_first", d.schema["c"].dataType).add("c_last", d.schema["c"].dataType).add("vsum", "long").add("v_last", "long")
    return d.mapInArrow(_states(to_arrow_schema(out)), out)


def stitch(states: DataFrame) -> DataFrame:
    """Per-key totals ``k, n, runs, vsum`` of the partial states of range partitions."""
    w = Window.partitionBy("k").orderBy("part")
    goes_on = F.col("c_first").isNotNull() & (F.lag("c_last").over(w) == F.col("c_first"))
    s = states.withColumn("goes_on", F.coalesce(goes_on, F.lit(False)))
    # of a run that goes on, the greatest value comes last, so what the partition before counted for it is taken back
    s = s.withColumn("before", F.when(F.col("goes_on"), F.lag("v_last").over(w)).otherwise(F.lit(0).cast("long")))
    return s.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("runs") - F.col("goes_on").cast("long")).alias("runs"), F.sum(F.col("vsum") - F.col("before")).alias("vsum"))


def per_key(df: DataFrame, key: str, secondary: str | None = None, *, value: str | None = None, tie: Sequence[str | Column] = (), width: int | None = None) -> DataFrame:
    """``k, n, runs, vsum`` for every key: its rows, its distinct non-null ``secondary`` values, and the
    sum over those values of the greatest ``value`` each has (nulls count as 0).

    * a null key is a key of its own; repeated rows all count in ``n``;
    * rows are spread by (key, secondary, value, tie-breaker), so equal rows may be parted too; without
      ``tie`` a hash of the whole row and then its position in the input is used;
    * ties of ``value`` need no rule, only the greatest is summed; an empty table gives no rows;
    * only the named columns are read, others may have any name.
    """
    return stitch(partial_states(df, key, secondary, value=value, tie=tie, width=width))


def hot_keys(df: DataFrame, key: str, share: float, *, tie: Sequence[str | Column] = (), width: int | None = None) -> DataFrame:
    """Keys that hold at least ``share`` of all rows (rows with null keys count in the total): ``k, n``. The total is the sum over the keys."""
    keys = written(per_key(df, key, tie=tie, width=width), "keys")  # a row a key
    total = keys.agg(F.sum("n")).first()[0] or 0
    return keys.where(F.col("k").isNotNull() & (F.col("n") >= share * total)).select("k", "n")
