"""Most frequent values of columns with very many rows and distinct values, in bounded memory.

Method.  Every value is hashed to 60 bits.  For each of the prefixes of 24, 36, 48 and 60 bits there
is a count-sketch (``depth`` rows of ``width`` signed counters); the prefixes of 12 bits have exact
counters.  Each task fills its own sketches, vectorised; a sketch is linear, so the cells are simply
summed across tasks, at most ``cells()`` of them per column however many rows there are.  The driver
then descends: of every heavy prefix all 4,096 extensions are estimated (median over the rows of the
sketch) and those kept that may hold half the threshold.  What is left of 60 bits are the candidates,
at most about 2/share of them; a second scan counts them exactly and drops the rest.

Error.  An estimate of a row is off by about ||tail||_2 / sqrt(width), where the tail is what doesn't
collide with a heavy value; heavy values collide with one another in a row with probability
heavy/width, and the median of ``depth`` rows needs three such accidents.  Keeping everything above
half the threshold leaves a margin of share/2 of all rows, so with the defaults (2048 x 5, share
0.005) the margin is at least 5 standard errors even for a tail of one value a row in twenty thousand.
Counts that come out are exact, since the second scan counts; the estimate is given beside them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP, LEVELS = 12, 4
WIDTH, DEPTH = 2048, 5
SHARE = 0.005
FAN = 1 << STEP
_BUFFER = 1 << 18


def cells(width: int = WIDTH, depth: int = DEPTH) -> int:
    return FAN + LEVELS * depth * width


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of each number (the finaliser of splitmix64)."""
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place(prefix: np.ndarray, level: int, row: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The counter and the sign of each prefix in one row of a level's sketch."""
    m = _mix(prefix, 1 + level * 64 + row)
    return (m >> np.uint64(1)) % np.uint64(width), 1 - 2 * (m & np.uint64(1)).astype(np.int64)


def add(sketch: np.ndarray, h: np.ndarray, width: int = WIDTH, depth: int = DEPTH) -> None:
    """Counts the hashes (60 bits, as uint64) in a sketch."""
    sketch[:FAN] += np.bincount((h >> np.uint64(STEP * LEVELS)).astype(np.int64), minlength=FAN)
    for level in range(1, LEVELS + 1):
        prefix = h >> np.uint64(STEP * (LEVELS - level))
        for row in range(depth):
            at, sign = _place(prefix, level, row, width)
            a = FAN + ((level - 1) * depth + row) * width
            sketch[a : a + width] += np.bincount(at.astype(np.int64), weights=sign, minlength=width).astype(np.int64)


def estimate(sketch: np.ndarray, prefix: np.ndarray, level: int, width: int = WIDTH, depth: int = DEPTH) -> np.ndarray:
    rows = []
    for row in range(depth):
        at, sign = _place(prefix, level, row, width)
        rows.append(sketch[FAN + ((level - 1) * depth + row) * width + at.astype(np.int64)] * sign)
    return np.median(rows, axis=0)


def descend(sketch: np.ndarray, least: float, width: int = WIDTH, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The 60-bit hashes that may have ``least`` occurrences, with their estimates."""
    heavy = np.flatnonzero(sketch[:FAN] >= max(least, 1)).astype(np.uint64)
    est = sketch[heavy.astype(np.int64)].astype(float)
    for level in range(1, LEVELS + 1):
        kept, counts = [], []
        for part in np.array_split(heavy, max(1, len(heavy) // 64)):  # some megabytes at a time
            child = ((part[:, None] << np.uint64(STEP)) + np.arange(FAN, dtype=np.uint64)).ravel()
            e = estimate(sketch, child, level, width, depth)
            kept.append(child[e >= max(least, 1)])
            counts.append(e[e >= max(least, 1)])
        heavy, est = np.concatenate(kept), np.concatenate(counts)
    return heavy, est


def _hash(c: str):
    return F.shiftrightunsigned(F.xxhash64(c), 64 - STEP * (LEVELS + 1))


def sketches(df: DataFrame, columns: Sequence[str], width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """The summed sketches of the columns: ``cell INT, v BIGINT``, mergeable by adding ``v``."""
    size = cells(width, depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros((len(columns), size), np.int64)
        kept: list[list[np.ndarray]] = [[] for _ in columns]

        def flush():
            for i, k in enumerate(kept):
                if k:
                    add(mine[i], np.concatenate(k), width, depth)
                    k.clear()

        n = 0
        for b in batches:
            for i in range(len(columns)):
                kept[i].append(b.column(i).drop_null().to_numpy(zero_copy_only=False).astype(np.uint64))
            n += b.num_rows
            if n >= _BUFFER:
                flush()
                n = 0
        flush()
        flat = mine.ravel()
        at = np.flatnonzero(flat)
        for a in range(0, len(at), 1 << 16):
            x = at[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array(flat[x])], ["cell", "v"])

    h = df.select(*[F.when(F.col(c).isNotNull(), _hash(c)).alias(f"h{i}") for i, c in enumerate(columns)])
    return h.mapInArrow(run, "cell int, v bigint").groupBy("cell").agg(F.sum("v").alias("v"))


def frequent(df: DataFrame, columns: Sequence[str], share: float = SHARE, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """Values with at least ``share`` of the non-null values of their column.

    Result: ``field STRING, item STRING, n BIGINT`` (exact), ``estimate DOUBLE`` (of the sketch),
    ``share DOUBLE``.  Values are compared as they stand; the empty string is a value, null isn't;
    repeated rows all count; ties at the threshold all come out; a column without values gives no rows;
    ``share`` must be at least 0.0002, so that the candidates stay few. Other columns aren't read.
    """
    if not 0.0002 <= share <= 1:
        raise ValueError("share must lie between 0.0002 and 1")
    spark = df.sparkSession
    got = sketches(df, columns, width, depth).toArrow()
    flat = np.zeros(len(columns) * cells(width, depth), np.int64)
    flat[got["cell"].to_numpy()] = got["v"].to_numpy()
    items, total = [], {}
    for c, sk in zip(columns, flat.reshape(len(columns), -1)):
        total[c] = int(sk[:FAN].sum())
        heavy, est = descend(sk, share / 2 * total[c], width, depth)
        items += [(c, int(h), float(e)) for h, e in zip(heavy, est)]
    if not items:
        return spark.createDataFrame([], "field string, item string, n bigint, estimate double, share double")
    # second scan: only candidates pass the filter, which runs before any shuffle
    wide = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("item"), _hash(c).alias("h")) for c in columns])
    rows = df.select(F.explode(wide).alias("x")).select("x.*").where(F.col("item").isNotNull())
    among = F.lit(False)
    for c in columns:
        if hs := [h for f, h, _ in items if f == c]:
            among = among | ((F.col("field") == c) & F.col("h").isin(hs))
    counted = rows.where(among).groupBy("field", "item", "h").agg(F.count("*").alias("n"))
    # bounded by the candidates, about 2/share for each column
    known = spark.createDataFrame([(*x, float(total[x[0]])) for x in items], "field string, h bigint, estimate double, total double")
    out = counted.join(F.broadcast(known), ["field", "h"]).withColumn("share", F.col("n") / F.col("total"))
    return out.where(F.col("n") >= F.lit(share) * F.col("total")).select("field", "item", "n", "estimate", "share")
