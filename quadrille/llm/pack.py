"""Packing items of varying length into containers of fixed capacity, whole unless larger than one.

Method.  Sizes are whole numbers up to the capacity, so all that packing needs is how many items there
are of each size: a histogram of at most ``capacity`` + 1 entries, whatever the number of items.  The
plan is made from it: items above a third of the capacity are matched greedily, the largest with the
largest that fits beside it (two such items at most go into a container); smaller ones, from the
largest down, go to the fullest container they fit, as many of a size at once as fit.  The plan
consists of classes of equally filled containers; their number depends on the capacity only.

An item finds its container by its rank among the items of its size: tasks number the items of each
size as they measure them, offsets between tasks come from a running sum over the tasks' counts, and
the plan says which ranks of a size go to which containers.  So all items are packed against all
others, with no group of items in one task, and nothing on the driver grows with the data.

An item beyond the capacity is cut into full containers and a rest, which is packed like an item.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.functions.shared import written
from quadrille.llm import encode as E

CAPACITY = 2048
_RANK = 43  # bits of a rank within a size


@dataclass
class Class_:
    """``n`` containers with the same room left and the same content: a chain of (size, copies, rest)."""

    n: int
    room: int
    content: tuple | None


def plan(histogram: dict[int, int], capacity: int) -> list[Class_]:
    """Classes of containers that take all items of positive size."""
    left = {s: n for s, n in histogram.items() if s > 0 and n > 0}
    done: list[Class_] = []
    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        i = bisect_left(large, capacity - a + 1) - 1
        if i < 0:
            n, b = left[a], 0
            left[a] = 0
        else:
            b = large[i]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if n == 0:  # a single one of this size is left
                below = i - 1
                n, b = 1, large[below] if below >= 0 else 0
            left[a] -= n
            if b:
                left[b] -= n
        content = (a, 1, None)
        done.append(Class_(n, capacity - a - b, (b, 1, content) if b else content))
        large = [s for s in large if left[s]] if not (left[a] and (not b or left[b])) else large
    rooms: dict[int, list[Class_]] = {}
    sizes: list[int] = []  # rooms in use, sorted

    def put(c: Class_) -> None:
        if not rooms.get(c.room):
            insort(sizes, c.room)
            rooms[c.room] = []
        rooms[c.room].append(c)

    for c in done:
        put(c)
    for s in sorted((s for s in left if left[s] and 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            i = bisect_left(sizes, s)
            if i < len(sizes):
                c = rooms[sizes[i]].pop()
                if not rooms[c.room]:
                    del sizes[i]
            else:
                c = Class_(-(-n // (capacity // s)), capacity, None)
            k = c.room // s
            full = min(c.n, n // k)
            rest = n - full * k if full < c.n else 0
            rest = min(rest, k - 1)
            if full:
                put(Class_(full, c.room - k * s, (s, k, c.content)))
            if rest:
                put(Class_(1, c.room - rest * s, (s, rest, c.content)))
            if c.n - full - (rest > 0):
                put(Class_(c.n - full - (rest > 0), c.room, c.content))
            n -= full * k + rest
    return [c for cs in rooms.values() for c in cs if c.content]


def ranges(classes: list[Class_]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """For the ranks of each size, where they go: sorted keys (size, first rank), first rank, first container, containers; and the number of containers."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for c in classes:
        x = c.content
        while x:
            size, k, x = x
            r = used.get(size, 0)
            rows.append(((size << _RANK) + r, r, first, c.n))
            used[size] = r + c.n * k
        first += c.n
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return a[:, 0].copy(), a[:, 1].copy(), a[:, 2].copy(), a[:, 3].copy(), first


def measured(df: DataFrame, key: str, text: str, capacity: int, vocabulary: str) -> DataFrame:
    """The pieces of all texts with their sizes, numbered by size within the task that measured them."""
    path = E.compile_lexicon(df, text, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = E.Encoder(path, vocabulary)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for a, b, data, ends in E.chunks(batch.column(1)):
                n = enc.counts(data, ends)
                pieces = np.maximum(1, -(-n // capacity))
                item = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(item)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                size = np.minimum(n[item] - start, capacity)
                order = np.argsort(size, kind="stable")
                s = size[order]
                begin = np.searchsorted(s, s)
                seq = np.empty(len(s), np.int64)
                seq[order] = np.arange(len(s)) - begin + seen[s]
                seen += np.bincount(s, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(item)), pa.array(piece), pa.array(start), pa.array(size), pa.array(np.full(len(s), part, np.int32)), pa.array(seq)],
                    [key, "piece", "first_token", "n_tokens", "part", "seq"],
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece long, first_token long, n_tokens long, part int, seq long")


def pack(df: DataFrame, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = E.VOCABULARY) -> DataFrame:
    """``<key>, piece, first_token, n_tokens, container``: where each text goes, in tokens of the vocabulary.

    * a text of at most ``capacity`` tokens is one piece (0); a longer one has pieces of ``capacity`` tokens and a rest;
    * null and empty texts have 0 tokens and are spread over all containers (container 0 if there is no other);
    * containers are numbered from 0; which of equally long texts goes where isn't defined;
    * repeated rows and keys are packed each; an empty table gives no rows; other columns aren't read.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    items = written(measured(df, key, text, capacity, vocabulary), "sizes")
    by = items.groupBy("part", "n_tokens").agg(F.count("*").alias("n"))
    w = Window.partitionBy("n_tokens").orderBy("part")
    offset = by.withColumn("before", F.sum("n").over(w) - F.col("n")).drop("n")
    histogram = {r["n_tokens"]: r["n"] for r in by.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}  # at most capacity + 1 rows
    at, rank0, first, n, total = ranges(plan(histogram, capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column(3).to_numpy(), b.column(4).to_numpy()
            box = rank % max(total, 1)
            full = np.flatnonzero(size > 0)
            if len(full):
                i = np.searchsorted(at, (size[full] << _RANK) + rank[full], "right") - 1
                box[full] = first[i] + (rank[full] - rank0[i]) % n[i]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(box)], [key, "piece", "first_token", "n_tokens", "container"])

    ranked = items.join(offset, ["part", "n_tokens"]).select(key, "piece", "first_token", "n_tokens", (F.col("before") + F.col("seq")).alias("rank"))
    kind = df.schema[key].dataType.simpleString()
    return ranked.mapInArrow(run, f"`{key}` {kind}, piece long, first_token long, n_tokens long, container long")
