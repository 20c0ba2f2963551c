"""Distinct counts of identifiers by day, group and combinations of groups, mergeable, with a known error.

Method.  An identifier is its 64-bit hash.  A partial result is a set of *runs*: for a group the
sorted distinct hashes, stored as differences in as few bytes as each needs.  Runs of the same group
are merged by union, and the count is the length of the union.  Two identifiers are confused only if
their hashes are equal; with n identifiers the expected number of such pairs is n(n-1)/2^65 (birthday
bound), which is reported beside each count: ``n_distinct`` is too low by k or more with probability
at most ``collision_bound`` / k.

Scale.  Tasks reduce their rows to runs before anything is shuffled, so a hot identifier or group is
reduced where it lies.  Runs are cut into *windows*, so chosen that unions in different windows have no
hash of a group in common, hence counts add up: combinations that have the day are cut by day (days
with more than ``WINDOW`` rows are cut further by hash range), the others by hash range alone.  A task
gets the runs of its windows in order and holds one window at a time, about ``WINDOW`` hashes, however
much it reads: a k-way union that goes through the hash space window by window.  Within a window runs
are merged, not sorted anew: the order of all its hashes is found once, and merges of runs that are
sorted already find the runs (a natural merge sort); a coarser combination merges the unions of the
finer one instead of all runs again.  The number of tasks grows with the square root of the bytes, and
so do the bytes of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.shared import partitions, written

FLUSH = 1 << 20
#: Hashes that a task unites at once.
WINDOW = 1 << 20
#: A hash in a run takes about so many bytes.
HASH_BYTES = 9
NO_DAY = -(2**31)
RUNS = "kind int, bucket int, field string, t int, win int, p string, src_file string, n int, run binary"
#: The combinations, by kind (with the day, without it), and the finer one of which each is made.
COMBOS = (
    ((("t", "p", "src_file"), None), (("t", "p"), 0), (("t", "src_file"), 0), (("t",), 1)),
    ((("p", "src_file"), None), (("p",), 0), (("src_file",), 0)),
)


def encode(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of sorted hashes as bytes: all of them in a row, and the offset of each.

    ``starts`` has the first index of each run. A run has one byte a hash for the length of its
    difference to the one before, then the differences, low bytes first.
    """
    d = h.copy()
    d[1:] -= h[:-1]
    d[starts] = h[starts]
    size = np.ones(len(d), np.int64)
    for k in range(1, 8):
        size += (d >> np.uint64(8 * k)) > 0
    counts = np.diff(np.append(starts, len(d)))
    run = np.repeat(np.arange(len(starts)), counts)
    total = np.add.reduceat(size, starts) + counts
    offset = np.concatenate([[0], np.cumsum(total)])
    out = np.zeros(offset[-1], np.uint8)
    out[offset[run] + np.arange(len(d)) - starts[run]] = size
    before = np.cumsum(size) - size
    at = offset[run] + counts[run] + before - before[starts][run]
    for k in range(8):
        m = size > k
        out[at[m] + k] = ((d[m] >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8)
    return out, offset


def decode(data: np.ndarray, offset: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The hashes of encoded runs of the given lengths."""
    run = np.repeat(np.arange(len(counts)), counts)
    starts = np.cumsum(counts) - counts
    n = len(run)
    size = data[offset[run] + np.arange(n) - starts[run]].astype(np.int64)
    before = np.cumsum(size) - size
    at = offset[run] + counts[run] + before - before[starts][run]
    d = np.zeros(n, np.uint64)
    for k in range(8):
        m = size > k
        d[m] |= data[at[m] + k].astype(np.uint64) << np.uint64(8 * k)
    s = np.cumsum(d)  # wraps around; the differences of the sums are right
    return s - np.where(starts[run] > 0, s[starts[run] - 1], np.uint64(0))


def _codes(col: pa.Array) -> tuple[np.ndarray, pa.Array]:
    e = col.dictionary_encode(null_encoding="encode")
    if isinstance(e, pa.ChunkedArray):
        e = e.combine_chunks()
    return e.indices.to_numpy().astype(np.int64), e.dictionary


def merged(group: np.ndarray, rank: np.ndarray, ranks: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (group, rank) pairs in order, out of sorted runs that stand one behind the other.

    Both are in one number, whose stable sort is a merge of the ascending runs it finds.
    """
    k = np.sort(group * ranks + rank, kind="stable")
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    k = k[new]
    return k // ranks, k % ranks


class Width:
    """How a table of so many rows is cut: tasks, windows of the hash space in the part of a task, and rows that make a day hot."""

    def __init__(self, rows: int, session: int, window: int = 0):
        self.window = window or WINDOW
        size = 2 * HASH_BYTES * rows  # two fields; each kind has as much
        self.tasks = max(session, -(-int(size**0.5) // 256))
        self.parts = max(1, -(-rows // (self.tasks * self.window)))


class _Pairs:
    """Rows (t, p, src_file, hash) of one field, to be made into runs."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, t: np.ndarray, p: pa.Array, src: pa.Array, h: np.ndarray) -> None:
        if len(h):
            self.parts.append((t, p, src, h))
            self.n += len(h)

    def runs(self, field: str, width: Width, hot: dict[int, int], kinds: tuple[int, ...] = (0, 1)) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        t = np.concatenate([x[0] for x in self.parts]).astype(np.int64)
        p, names = _codes(pa.chunked_array([x[1] for x in self.parts]))
        s, files = _codes(pa.chunked_array([x[2] for x in self.parts]))
        h = np.concatenate([x[3] for x in self.parts])
        self.parts, self.n = [], 0
        high = h >> np.uint64(32)
        days, day = np.unique(t, return_inverse=True)
        cut = np.array([hot.get(x, 1) for x in days.tolist()], np.uint64)[day]
        shard = ((high * cut) >> np.uint64(32)).astype(np.int64)
        for kind in kinds:
            if kind == 0:  # a window is one day, or one hash range of a hot day
                win = shard
                bucket = ((t * 1000003 + shard * 7919) * 2654435761 % (1 << 31)) % width.tasks
                lead = day * (int(shard.max()) + 1) + shard
            else:
                whole = ((high * np.uint64(width.tasks * width.parts)) >> np.uint64(32)).astype(np.int64)
                bucket, win = whole // width.parts, whole % width.parts
                lead = whole
            group = (lead * len(names) + p) * len(files) + s
            order = np.lexsort((h, group))
            g, x = group[order], h[order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1])
            order, g, x = order[new], g[new], x[new]
            starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            data, offset = encode(x, starts)
            first = order[starts]
            counts = np.diff(np.append(starts, len(x)))
            for a in range(0, len(starts), 1 << 14):
                f, o = first[a : a + (1 << 14)], offset[a : a + (1 << 14) + 1]
                run = pa.Array.from_buffers(pa.binary(), len(f), [None, pa.py_buffer((o - o[0]).astype(np.int32)), pa.py_buffer(data[o[0] : o[-1]])])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(f), kind, np.int32)), pa.array(bucket[f].astype(np.int32)), pa.array([field] * len(f)),
                        pa.array(t[f].astype(np.int32) if kind == 0 else np.full(len(f), NO_DAY, np.int32)), pa.array(win[f].astype(np.int32)),
                        names.take(pa.array(p[f])), files.take(pa.array(s[f])), pa.array(counts[a : a + (1 << 14)].astype(np.int32)), run,
                    ],
                    ["kind", "bucket", "field", "t", "win", "p", "src_file", "n", "run"],
                )


def _days(b: pa.RecordBatch) -> np.ndarray:
    t = b.column(0).cast(pa.int32())
    return pc.fill_null(t, NO_DAY).to_numpy(zero_copy_only=False)


def _cuts(by_day: DataFrame, window: int) -> dict[int, int]:
    """Days with more rows than a window, and into how many hash ranges to cut them: at most as many as the calendar has (3.7 million). ``by_day``: t, n."""
    return {r["t"]: -(-r["n"] // window) for r in by_day.where(F.col("n") > window).collect()}


def _cut(by_day: DataFrame, width: int | None, window: int | None) -> tuple[Width, dict[int, int]]:
    by_day = written(by_day, "days")  # a row a day
    rows = by_day.agg(F.sum("n")).first()[0] or 0
    w = Width(rows, width or partitions(by_day.sparkSession), window or WINDOW)
    return w, _cuts(by_day, w.window)


def _by_day(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce(F.unix_date("t"), F.lit(NO_DAY)).alias("t")).agg(F.count("*").alias("n"))


def _hashes(run: pa.Array, n: np.ndarray) -> np.ndarray:
    """The hashes of a column of runs, one run behind the other."""
    wide = np.int64 if pa.types.is_large_binary(run.type) else np.int32
    offset = np.frombuffer(run.buffers()[1], wide)[run.offset : run.offset + len(run) + 1].astype(np.int64)
    return decode(np.frombuffer(run.buffers()[2], np.uint8), offset[:-1], n)


def cut_rows(df: DataFrame, width: int | None = None, window: int | None = None) -> tuple[Width, dict[int, int]]:
    """How to cut a table: its tasks and its hot days. One pass over the days."""
    return _cut(_by_day(df), width, window)


def cut_runs(runs: DataFrame, width: int | None = None, window: int | None = None) -> tuple[Width, dict[int, int]]:
    """The same for partial results."""
    return _cut(runs.where("kind = 0").groupBy("t", "field").agg(F.sum("n").alias("n")).groupBy("t").agg(F.max("n").alias("n")), width, window)


def build_runs(df: DataFrame, width: int | None = None, window: int | None = None, cut: tuple[Width, dict[int, int]] | None = None) -> DataFrame:
    """Mergeable partial results of ``t DATE, p, src_file, s, o``: runs that may be stored and merged later.

    Schema: see ``RUNS``; ``kind`` 0 has runs of (t, p, src_file), 1 of (p, src_file).
    Null identifiers don't count; null days, predicates and dumps are groups of their own.
    ``width`` is the least number of tasks, the session's shuffle width if not given.
    """
    width, hot = cut or cut_rows(df, width, window)
    h = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c))
    d = df.select(F.unix_date("t").alias("t"), "p", "src_file", h("s").alias("s"), h("o").alias("o"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = {"s": _Pairs(), "o": _Pairs()}
        for b in batches:
            t = _days(b)
            for i, (f, x) in enumerate(pairs.items()):
                ids = b.column(3 + i)
                m = pc.is_valid(ids)
                keep = m.to_numpy(zero_copy_only=False)
                x.add(t[keep], b.column(1).filter(m), b.column(2).filter(m), ids.filter(m).to_numpy(zero_copy_only=False).astype(np.uint64))
                if x.n >= FLUSH:
                    yield from x.runs(f, width, hot)
        for f, x in pairs.items():
            yield from x.runs(f, width, hot)

    return d.mapInArrow(run, RUNS)


def merge_runs(a: DataFrame, b: DataFrame, width: int | None = None, window: int | None = None, cut: tuple[Width, dict[int, int]] | None = None) -> DataFrame:
    """Partial results of two sets of rows as one, however each was cut; counts are those of all rows together.

    Runs are cut anew for the days that are hot in both together, and united where a task meets them.
    """
    runs = a.unionByName(b)
    width, hot = cut or cut_runs(runs, width, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], _Pairs] = {}
        for x in batches:
            kind, field, n = x.column(0).to_numpy(), np.array(x.column(2).to_pylist()), x.column(7).to_numpy().astype(np.int64)
            for key in set(zip(kind.tolist(), field.tolist())):
                at = np.flatnonzero((kind == key[0]) & (field == key[1]))
                part = x.take(pa.array(at))
                each = pa.array(np.repeat(np.arange(len(at)), n[at]))
                p = held.setdefault(key, _Pairs())
                p.add(part.column(3).to_numpy()[each.to_numpy()], part.column(5).take(each), part.column(6).take(each), _hashes(part.column(8), n[at]))
                if p.n >= FLUSH:
                    yield from p.runs(key[1], width, hot, (key[0],))
        for (kind_, field_), p in held.items():
            yield from p.runs(field_, width, hot, (kind_,))

    return runs.mapInArrow(run, RUNS)


def count_window(tab: pa.Table) -> Iterator[pa.RecordBatch]:
    """The counts of all combinations in the runs of one window, of one kind and field."""
    kind, field = tab["kind"][0].as_py(), tab["field"][0].as_py()
    n = tab["n"].to_numpy().astype(np.int64)
    raw = tab["run"].combine_chunks()
    if isinstance(raw, pa.ChunkedArray):
        raw = pa.concat_arrays(raw.chunks)
    distinct, rank = np.unique(_hashes(raw, n), return_inverse=True)
    code, names = {}, {}
    for c in ("t", "p", "src_file"):
        code[c], names[c] = _codes(tab[c])
    made: list[tuple[tuple[str, ...], np.ndarray, np.ndarray]] = []
    for combo, finer in COMBOS[kind]:
        if finer is None:
            g = np.zeros(len(n), np.int64)
            for c in combo:
                g = g * len(names[c]) + code[c]
            g, r = np.repeat(g, n), rank
        else:  # groups of the finer combination without what the coarser one lacks
            cols, g, r = made[finer]
            parts = {}
            for c in reversed(cols):
                parts[c] = g % len(names[c])
                g = g // len(names[c])
            g = np.zeros(len(r), np.int64)
            for c in combo:
                g = g * len(names[c]) + parts[c]
        u, r = merged(g, r, len(distinct))
        made.append((combo, u, r))
        starts = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.zeros(0, np.int64)
        counts, u = np.diff(np.append(starts, len(u))), u[starts]
        got = {}
        for c in reversed(combo):
            got[c] = names[c].take(pa.array(u % len(names[c])))
            u = u // len(names[c])
        for a in range(0, len(starts), 1 << 15):
            m = len(counts[a : a + (1 << 15)])
            cols = [got[c].slice(a, m) if c in got else pa.nulls(m, pa.int32() if c == "t" else pa.string()) for c in ("t", "p", "src_file")]
            yield pa.RecordBatch.from_arrays([pa.array([",".join(combo)] * m), *cols, pa.array([field] * m), pa.array(counts[a : a + m])], ["dims", "t", "p", "src_file", "field", "n"])


def count_runs(runs: DataFrame, width: int | None = None) -> DataFrame:
    """``dims, t, p, src_file, field, n_distinct, collision_bound`` for each day, predicate, dump and combination.

    ``dims`` names the combination, e.g. ``t,p``; columns that aren't in it are null. A group that
    has only null identifiers of a field has no row for it; an empty table gives no rows.
    ``width`` is the number of tasks; if not given, the runs are asked for it (one column of stored ones).
    """
    tasks = width or max(partitions(runs.sparkSession), (runs.agg(F.max("bucket")).first()[0] or 0) + 1)
    part = runs.repartition(tasks, "kind", "bucket", "field").sortWithinPartitions("kind", "bucket", "field", "t", "win")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last, size = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            num = [b.column(i).to_numpy() for i in (0, 1, 3, 4)]
            f, _ = _codes(b.column(2))
            new = np.ones(b.num_rows, bool)  # a window begins
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in (*num, f)])
            cuts = [*np.flatnonzero(new), b.num_rows]
            whole = np.append(0, np.cumsum(b.column(7).to_numpy().astype(np.int64)))
            for x, y in zip(cuts, cuts[1:]):
                at = (int(num[0][x]), b.column(2)[x].as_py(), int(num[1][x]), int(num[2][x]), int(num[3][x]))
                # windows are independent; small ones of a kind and field go together
                if held and at != last and (at[:2] != last[:2] or size + whole[y] - whole[x] > WINDOW):
                    yield from count_window(pa.Table.from_batches(held).combine_chunks())
                    held, size = [], 0
                held.append(b.slice(x, y - x))
                last, size = at, size + whole[y] - whole[x]
        if held:
            yield from count_window(pa.Table.from_batches(held).combine_chunks())

    c = part.mapInArrow(run, "dims string, t int, p string, src_file string, field string, n bigint")
    c = c.groupBy("dims", "t", "p", "src_file", "field").agg(F.sum("n").alias("n_distinct"))
    day = F.when(F.col("t") != NO_DAY, F.date_from_unix_date("t"))
    n = F.col("n_distinct").cast("double")
    return c.select("dims", day.alias("t"), "p", "src_file", "field", "n_distinct", (n * (n - 1) / F.lit(2.0**65)).alias("collision_bound"))


def distinct_counts(df: DataFrame) -> DataFrame:
    """The counts of a table, by way of runs that go from the tasks that make them straight to those that unite them."""
    cut = cut_rows(df)
    return count_runs(build_runs(df, cut=cut), cut[0].tasks)


def stored_counts(parts: list[DataFrame]) -> DataFrame:
    """The counts of tables together, out of partial results that are stored for each."""
    runs = [written(build_runs(p), "runs") for p in parts]
    both = runs[0]
    for r in runs[1:]:
        cut = cut_runs(both.unionByName(r))
        both = merge_runs(both, r, cut=cut)
    return count_runs(both, cut[0].tasks if len(runs) > 1 else None)
