"""Records that differ only in spelling: case, blanks, punctuation, order of the fields.

A record's canonical bytes are the letters and digits of its subject, predicate and object in lower
case, the fields parted by one separator.  Records with the same canonical bytes are the same.

Method.  Buckets are prefixes of the canonical bytes.  Beginning with one bucket, every bucket that
holds more bytes than a task should is split by further bytes, from the end of what all its members
share, until each fits, however many there are in all.  A bucket that is too large but holds one single
value, a hot group of copies, can't be split and needn't: its count and smallest id are known from the
same pass, and its records are answered where they lie, without a shuffle.  Records of the other buckets
are shuffled once, by bucket; each bucket is counted in a burst trie whose terminals hold counter and
smallest id.

The tree of splits has one entry (hash of the prefix, next length, level; 13 bytes) for every bucket that
was ever too large, so fewer than one for every ``bucket_bytes`` bytes and level: 40 MB for 100 TB and
buckets of 32 MB.  Tasks walk whole batches of records down the tree at once: hashes of all prefixes of
all records come from one running sum over the batch's bytes.  Prefixes with equal hashes share a
bucket, which costs nothing but a little time, since a bucket's tries compare the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quadrille.functions.shared import partitions, written

BUCKET_BYTES = 32 << 20
STEP = 2
WORDS = 3  # of 8 bytes behind a prefix, in which what its bucket shares is looked for on a level
BURST = 8192
OVERHEAD = 64  # bytes a record takes besides its text
FIELDS = ("subject", "predicate", "object")
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_STATE = "k long, d int, w long, n long, least long, lo binary, hi binary, " + ", ".join(f"a{j} long, b{j} long" for j in range(WORDS))


def canonical(df: DataFrame, key: str, record: str) -> DataFrame:
    """``<key>, c``: canonical bytes of records (JSON objects or ``name=value`` fields parted by ``|``); null for null.

    A record that is neither, or lacks one of the three names, has its own letters and digits behind a
    mark, so it equals only records spelt alike. Of a name given twice the first counts.
    """
    r = F.col("r")
    entries = F.map_entries(F.from_json(r, "map<string,string>"))
    pairs = F.transform(F.split(r, r"\|"), lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.substr(x, F.instr(x, "=") + 1).alias("value")))
    # each step is a projection of its own, so that nothing is computed twice
    d = df.select(F.col(key).cast("long").alias(key), F.col(record).alias("r"))
    d = d.select(key, "r", F.when(F.ltrim(r).startswith("{"), entries).otherwise(pairs).alias("f"))
    d = d.select(key, "r", "f", F.transform("f", lambda e: F.lower(F.trim(e["key"], F.lit(" \t\r\n\xa0")))).alias("k"))
    at = [F.array_position("k", n) for n in FIELDS]
    d = d.select(key, "r", "f", *[F.coalesce(p, F.lit(0)).cast("int").alias(f"i{j}") for j, p in enumerate(at)])
    whole = F.concat_ws("\x1f", *[F.translate(F.coalesce(F.get("f", F.col(f"i{j}") - 1)["value"], F.lit("")), "\x1f", "") for j in range(3)])
    complete = (F.col("i0") > 0) & (F.col("i1") > 0) & (F.col("i2") > 0)
    c = F.when(complete, bare(whole)).otherwise(F.concat(F.lit("\x1e"), bare(F.translate(r, "\x1f", ""))))
    return d.select(key, F.when(r.isNotNull(), F.encode(c, "UTF-8")).alias("c"))


def bare(text: Column) -> Column:
    """Letters, digits and separators, whatever their case."""
    return F.lower(F.upper(F.regexp_replace(text, r"[^\p{L}\p{Nd}\x1f]+", "")))


class Tree:
    """The splits: for the hash of a prefix that was split, the length of the next one and the level it was split on."""

    def __init__(self):
        self.hash, self.next, self.level = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int8)
        self.levels = 0

    def split(self, hashes: np.ndarray, lengths: np.ndarray) -> Tree:
        """The tree with one more level."""
        t = Tree()
        h = np.concatenate([self.hash, hashes])
        order = np.argsort(h, kind="stable")
        t.hash = h[order]
        t.next = np.concatenate([self.next, lengths.astype(np.int32)])[order]
        t.level = np.concatenate([self.level, np.full(len(hashes), self.levels, np.int8)])[order]
        t.levels = self.levels + 1
        return t

    def walk(self, c: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each byte string its leaf (hash and length of the prefix) and the level of the leaf's parent (-1: none); the bytes and offsets."""
        c = c.cast(pa.large_binary())
        offset = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
        data = np.frombuffer(c.buffers()[2], np.uint8)[offset[0] : offset[-1]] if c.buffers()[2] else np.zeros(0, np.uint8)
        offset = offset - offset[0]
        up, down = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        size = np.diff(offset)
        d, key, parent = np.zeros(len(c), np.int64), np.zeros(len(c), np.uint64), np.full(len(c), -1, np.int8)
        active = np.arange(len(c))
        while len(active) and len(self.hash):
            at = np.minimum(np.searchsorted(self.hash, key[active]), len(self.hash) - 1)
            longer = np.minimum(self.next[at], size[active])
            go = (self.hash[at] == key[active]) & (longer > d[active])
            active, at, longer = active[go], at[go], longer[go]
            o = offset[active]
            h = (total[o + longer] - total[o]) * down[o]
            h ^= h >> np.uint64(29)
            key[active] = h * np.uint64(BASE) + longer.astype(np.uint64)
            d[active], parent[active] = longer, self.level[at]
        return key, d, parent, data, offset


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64; kept for the longest batch so far."""
    if len(_POWERS[0]) < n:
        for i, x in enumerate((BASE, _INVERSE)):
            p = np.full(n + n // 4, x, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p)
    return _POWERS


def _first(group: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(n, np.int64)
    out[group[::-1]] = np.arange(len(group))[::-1]
    return out


def level_states(c: pa.Array, ids: np.ndarray, tree: Tree) -> pa.RecordBatch:
    """What a batch says about the buckets of the tree's last level: bytes, records, smallest id, whether all are one value, and the range of the bytes that follow."""
    key, d, parent, data, offset = tree.walk(c)
    rows = np.flatnonzero(parent == tree.levels - 1)
    keys, group = np.unique(key[rows], return_inverse=True)
    m = len(keys)
    first = _first(group, m)
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(m))
    size = np.diff(offset)[rows]
    value = c.take(pa.array(rows))
    same = pc.equal(value, value.take(pa.array(first[group]))).to_numpy(zero_copy_only=False)
    one = value.take(pa.array(first)).cast(pa.binary())
    single = np.logical_and.reduceat(same[order], starts) if m else np.zeros(0, bool)
    by = lambda f, x: f.reduceat(x[order], starts) if m else np.zeros(0, np.int64)
    cols = [
        pa.array(keys.view(np.int64)), pa.array(d[rows][first].astype(np.int32)), pa.array(by(np.add, size + OVERHEAD)), pa.array(by(np.add, np.ones(len(rows), np.int64))), pa.array(by(np.minimum, ids[rows])),
        one, pc.if_else(pa.array(single), one, pc.binary_join_element_wise(one, pa.scalar(b"\xff"), pa.scalar(b""))),
    ]
    at, end = offset[rows] + d[rows], offset[rows + 1]
    for _ in range(WORDS):
        word = np.zeros(len(rows), np.uint64)
        for _ in range(8):
            word = (word << np.uint64(8)) | np.where(at < end, data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.uint64)
            at = at + 1
        signed = (word ^ np.uint64(1 << 63)).view(np.int64)
        cols += [pa.array(by(np.minimum, signed)), pa.array(by(np.maximum, signed))]
    return pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip(cols, _KINDS)], _NAMES)


_NAMES = [x.split()[0] for x in _STATE.split(", ")]
_KINDS = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in _STATE.split(", ")]


def shared_length(lows: list[int], highs: list[int]) -> int:
    """How many of the bytes behind a prefix all members of its bucket share, of those that were looked at."""
    n = 0
    for a, b in zip(lows, highs):
        if a != b:
            return n + (64 - (a ^ b).bit_length()) // 8
        n += 8
    return n


def splits(canon: DataFrame, key: str, bucket_bytes: int, total: int) -> tuple[Tree, dict[int, tuple[int, int]]]:
    """The tree of splits, and for each hot value's bucket the smallest id and the count."""
    limit = min(bucket_bytes, total / (2 * partitions(canon.sparkSession)))
    tree = Tree().split(np.zeros(1, np.uint64), np.ones(1, np.int32))
    hot: dict[int, tuple[int, int]] = {}
    rows = canon.select("c", F.col(key).cast("long").alias("i"))
    while total:

        def level(batches: Iterator[pa.RecordBatch], tree=tree) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield level_states(b.column(0), b.column(1).to_numpy(), tree)

        part = rows.mapInArrow(level, _STATE)
        low = [F.min(x).alias(x) for x in ("least", "lo", *(f"a{j}" for j in range(WORDS)))]
        high = [F.max(x).alias(x) for x in ("d", "hi", *(f"b{j}" for j in range(WORDS)))]
        merged = part.groupBy("k").agg(F.sum("w").alias("w"), F.sum("n").alias("n"), *low, *high)
        merged = merged.withColumn("one", F.col("lo") == F.col("hi")).drop("lo", "hi")
        large = merged.where(F.col("w") > limit).collect()  # fewer than one for every ``limit`` bytes
        hot |= {r["k"]: (r["least"], r["n"]) for r in large if r["one"]}
        more = [r for r in large if not r["one"]]
        if not more:
            return tree, hot
        lengths = [r["d"] + shared_length([r[f"a{j}"] for j in range(WORDS)], [r[f"b{j}"] for j in range(WORDS)]) + STEP for r in more]
        tree = tree.split(np.array([r["k"] for r in more], np.int64).view(np.uint64), np.array(lengths))
    return tree, hot


class Trie:
    """A burst trie of byte strings; terminals are numbered and have a counter and the smallest id."""

    class Branch(dict):
        end: int | None = None

    def __init__(self):
        self.roots: list[dict] = [{}]
        self.count: list[int] = []
        self.least: list[int] = []

    def root_of(self, n: int) -> int:
        """A root of its own for the n-th prefix."""
        while len(self.roots) <= n:
            self.roots.append({})
        return n

    def _terminal(self) -> int:
        self.count.append(0)
        self.least.append(2**63 - 1)
        return len(self.count) - 1

    def add(self, s: bytes, i: int, root: int = 0) -> int:
        """Counts one record; gives the number of its terminal."""
        node, up, d = self.roots[root], None, 0
        while type(node) is Trie.Branch:
            if d == len(s):
                t = node.end
                if t is None:
                    t = node.end = self._terminal()
                break
            up, d = node, d + 1
            node = up.get(s[d - 1])
            if node is None:
                node = up[s[d - 1]] = {}
        else:
            rest = s[d:]
            t = node.get(rest)
            if t is None:
                t = node[rest] = self._terminal()
                if len(node) > BURST:
                    b = Trie.Branch()
                    for k, v in node.items():
                        if k:
                            b.setdefault(k[0], {})[k[1:]] = v
                        else:
                            b.end = v
                    if up is None:
                        self.roots[root] = b
                    else:
                        up[s[d - 1]] = b
        self.count[t] += 1
        if i < self.least[t]:
            self.least[t] = i
        return t


def copies(df: DataFrame, *, key: str = "rec_id", record: str = "record", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``rec_id, keep_id, n``: for each record the smallest id of the records that are the same, and how many there are.

    * a null record says nothing and gives no row; an empty one equals other empty ones; a null key gives no row;
    * rows with equal keys count each; very long records count by their bytes when buckets are cut;
    * an empty table gives no rows; only the two columns are read.
    """
    canon = canonical(df.where(F.col(key).isNotNull() & F.col(record).isNotNull()), key, record)
    seen = Observation()
    canon = written(canon.observe(seen, F.sum(F.length("c") + OVERHEAD).alias("w")), "canonical")
    tree, hot = splits(canon, key, bucket_bytes, seen.get["w"] or 0)
    out = f"`{key}` long, keep_id long, n long"
    hots = np.array(sorted(hot), np.int64)
    least, number = (np.array([hot[k][j] for k in hots.tolist()], np.int64) for j in (0, 1))

    def spread(batches: Iterator[pa.RecordBatch], here: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, d, *_ = tree.walk(b.column(1))
            k = k.view(np.int64)
            at = np.minimum(np.searchsorted(hots, k), max(len(hots) - 1, 0))
            is_hot = hots[at] == k if len(hots) else np.zeros(len(k), bool)
            if here:
                m, at = pa.array(is_hot), at[is_hot]
                yield pa.RecordBatch.from_arrays([b.column(0).filter(m), pa.array(least[at]), pa.array(number[at])], [key, "keep_id", "n"])
            else:
                m = pa.array(~is_hot)
                yield pa.RecordBatch.from_arrays([pa.array(k).filter(m), pa.array(d.astype(np.int32)).filter(m), *(x.filter(m) for x in b.columns)], ["bucket", "d", key, "c"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, tries, trie, ids, at = None, {}, Trie(), [], []

        def result() -> Iterator[pa.RecordBatch]:
            t = np.array(at)
            least, n = np.array(trie.least), np.array(trie.count)
            for a in range(0, len(ids), 1 << 16):
                x = t[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + (1 << 16)], pa.int64()), pa.array(least[x]), pa.array(n[x])], [key, "keep_id", "n"])

        for b in batches:
            for k, d, i, c in zip(*(col.to_pylist() for col in b.columns)):
                if k != bucket:
                    if ids:
                        yield from result()
                    bucket, tries, trie, ids, at = k, {}, Trie(), [], []
                node = tries.get(p := c[:d])  # one prefix but where hashes collide
                if node is None:
                    node = tries[p] = trie.root_of(len(tries))
                ids.append(i)
                at.append(trie.add(c[d:], i, node))
        if ids:
            yield from result()

    rows = canon.mapInArrow(lambda x: spread(x, False), f"bucket long, d int, `{key}` long, c binary")
    rows = rows.repartition(partitions(df.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(count, out)
    return rows.unionAll(canon.mapInArrow(lambda x: spread(x, True), out)) if hot else rows
