"""A minimal acyclic transducer from words to token ids, in one memory-mapped file.

The automaton shares prefixes and suffixes of its words: of two states from which the same words can
be completed only one is kept.  An edge carries a number, and the sum of the numbers on the path of a
word is the word's rank among all words in order; the rank leads to its ids.  The file holds plain
arrays, so every process on a machine maps the same pages and nothing is loaded or unpickled.
"""

from __future__ import annotations

import io
import json
from collections.abc import Sequence

import numpy as np

MAGIC = b"MATL0001"


def build(words: Sequence[bytes], ids: Sequence[Sequence[int]]) -> dict[str, np.ndarray]:
    """The arrays of the transducer for distinct, sorted, non-empty words."""
    register: dict[tuple, int] = {}
    final: list[bool] = []
    edges: list[tuple[tuple[int, int], ...]] = []
    count: list[int] = []

    def freeze(node: list) -> int:
        """The state equal to a finished node: an old one if there is one."""
        key = (node[0], tuple(node[1]))
        if (s := register.get(key)) is None:
            s = register[key] = len(final)
            final.append(node[0])
            edges.append(key[1])
            count.append(node[0] + sum(count[t] for _, t in key[1]))
        return s

    path: list[list] = [[False, []]]  # the nodes of the word before, each [final, edges]
    labels: list[int] = []

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            s = freeze(path.pop())
            path[-1][1].append((labels.pop(), s))

    last = b""
    for w in words:
        if w <= last:
            raise ValueError("words must be distinct, sorted and not empty")
        n = 0
        while n < min(len(w), len(last)) and w[n] == last[n]:
            n += 1
        close(n)
        for b in w[n:]:
            labels.append(b)
            path.append([False, []])
        path[-1][0] = True
        last = w
    close(0)
    root = freeze(path[0])
    key, target, out = [], [], []
    for s, es in enumerate(edges):
        rank = int(final[s])
        for b, t in es:
            key.append(s * 256 + b)
            target.append(t)
            out.append(rank)
            rank += count[t]
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = [i for x in ids for i in x]
    return {
        "key": np.array(key, np.int64), "target": np.array(target, np.int32), "out": np.array(out, np.int32),
        "final": np.array(final, bool), "root": np.array([root], np.int64), "longest": np.array([max(map(len, words), default=0)], np.int64),
        "offset": np.concatenate([[0], np.cumsum(n)]).astype(np.int64), "ids": np.array(flat, np.int32),
    }


def dump(arrays: dict[str, np.ndarray]) -> bytes:
    """The arrays as one file: a header, then each array on a border of 64 bytes."""
    head, body, at = {}, io.BytesIO(), 0
    for name, a in arrays.items():
        body.write(b"\0" * (-at % 64))
        at += -at % 64
        head[name] = [str(a.dtype), len(a), at]
        at += body.write(a.tobytes())
    h = json.dumps(head).encode()
    h += b" " * (-(len(MAGIC) + 8 + len(h)) % 64)
    return MAGIC + len(h).to_bytes(8, "little") + h + body.getvalue()


class Lexicon:
    """A transducer mapped from its file."""

    def __init__(self, path: str):
        m = np.memmap(path, np.uint8, "r")
        if bytes(m[:8]) != MAGIC:
            raise ValueError(f"not a lexicon: {path}")
        n = int.from_bytes(bytes(m[8:16]), "little")
        self.a = {}
        for name, (kind, length, at) in json.loads(bytes(m[16 : 16 + n])).items():
            kind = np.dtype(kind)
            self.a[name] = m[16 + n + at : 16 + n + at + length * kind.itemsize].view(kind)
        self.offset, self.ids = self.a["offset"], self.a["ids"]

    def ranks(self, data: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """The rank of each word (bytes ``data[offset[i]:offset[i+1]]``), -1 for unknown ones; all words take each step together."""
        key, target, out, final = (self.a[x] for x in ("key", "target", "out", "final"))
        n = np.diff(offset)
        rank = np.full(len(n), -1, np.int64)
        if not len(key):
            return rank
        at = np.flatnonzero((n > 0) & (n <= self.a["longest"][0]))
        state, total = np.full(len(at), self.a["root"][0]), np.zeros(len(at), np.int64)
        start, left = offset[at], n[at]
        step = 0
        while len(at):
            k = state * 256 + data[start + step]
            i = np.minimum(np.searchsorted(key, k), len(key) - 1)
            ok = key[i] == k
            at, start, left, total, i = at[ok], start[ok], left[ok], total[ok], i[ok]
            state = target[i].astype(np.int64)
            total = total + out[i]
            step += 1
            done = left == step
            fits = done & final[state]
            rank[at[fits]] = total[fits]
            at, start, left, total, state = at[~done], start[~done], left[~done], total[~done], state[~done]
        return rank
