"""Token ids of whole texts under a public byte-level BPE vocabulary.

The vocabulary splits a text into words by a fixed pattern and merges the bytes of each word on its
own, so equal words always have equal ids.  Hence:

1. All texts are split and their words counted (one aggregation, combined in each task).
2. The most frequent words are merged once, on the driver, and compiled into a minimal acyclic
   transducer (``lexicon``), a bounded file of some megabytes in the cluster's shared folder, which
   every worker maps into memory.
3. Texts are split again and each distinct word of a chunk is looked up; all words walk through the
   automaton together.  Words it doesn't know are merged exactly by the vocabulary's ranks.  The
   lexicon only saves time: ids are the same for any lexicon, the empty one too.

Splitting is vectorised over the code points of a chunk of texts: a token starts where the class of
characters changes, with the pattern's rules for one leading space, runs of blanks and contractions.
The pass is map-only, with no shuffle, and its memory is bounded by a chunk and the longest text.
"""

from __future__ import annotations

import base64
import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.shared import shared_dir, written
from quadrille.llm import lexicon as lex

VOCABULARY = os.environ.get("QUADRILLE_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
WORDS = 50_000
LONGEST = 48
CHUNK = 4 << 20
#: The pattern of the vocabulary (fixed values); ``split`` follows it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER, LETTER, NUMBER, BLANK = range(4)


@lru_cache(2)
def merger(path: str):
    """Exact merges of one word's bytes, by the vocabulary file at this path, or where there is none, by the one ``ship`` has sent."""
    import tiktoken

    if not os.path.exists(path):  # on another machine: the copy that was sent along
        from pyspark import SparkFiles

        path = SparkFiles.get(os.path.basename(path))
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    one = {k: [v] for k, v in ranks.items()}
    core = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def merge(word: bytes) -> list[int]:
        return one.get(word) or core.encode_single_piece(word)

    return merge


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pat in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pat, chars):
            a, b = ord(m[0][0]), ord(m[0][-1])
            table[a : b + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


def split(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of texts that stand one behind the other in ``data`` and end at the bytes ``ends``.

    Gives the byte offsets of all tokens (one more than tokens) and the number of tokens up to each text's end.
    """
    cp = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(cp)
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(ends), np.int64)
    width = 1 + (cp > 0x7F) + (cp > 0x7FF).astype(np.int64) + (cp > 0xFFFF)
    byte = np.concatenate([[0], np.cumsum(width)])
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[np.searchsorted(byte, ends)] = True
    edge[0] = edge[n] = True
    c = classes()[cp]
    run = edge.copy()
    run[1:n] |= c[1:] != c[:-1]
    at = np.flatnonzero(run)
    a, b = at[:-1], at[1:]  # runs of one class, within a text
    blank = c[a] == BLANK
    start = run.copy()
    inner = blank & ~edge[b]  # blanks before something
    start[b[inner] - 1] = True
    joined = b[inner][cp[b[inner] - 1] == 32]  # a space joins what follows it
    start[joined] = False
    # contractions: an apostrophe by itself, at the start of a token, before certain letters
    q = a[(cp[a] == 39) & (b - a == 1) & start[a] & ~edge[b]]
    q = q[c[q + 1] == LETTER]
    if len(q):
        one = cp[q + 1]
        two = np.where((q + 2 < n) & ~edge[np.minimum(q + 2, n)], cp[np.minimum(q + 2, n - 1)], 0)
        k = np.where(np.isin(one, [ord(x) for x in "stmd"]), 1, 0)
        pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        k = np.where(pair, 2, k)
        q, k = q[k > 0], k[k > 0]
        start[q + 1] = False
        start[q + 1 + k] = True
    start[n] = True
    tokens = np.flatnonzero(start)
    return byte[tokens], np.searchsorted(byte[tokens], ends)


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(from, to, bytes, ends) of runs of texts of some megabytes, null as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offset = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offset, offset[a] + CHUNK, "right")) - 1)
        yield a, b, (bytes(data.slice(offset[a], offset[b] - offset[a])) if data else b""), offset[a + 1 : b + 1] - offset[a]
        a = b


def words(data: bytes, ends: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The tokens' words as a dictionary array, and the number of tokens up to each text's end."""
    offset, upto = split(data, ends)
    col = pa.Array.from_buffers(pa.binary(), len(offset) - 1, [None, pa.py_buffer(offset.astype(np.int32)), pa.py_buffer(data)])
    return col.dictionary_encode(), upto


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``word BINARY, n BIGINT`` of all texts; words beyond ``LONGEST`` bytes aren't counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for _, _, data, ends in chunks(batch.column(0)):
                w, _ = words(data, ends)
                if len(w):
                    n = np.bincount(w.indices.to_numpy(), minlength=len(w.dictionary))
                    for k, v in zip(w.dictionary.to_pylist(), n.tolist()):
                        total[k] += v
        keep = [k for k in total if len(k) <= LONGEST]
        for a in range(0, len(keep), 1 << 14):
            part = keep[a : a + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([total[k] for k in part], pa.int64())], ["word", "n"])

    return df.select(text).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def publish(spark: SparkSession, content: bytes) -> str:
    """Puts a file into the cluster's shared folder. Gives its path, with a scheme unless workers can map it there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(shared_dir(spark, "lexicon"))
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path = fs.makeQualified(p).toString()
    if path.startswith("file:"):
        local = path.removeprefix("file:").replace("//", "/")
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local + ".part", "wb") as f:
            f.write(content)
        os.rename(local + ".part", local)
        return local
    out = fs.create(p)
    out.write(content)
    out.close()
    spark.sparkContext.addFile(path)  # every executor, late ones too, fetches a copy to map
    return path


def ship(spark: SparkSession, vocabulary: str) -> None:
    """Sends the driver's vocabulary file (a megabyte or so) to all executors, late ones too."""
    if os.path.exists(vocabulary):
        spark.sparkContext.addFile(vocabulary)


@lru_cache(4)
def mapped(path: str) -> lex.Lexicon:
    if "://" in path:
        from pyspark import SparkFiles

        path = SparkFiles.get(os.path.basename(path))
    return lex.Lexicon(path)


def frequent_words(counts: DataFrame, size: int) -> list[bytes]:
    """The most frequent words, ``size`` at most: all above a count, found from a histogram of a few hundred rows."""
    step = F.floor(F.log2("n") * 16).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("k")).orderBy(F.desc("step")).collect()
    taken, least = 0, None
    for r in steps:
        taken += r["k"]
        if taken > size:
            break
        least = r["step"]
    if least is None:
        return []
    return [bytes(x) for x in counts.where(step >= least).select("word").toArrow()["word"].to_pylist()]


def compile_lexicon(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, size: int = WORDS) -> str:
    """Counts the words of all texts and publishes the transducer of the most frequent ones, ``size`` at most."""
    ship(df.sparkSession, vocabulary)
    merge = merger(vocabulary)
    ws = sorted(frequent_words(written(word_counts(df, text), "words"), size))
    return publish(df.sparkSession, lex.dump(lex.build(ws, [merge(w) for w in ws])))


class Encoder:
    """Encodes chunks of texts in a worker."""

    def __init__(self, path: str, vocabulary: str):
        self.lexicon, self.merge = mapped(path), merger(vocabulary)

    def table(self, dictionary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each word begin, how many there are, and all ids."""
        offset = np.frombuffer(dictionary.buffers()[1], np.int32)[dictionary.offset : dictionary.offset + len(dictionary) + 1].astype(np.int64)
        data = np.frombuffer(dictionary.buffers()[2], np.uint8)
        rank = self.lexicon.ranks(data, offset)
        start = self.lexicon.offset[np.maximum(rank, 0)]
        n = self.lexicon.offset[np.maximum(rank, 0) + 1] - start if len(self.lexicon.offset) > 1 else np.zeros(len(rank), np.int64)
        start, n, ids = start.copy(), n.copy(), self.lexicon.ids
        unknown = np.flatnonzero(rank < 0)
        if len(unknown):
            new = [self.merge(bytes(data[offset[i] : offset[i + 1]])) for i in unknown]
            k = np.fromiter(map(len, new), np.int64, len(new))
            start[unknown] = len(ids) + np.cumsum(k) - k
            n[unknown] = k
            ids = np.concatenate([ids, np.fromiter((i for x in new for i in x), np.int32, int(k.sum()))])
        return start, n, ids

    def counts(self, data: bytes, ends: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        w, upto = words(data, ends)
        if not len(w):
            return np.zeros(len(ends), np.int64)
        _, n, _ = self.table(w.dictionary)
        total = np.concatenate([[0], np.cumsum(n[w.indices.to_numpy()])])
        return np.diff(np.concatenate([[0], total[upto]]))

    def ids(self, data: bytes, ends: np.ndarray) -> pa.Array:
        """The ids of each text, as lists."""
        w, upto = words(data, ends)
        if not len(w):
            return pa.array([[]] * len(ends), pa.list_(pa.int32()))
        start, n, ids = self.table(w.dictionary)
        code = w.indices.to_numpy()
        k = n[code]
        total = np.concatenate([[0], np.cumsum(k)])
        flat = ids[np.repeat(start[code] - total[:-1], k) + np.arange(total[-1])]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], total[upto]]).astype(np.int32)), pa.array(flat, pa.int32()))


def encode(df: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, lexicon: str | None = None) -> DataFrame:
    """``<key>, ids ARRAY<INT>``: the token ids of every row's text, special tokens' strings taken as ordinary text.

    * null and empty texts have the empty list; blank texts have the ids of their blanks;
    * one row comes out for each that goes in, in no order; keys may be null or repeated;
    * texts are taken whole, whatever their length; an empty table gives no rows;
    * other columns aren't read.
    """
    ship(df.sparkSession, vocabulary)
    path = lexicon or compile_lexicon(df, text, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path, vocabulary)
        for batch in batches:
            for a, b, data, ends in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), enc.ids(data, ends)], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(df: DataFrame, *, key: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``<key>, bytes``: the bytes that lists of token ids stand for; null for a null list."""
    ship(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = pieces(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else b"".join([word[i] for i in x]) for x in b.column(1).to_pylist()], pa.binary())], [key, "bytes"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, bytes binary")


@lru_cache(2)
def pieces(path: str) -> dict[int, bytes]:
    """The bytes of every id."""
    if not os.path.exists(path):
        from pyspark import SparkFiles

        path = SparkFiles.get(os.path.basename(path))
    with open(path, "rb") as f:
        return {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
