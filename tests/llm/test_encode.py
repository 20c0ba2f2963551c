"""Token ids against the public library; the transducer against a dictionary."""

import base64
import random
from functools import lru_cache

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.llm import encode as E
from quadrille.llm import lexicon as lex


@lru_cache
def library():
    with open(E.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("x", pat_str=E.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_of_the_corpus(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in d.select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in E.encode(d).collect()}
    assert got.keys() == texts.keys()
    assert all(got[k] == library().encode_ordinary(t or "") for k, t in texts.items())


def test_null_empty_long_and_repeated(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "\n\n \t"), (5, "a" * 300_000), (6, "<|endoftext|>"), (6, "<|endoftext|>"), (None, "x")]
    d = spark.createDataFrame([(*r, [7]) for r in rows], "doc_id long, text string, ids array<int>")
    got = sorted(((r.doc_id, r.ids) for r in E.encode(d).collect()), key=str)
    assert got == sorted(((k, library().encode_ordinary(t or "")) for k, t in rows), key=str)
    assert E.encode(d.limit(0)).collect() == []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("'sStTrevlmd  \n\t 　é中1²!😀́_"), st.characters(exclude_categories=["Cs"])), max_size=24), max_size=5))
def test_split_is_the_pattern(texts):
    import numpy as np
    import regex

    data = "".join(texts).encode()
    ends = np.cumsum([len(t.encode()) for t in texts]).astype(np.int64)
    offset, upto = E.split(data, ends)
    got = [data[a:b].decode() for a, b in zip(offset, offset[1:])]
    want = [regex.findall(E.PATTERN, t) for t in texts]
    assert got == [w for ws in want for w in ws]
    assert list(upto) == list(np.cumsum([len(w) for w in want]))


@pytest.mark.parametrize("alphabet,n", [("ab", 300), ("abcdefgh", 3000), ("é中a", 500)])
def test_transducer(tmp_path, alphabet, n):
    import numpy as np

    rng = random.Random(n)
    words = sorted({"".join(rng.choices(alphabet, k=rng.randint(1, 9))).encode() for _ in range(n)})
    arrays = lex.build(words, [[i, i + 1][: 1 + i % 2] for i in range(len(words))])
    (tmp_path / "l").write_bytes(lex.dump(arrays))
    m = lex.Lexicon(str(tmp_path / "l"))
    asked = words + [w + b"a" for w in words] + [w[:-1] for w in words] + [b"", b"zz"]
    data = np.frombuffer(b"".join(asked), np.uint8)
    offset = np.concatenate([[0], np.cumsum([len(w) for w in asked])])
    want = {w: i for i, w in enumerate(words)}
    assert list(m.ranks(data, offset)) == [want.get(w, -1) for w in asked]
    # minimal: no two states can be completed by the same words
    ends: dict = {}

    def rest(prefix):
        return frozenset(w[len(prefix) :] for w in words if w.startswith(prefix))

    for w in words:
        for k in range(len(w) + 1):
            ends[rest(w[:k])] = True
    assert len(arrays["final"]) == len(ends)


def test_empty_lexicon_gives_the_same(tmp_path, spark):
    (tmp_path / "l").write_bytes(lex.dump(lex.build([], [])))
    d = spark.createDataFrame([(1, "The cat’s 3 hats aren't here."), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in E.encode(d, lexicon=str(tmp_path / "l")).collect()}
    assert got == {1: library().encode_ordinary("The cat’s 3 hats aren't here."), 2: []}


def test_frequent_words_are_bounded(spark):
    d = spark.createDataFrame([(bytes([65 + i]), 2**i) for i in range(20)], "word binary, n long")
    assert sorted(E.frequent_words(d, 5)) == [bytes([65 + i]) for i in range(15, 20)]
    assert len(E.frequent_words(d, 100)) == 20 and E.frequent_words(d, 0) == []
    assert E.frequent_words(d.limit(0), 5) == []


def test_lexicon_outside_the_file_system_is_fetched(spark, tmp_path):
    """Workers map the copy that the cluster fetched for them."""
    words = sorted([b"The", b" cat"])
    (tmp_path / "lexicon-far").write_bytes(lex.dump(lex.build(words, [E.merger(E.VOCABULARY)(w) for w in words])))
    spark.sparkContext.addFile(str(tmp_path / "lexicon-far"))
    d = spark.createDataFrame([(1, "The cat sat")], "doc_id long, text string")
    assert E.encode(d, lexicon="far://folder/lexicon-far").first().ids == library().encode_ordinary("The cat sat")
