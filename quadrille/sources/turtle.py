"""Turtle files: prefixes and base, ``a``, ``;`` and ``,`` lists, blank nodes, literals of all forms."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quadrille.plans.sparql import RDF_TYPE, ParseError, unquote

_TOKEN = re.compile(
    r"""(?P<skip>(?:\s|\#[^\n]*)+)
      | (?P<iri><[^<>\s]*>)
      | (?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
      | (?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
      | (?P<directive>@prefix\b|@base\b|(?i:prefix|base)(?=\s))
      | (?P<lang>@[A-Za-z]+(?:-\w+)*)
      | (?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
      | (?P<blank>_:\w+)
      | (?P<pname>(?:[A-Za-z_][\w.-]*)?:[\w.%-]*)
      | (?P<word>true\b|false\b|a\b)
      | (?P<op>\^\^|[.;,\[\]()])""",
    re.X | re.S,
)
_LIST = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def triples(text: str, scope: str = "") -> Iterator[tuple[str, str, str]]:
    """The triples of a document; terms without brackets or quotes, language tags and types dropped. Names of blank nodes get the ``scope`` before them."""
    toks, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at : at + 20]!r}")
        kind, word, at = m.lastgroup, m[0], m.end()
        if kind in ("pname", "number") and word.endswith(".") and word != ".":
            cut = len(word.rstrip("."))
            at, word = at - (len(word) - cut), word[:cut]
        if kind != "skip":
            toks.append((kind, word))
    toks.append(("end", ""))
    prefixes: dict[str, str] = {}
    base, i, fresh = "", 0, 0
    out: list[tuple[str, str, str]] = []

    def take() -> tuple[str, str]:
        nonlocal i
        i += 1
        return toks[i - 1]

    def new() -> str:
        nonlocal fresh
        fresh += 1
        return f"_:{scope}g{fresh}"

    def iri(word: str) -> str:
        x = word[1:-1]
        return x if re.match(r"[A-Za-z][\w+.-]*:", x) else base + x

    def term() -> str:
        kind, word = take()
        if kind == "iri":
            return iri(word)
        if kind == "pname":
            name, local = word.split(":", 1)
            if name not in prefixes:
                raise ParseError(f"unknown prefix {name}:")
            return prefixes[name] + local
        if kind in ("string", "long"):
            value = unquote(word if kind == "string" else word[2:-2])
            if toks[i][0] == "lang":
                take()
            elif toks[i] == ("op", "^^"):
                take()
                term()
            return value
        if kind == "blank":
            return f"_:{scope}{word[2:]}"
        if kind == "number" or word in ("true", "false"):
            return word
        if word == "[":
            node = new()
            if toks[i] != ("op", "]"):
                predicates(node)
            close("]")
            return node
        if word == "(":
            items = []
            while toks[i] != ("op", ")"):
                items.append(term())
            take()
            head = _LIST + "nil"
            for x in reversed(items):
                node = new()
                out.extend([(node, _LIST + "first", x), (node, _LIST + "rest", head)])
                head = node
            return head
        raise ParseError(f"a term was expected, not {word!r}")

    def close(word: str) -> None:
        if take()[1] != word:
            raise ParseError(f"{word} expected")

    def predicates(s: str) -> None:
        while True:
            if toks[i] == ("word", "a"):
                take()
                p = RDF_TYPE
            else:
                p = term()
            while True:
                out.append((s, p, term()))
                if toks[i] != ("op", ","):
                    break
                take()
            while toks[i] == ("op", ";"):
                take()
            if toks[i - 1] != ("op", ";") or toks[i] in (("op", "."), ("op", "]")):
                return

    while toks[i][0] != "end":
        if toks[i][0] == "directive":
            word = take()[1]
            if word.lower().endswith("prefix"):
                kind, name = take()
                if kind != "pname":
                    raise ParseError("a prefix needs a name")
                prefixes[name[:-1]] = iri(take()[1])
            else:
                base = iri(take()[1])
            if word.startswith("@"):
                close(".")
            continue
        bracket = toks[i] == ("op", "[")
        s = term()
        if not (bracket and toks[i] == ("op", ".")):
            predicates(s)
        close(".")
    return iter(out)


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """``file_name, s, p, o, error``: the triples of Turtle files; a file that isn't Turtle gives one row with the error.

    A prefix or a blank node may be used anywhere behind its place, so a file is one task's work and has
    to fit into its memory: large graphs come as many files, or as quad or triple lines, which are cut
    anywhere. Blank nodes of different files are different nodes; their names begin with a hash of the file's.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, text in zip(b["file_name"], b["value"]):
                try:
                    yield pd.DataFrame([(name, *x, None) for x in triples(text, hashlib.blake2s(name.encode(), digest_size=8).hexdigest() + "_")], columns=["file_name", "s", "p", "o", "error"], dtype=object)
                except ParseError as e:
                    yield pd.DataFrame([(name, None, None, None, str(e))], columns=["file_name", "s", "p", "o", "error"], dtype=object)

    files = spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path AS file_name", "value")
    return files.mapInPandas(parse, "file_name string, s string, p string, o string, error string")
