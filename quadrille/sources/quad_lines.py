"""Loading quad lines and setting faulty ones apart with the reason.

A good line is ``<s> <p> <o> <t> .`` or ``<s> <p> "literal" <t> .`` with an optional ``@lang`` or
``^^<type>`` directly behind the literal, terms parted by spaces or tabs.

Method.  The lines of a batch are parsed column by column from their bytes: where brackets, quotes and
blanks stand is found once for the whole batch, and every step (subject closed, day exists, ...) is one
operation on all lines, which leaves columns of term positions and a running count of lines that didn't
go through.  Blocks of lines are then taken as a whole, or refused when any of their lines is faulty;
refused blocks are halved again and again, by the running count and without parsing anything twice, so
that good runs stay columns and the faulty lines end up alone.  Only those meet the strict scanner,
which names the reason.

Nothing is shuffled: the parse is one pass over the scan, whatever the size of the input.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IRI = r'<[^ \t<>"]+>'
TAG = rf"@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^{IRI}"
#: One line, as an expression; it serves to take a line apart that the strict scanner finds good.
LINE = (
    r'(?s)^[ \t]*<(?P<s>[^ \t<>"]+)>[ \t]+<(?P<p>[^ \t<>"]+)>[ \t]+'
    rf'(?:<(?P<iri>[^ \t<>"]+)>|"(?P<lit>(?:[^"\\]|\\.)+)"(?:{TAG})?)[ \t]+'
    r"<(?P<t>[0-9]{4}-[0-9]{2}-[0-9]{2})>[ \t]*\.[ \t]*\r?$"
)
BLOCK = 4096

#: Reasons, in the order in which the strict scanner meets them.
REASONS = (
    "missing subject", "empty subject", "subject not in angle brackets", "subject not closed", "character not allowed in subject",
    "missing predicate", "empty predicate", "predicate not in angle brackets", "predicate not closed", "character not allowed in predicate",
    "missing object", "empty object", "object not delimited", "object not closed", "character not allowed in object", "bad language or type tag",
    "missing time", "empty time", "time not in angle brackets", "time not closed", "surplus term", "time is not a day YYYY-MM-DD", "no such day",
    "missing dot", "text after the dot", "terms not parted",
)


def _bytes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of lines, one behind the other, and where each begins (and the last ends)."""
    x = lines.cast(pa.large_string())
    offset = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
    data = np.frombuffer(x.buffers()[2], np.uint8)[offset[0] : offset[-1]] if x.buffers()[2] else np.zeros(0, np.uint8)
    return data, offset - offset[0]


def _gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The texts at these places."""
    offset = np.concatenate([[0], np.cumsum(end - start)])
    at = np.repeat(start - offset[:-1], end - start) + np.arange(offset[-1])
    kind = (pa.string(), np.int32) if offset[-1] < 1 << 31 else (pa.large_string(), np.int64)
    return pa.Array.from_buffers(kind[0], len(start), [None, pa.py_buffer(offset.astype(kind[1])), pa.py_buffer(np.ascontiguousarray(data[at]))])


def _days(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 of rows of ten bytes YYYY-MM-DD, and whether each is an existing day."""
    digit = text[:, [0, 1, 2, 3, 5, 6, 8, 9]].astype(np.int64) - 48
    ok = ((digit >= 0) & (digit <= 9)).all(axis=1) & (text[:, 4] == 45) & (text[:, 7] == 45)
    y, m, d = digit[:, :4] @ [1000, 100, 10, 1], digit[:, 4:6] @ [10, 1], digit[:, 6:] @ [10, 1]
    ok &= (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    first = np.where(ok, (y - 1970) * 12 + m - 1, 0).astype("datetime64[M]")
    ok &= first.astype("datetime64[D]").astype(np.int64) + d <= (first + 1).astype("datetime64[D]").astype(np.int64)
    return first.astype("datetime64[D]").astype(np.int64) + d - 1, ok


class Columns:
    """The lines of a batch taken apart, column by column; ``good`` tells which went through all steps."""

    def __init__(self, lines: pa.Array):
        self.data, offset = data, offset = _bytes(lines)
        size = len(data)
        begin, end = offset[:-1], offset[1:]
        padded = np.append(data, np.zeros(1, np.uint8))
        blank = (data == 32) | (data == 9)
        blanks = np.append(0, np.cumsum(blank, dtype=np.int64))
        after = lambda where, at: np.append(where, [size, size])[np.searchsorted(where, at)]  # the first of some places from here on
        before = lambda where, at: np.append(where, -1)[np.searchsorted(where, at) - 1]  # the last one before
        opens, closes, quotes, full = (np.flatnonzero(x) for x in (data == 60, data == 62, data == 34, ~blank))
        # a quote is part of a literal if an odd number of backslashes stands before it
        free = quotes[self._even(quotes)] if len(quotes) else quotes

        def iri(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Where the bracket that is open here closes, and whether an IRI stands between."""
            close = after(closes, at)
            inner = (after(opens, at + 1) > close) & (after(quotes, at) > close) & (blanks[close] == blanks[np.minimum(at, size)])
            return close, (padded[np.minimum(at, size)] == 60) & (close > at + 1) & inner

        # from the right: dot, day
        last = end - ((end > begin) & (padded[end - 1] == 13))
        dot = before(full, last)
        shut = before(full, np.maximum(dot, 0))
        t = shut - 11  # where the day is opened
        good = (t > begin) & (padded[dot] == 46) & (padded[shut] == 62) & (padded[np.maximum(t, 0)] == 60)
        self.day, exists = _days(padded[np.maximum(t, 0)[:, None] + np.arange(1, 11)]) if size > 11 else (np.zeros(len(begin), np.int64), np.zeros(len(begin), bool))
        good &= exists
        # from the left: subject, predicate
        s = after(full, begin)
        s_end, ok = iri(s)
        good &= ok
        p = after(full, np.minimum(s_end + 1, size))
        good &= p > s_end + 1
        p_end, ok = iri(p)
        good &= ok & (p_end < t)
        # between: the object
        o, o_last = after(full, np.minimum(p_end + 1, size)), before(full, np.maximum(t, 0))
        good &= (o > p_end + 1) & (o <= o_last) & (o_last < t - 1)
        o_end, named = iri(o)
        named &= o_end == o_last
        literal = padded[np.minimum(o, size)] == 34
        quote = after(free, np.minimum(o + 1, size))
        literal &= (quote > o + 1) & (quote <= o_last)
        tagged = np.flatnonzero(good & literal & (quote < o_last))
        if len(tagged):
            tags = _gather(data, quote[tagged] + 1, o_last[tagged] + 1).dictionary_encode()
            fits = np.array([bool(re.fullmatch(TAG, x)) for x in tags.dictionary.to_pylist()])
            literal[tagged] = fits[tags.indices.to_numpy()]
        self.good = good & (named | literal)
        self.terms = (s + 1, s_end), (p + 1, p_end), (o + 1, np.where(literal, quote, o_end))
        self.literal = literal
        self.faults = np.append(0, np.cumsum(~self.good))

    def _even(self, quotes: np.ndarray) -> np.ndarray:
        """Whether an even number of backslashes stands before each of these places."""
        if not (self.data == 92).any():
            return np.ones(len(quotes), bool)
        run = np.zeros(len(quotes), np.int64)
        at = np.arange(len(quotes))
        while len(at):
            back = quotes[at] - 1 - run[at]
            at = at[(back >= 0) & (self.data[np.maximum(back, 0)] == 92)]
            run[at] += 1
        return run % 2 == 0

    def refused(self, a: int, b: int) -> bool:
        """Whether any line of a block is faulty."""
        return bool(self.faults[b] > self.faults[a])

    def of(self, rows: np.ndarray) -> list[pa.Array]:
        """``s, p, o, t`` of good lines."""
        s, p, o = (_gather(self.data, a[rows], b[rows]) for a, b in self.terms)
        return [s, p, unescape(o, self.literal[rows]), pa.array(self.day[rows].astype(np.int32), pa.int32()).cast(pa.date32())]


def isolate(block: Columns, n: int, size: int = BLOCK) -> tuple[list[tuple[int, int]], list[int]]:
    """The blocks that are taken as a whole, and the faulty lines: refused blocks are halved until such a line stands alone."""
    whole, alone = [], []
    todo = [(a, min(a + size, n)) for a in range(0, n, size)][::-1]
    while todo:
        a, b = todo.pop()
        if not block.refused(a, b):
            whole.append((a, b))
        elif b - a == 1:
            alone.append(a)
        else:
            todo += [((a + b) // 2, b), (a, (a + b) // 2)]
    return whole, alone


def unescape(texts: pa.Array, literal: np.ndarray) -> pa.Array:
    """The texts, literals among them without their escapes; only those that hold a backslash are touched one by one."""
    odd = np.flatnonzero(pc.match_substring(texts, "\\").to_numpy(zero_copy_only=False) & literal)
    if not len(odd):
        return texts
    new = pa.array([unescaped(x) for x in texts.take(pa.array(odd)).to_pylist()], texts.type)
    mask = np.zeros(len(texts), bool)
    mask[odd] = True
    return pc.replace_with_mask(texts, pa.array(mask), new)


_PLAIN = {"t": "\t", "n": "\n", "r": "\r"}


def unescaped(text: str) -> str:
    return re.sub(r"(?s)\\(.)", lambda m: _PLAIN.get(m[1], m[1]), text)


_TERM = {"subject": 0, "predicate": 1, "object": 2, "time": 3}


def diagnose(line: str) -> str | None:
    """The first reason why a line isn't a quad, or None if it is one."""
    end = len(line) - 1 if line.endswith("\r") else len(line)
    at, n = 0, 0
    text = line[:end]

    def blanks(i: int) -> int:
        while i < end and text[i] in " \t":
            i += 1
        return i

    for name in _TERM:
        start = at
        at = blanks(at)
        if at >= end or (text[at] == "." and not text[at + 1 :].strip(" \t")):
            return f"missing {name}"
        if n and at == start:
            return "terms not parted"
        if name == "object" and text[at] == '"':
            i = at + 1
            while i < end and text[i] != '"':
                i += 2 if text[i] == "\\" else 1
            if i >= end:
                return "object not closed"
            if i == at + 1:
                return "empty object"
            at = i + 1
            if at < end and text[at] not in " \t":
                m = re.compile(TAG).match(text, at)
                if not m or (m.end() < end and text[m.end()] not in " \t"):
                    return "bad language or type tag"
                at = m.end()
        elif text[at] != "<":
            if name == "time" and text[at] == '"':
                return "surplus term"
            return "object not delimited" if name == "object" else f"{name} not in angle brackets"
        else:
            close = text.find(">", at)
            inner = text[at + 1 : close if close >= 0 else end]
            if close < 0 or "<" in inner:
                return f"{name} not closed"
            if not inner:
                return f"empty {name}"
            if name == "object" and re.fullmatch(r"\d{4}-\d\d-\d\d", inner) and not text[close + 1 :].strip(" \t."):
                return "missing object"
            if name == "time":
                if re.compile(r"[ \t]+[<\"]").match(text, close + 1):
                    return "surplus term"
                if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", inner):
                    return "time is not a day YYYY-MM-DD"
                try:
                    dt.date.fromisoformat(inner)
                except ValueError:
                    return "no such day"
            elif re.search(r'[ \t"]', inner):
                return f"character not allowed in {name}"
            at = close + 1
        n += 1
    at = blanks(at)
    if at >= end or text[at] != ".":
        return "missing dot"
    return "text after the dot" if blanks(at + 1) < end else None


def _parser(line: str, keep: Sequence[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(batch.schema.names.index(line)).cast(pa.string())
            trimmed = pc.ascii_trim(lines, " \t\r\n")
            real = pc.and_kleene(pc.not_equal(trimmed, ""), pc.invert(pc.starts_with(lines, "#")))
            rows = np.flatnonzero(pc.fill_null(real, False).to_numpy(zero_copy_only=False))
            if not len(rows):
                continue
            texts = lines.take(pa.array(rows))
            block = Columns(texts)
            whole, alone = isolate(block, len(rows))
            good = np.concatenate([np.arange(a, b) for a, b in whole]) if whole else np.zeros(0, np.int64)
            if len(good):
                yield made(batch, rows[good], [*block.of(good), pa.nulls(len(good), pa.string())])
            if alone:
                found = [strict(x) for x in texts.take(pa.array(alone)).to_pylist()]
                cols = [pa.array(x, k) for x, k in zip(zip(*found), (pa.string(), pa.string(), pa.string(), pa.date32(), pa.string()))]
                yield made(batch, rows[alone], cols)

    def made(batch: pa.RecordBatch, idx: np.ndarray, cols: list[pa.Array]) -> pa.RecordBatch:
        kept = batch.select(keep).take(pa.array(idx)).columns if keep else []
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*kept, *cols], schema)], schema=schema)

    return run


def strict(line: str) -> tuple[str | None, str | None, str | None, dt.date | None, str | None]:
    """(s, p, o, t, None) of a good line, or nothing and the reason."""
    why = diagnose(line)
    if why is None:
        m = re.fullmatch(LINE, line)
        if m:
            return m["s"], m["p"], m["iri"] or unescaped(m["lit"]), dt.date.fromisoformat(m["t"]), None
    return None, None, None, None, why or "not a quad"


def parse_quads(df: DataFrame, *, line: str = "line", keep: Sequence[str] = ("line_id",)) -> DataFrame:
    """The quads of good lines and the reasons of faulty ones, one row per line that says anything.

    Result: the ``keep`` columns, then ``s, p, o STRING, t DATE, reason STRING``; ``reason`` is null
    exactly for good lines, and then s, p, o, t are set.  Escapes in literals are undone.

    * null lines, blank lines and lines that begin with ``#`` say nothing and give no row;
    * repeated lines each give their row (loading again is not a fault);
    * lines of any length are taken whole; an empty table gives an empty result;
    * other columns are ignored; a kept column named like a result column comes out as ``in_<name>``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    made = T.StructType().add("s", "string").add("p", "string").add("o", "string").add("t", "date").add("reason", "string")
    kept = [T.StructField(f"in_{c}" if c in made.names else c, df.schema[c].dataType) for c in keep]
    out = T.StructType([*kept, *made.fields])
    need = list(dict.fromkeys([*keep, line]))
    return df.select(*need).mapInArrow(_parser(line, list(keep), to_arrow_schema(out)), out)


def faulty(df: DataFrame, **how) -> DataFrame:
    """Only the faulty lines, with their reasons."""
    return parse_quads(df, **how).where(F.col("reason").isNotNull())


def fault_counts(df: DataFrame, *, file: str = "file_name", **how) -> DataFrame:
    """Lines, faulty lines and the most common reasons by file: ``file_name, reason, n``; the reason of good lines is empty."""
    p = parse_quads(df, keep=(file,), **how)
    return p.groupBy(file, F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))
