"""Texts that were cut off, by a length limit or in transfer, and how often each source cuts.

Method.  For each source the lengths of all its texts are counted, in characters and in bytes.  A
length is a spike when more texts have it than the lengths around it make likely: texts pile up where
a field ended, most of all at a source's maximum.  A text at a spike without terminal punctuation was
cut (``by`` is ``spike``).  All of this is built-in expressions over all rows.

Cuts in transfer have no common length, so spikes can't show them.  As a second way, under its own name
(``by`` is ``ending``), texts at other lengths are judged by what they end with.  Lines before the last
one of a text were never cut; they show how complete lines of this corpus end.  A naive Bayes model of
word and shape features counts all of them, in all texts of any length: lines without terminal
punctuation are furniture (menus, lists, headings, notices, footers, tables, code); each line of running
text (of more than 20 characters) is cut at two places, drawn by the text's own hash, to show what cuts look
like.  No text is left out, and the counts don't depend on how rows are spread or ordered.  Features seen
once have no weight.

Scale.  One aggregation to (source, measure, length) with fixed-width state and map-side combine, one
window over the distinct lengths of a source, and a map-only pass over the texts, joined to the spikes
by length.  Only last lines that built-in expressions can't settle are looked at in Python.  The model
is a table, counted in tasks (``HELD`` different pieces at once) and summed by feature; it grows with
the corpus's words and pairs of words, so it is neither collected nor sent to all tasks: different endings
are taken apart into features and joined to it.  Only its totals, two rows, reach the driver.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.functions.shared import written

SEED = 7
#: Words belong before an ellipsis if found there twice, and once in so many texts (a number for all sizes would make all words such in a large corpus).
NATURAL = 2000
#: Different pieces of text, and characters, that a task takes before it counts their features.
HELD, HELD_CHARS = 50_000, 1 << 22
NEAR, AROUND = 16, 256
#: How likely it may be that any length of a source is taken for a spike by chance.
CHANCE = 0.01
#: Log-odds that an ending must exceed to count as running text: anywhere, with an ellipsis behind it.
ANYWHERE, MARKED = 1.5, -1.0
#: Characters at the end of a last line that the built-in test of punctuation looks at; what consists of marks to that extent is left to Python.
TAIL = 1024

BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\xa0            ​    ⁠　﻿"
_CLOSE = r"[\"”»“’'\)\]）」』›]"
_STOP = re.compile(rf"(?:[。！？]{_CLOSE}*|(?<![.!?…])[.!?…]++(?:{_CLOSE}|\s[»)])*(?=\s|$))")
#: A whole sentence ends so; marks may follow a cut (patterns in the common subset of Python, Java and RE2).
ENDS = rf"[.!?…。！？](?:{_CLOSE}|\s[»)])*$"
MARKS = r"(?:\s*(?:\.{3,}|…+|[\[(<]\s*(?:\.{3,}|…+)\s*[\])>]|�|[\[(<{]))+$"
HALF = r"(?:^|[^.])\.\.$"  # in the middle of an ellipsis
_ENDS, _MARKS, _HALF = re.compile(ENDS), re.compile(MARKS), re.compile(HALF)
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿]|(?:[^\W\d_぀-ヿ㐀-鿿]|�)+|\d+|[^\w\s]|_+")
_DOTS = re.compile(r"(?<!\S)(\S+\s+\S+)\s?(?:\.{3}|…)(?=\s|$)")
_LATIN, _CONTROL = re.compile("[\xc2-\xf4]"), re.compile("[\x80-\x9f]")
#: How features of the model are weighed: whole numbers of this part, so that a sum doesn't depend on its order.
UNIT = 1 << 32
CUT, WHOLE, DOTS = 0, 1, 2
_WIDE = {bytes([b]).decode("cp1252"): b for b in range(128, 160) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_BYTE = str.maketrans({**{c: chr(b) for c, b in _WIDE.items()}, "�": "\xff"})
_BYTES = frozenset([*map(chr, range(256)), *_WIDE, "�"])


def repaired(line: str) -> str:
    """UTF-8 that was read as a one-byte charset, read right; other lines as they are."""
    if not _LATIN.search(line):
        return line
    try:
        raw = line.encode("latin-1")
    except UnicodeEncodeError:
        if not _BYTES.issuperset(line):
            return line
        raw = line.translate(_BYTE).encode("latin-1")
    text = raw.decode("utf-8", "replace")
    lost = text.count("�") - 2 * line.count("�")  # one may be cut at the end
    return text if lost <= 1 and any(c > "\x7f" and c != "�" for c in text) else line


_C1 = {b: bytes([b]).decode("cp1252", "ignore") or " " for b in range(128, 160)}


def plain(line: str) -> str:
    """A line without damage that hides its words: wrong charset, parted accents, invisible characters."""
    if not line.isascii():
        line = repaired(line)
        line = unicodedata.normalize("NFC", line.translate(_C1) if _CONTROL.search(line) else line)
        if hidden := [c for c in set(line) if unicodedata.category(c) == "Cf"]:
            line = line.translate(dict.fromkeys(map(ord, hidden)))
    return line.rstrip(BLANKS)


def shape(token: str) -> str:
    token = token.strip("\ufffd") or "a"
    if token[0].isdigit():
        return "0"
    if not token[0].isalpha():
        return token[0]
    if "぀" <= token[0] <= "鿿":
        return "c"
    mixed = len(token) > 2 and any(a.islower() and b.isupper() for a, b in zip(token, token[1:]))
    return "aA" if mixed else ("A" if token[0].isupper() else "a") + ("+" if len(token) > 16 else "")


def fragment(line: str) -> tuple[str, bool]:
    """What follows the last end of a sentence in a line, and whether there was one."""
    end = 0
    for m in _STOP.finditer(line):
        end = m.end()
    return line[end:].strip(BLANKS), end > 0


def features(part: str, follows: bool) -> list[str]:
    ts = _TOKEN.findall(part)
    out = [f"n{min(len(ts), 12)}", f"f{follows}", f"nf{min(len(ts), 3)}{follows}"]
    if not ts:
        return out
    before, form = "^", "^"
    for t in ts[:-1]:
        s = shape(t)
        w = t if s not in ("0", "c") or s == "c" else "0"
        out += ["w" + w, f"b{before}|{w}", f"s{form}|{s}"]
        before, form = w, s
    s = shape(ts[-1])
    out += [f"l{s}", f"sl{form}|{s}", f"bl{before}|{s}", "z" + ("0" if s == "0" else ts[-1]), f"zb{before}|{'0' if s == '0' else ts[-1]}"]
    return out


def tail(words: str) -> str:
    return " ".join(_TOKEN.findall(words)[-2:])


def ending(line: str) -> tuple[str, bool, str] | None:
    """What stands before the marks at the end of a line, whether these have dots, and the words before them (empty without marks); None if the line is complete: a whole sentence, numbers or signs only."""
    line = plain(line)
    core = _MARKS.sub("", line).rstrip(BLANKS)
    marks = line[len(core) :]
    if _HALF.search(line):
        core, marks = line[:-2], ".."
    if _ENDS.search(core) or not any(map(str.isalpha, core)):
        return None
    return core, "." in marks or "…" in marks, tail(core) if marks else ""


def pieces(text: str, seed: int = SEED) -> Iterator[tuple[int, str, bool]]:
    """What the lines before a text's last one show: words before an ellipsis within a line (``DOTS``), and what follows the last end of a sentence, in complete lines without terminal punctuation (``WHOLE``) and in running text cut at random places (``CUT``)."""
    yield DOTS, "", False  # counts texts
    lines = [x for x in (plain(x).strip(BLANKS) for x in text.rstrip(BLANKS).split("\n")) if x]
    rng = random.Random(zlib.crc32(text.encode(), seed))
    for line in lines[:-1]:
        if "..." in line or "…" in line:
            for m in _DOTS.finditer(line):
                yield DOTS, tail(m[1]), False
        if not _ENDS.search(line):
            if any(map(str.isalnum, line)):
                yield WHOLE, *fragment(line)
        elif len(line) > 20:
            for _ in range(2):
                part, follows = fragment(line[: rng.randint(1, len(line) - 1)].rstrip(BLANKS))
                if part:
                    yield CUT, part, follows


def counted(seen: Counter) -> tuple[Counter, Counter]:
    """How many pieces have each feature, of those cut and of those whole; under "" all of them, under "…" and words how often these stand before an ellipsis, under "…" alone all texts."""
    both = Counter(), Counter()
    for (kind, part, follows), n in seen.items():
        if kind == DOTS:
            both[CUT]["…" + part] += n
            continue
        of = both[kind]
        of[""] += n
        if n == 1:
            of.update(set(features(part, follows)))
        else:
            for f in set(features(part, follows)):
                of[f] += n
    return both


class Model:
    """How running text that stops differs from complete lines without terminal punctuation: the model of ``evidence`` on one machine, for texts that are at hand."""

    def __init__(self, texts: Iterable[str], seed: int = SEED):
        cut, whole = counted(Counter(x for text in texts for x in pieces(text, seed)))
        a, b = max(cut.pop("", 0), 1) + 1, max(whole.pop("", 0), 1) + 1
        both = {k for k in cut.keys() | whole.keys() if cut[k] + whole[k] > 1}
        least = max(2, cut["…"] / NATURAL)
        self.natural = frozenset(k[1:] for k in both if k[0] == "…" and k != "…" and cut[k] >= least)
        self.weight = {k: round((math.log((cut[k] + 0.5) / a) - math.log((whole[k] + 0.5) / b)) * UNIT) for k in both if k[0] != "…"}

    def score(self, part: str, follows: bool) -> float:
        return sum(self.weight.get(f, 0) for f in set(features(part, follows))) / UNIT

    def stops(self, line: str) -> tuple[str, bool] | None:
        """As ``ending``, where an ellipsis that belongs there completes a line, damaged or not."""
        got = ending(line)
        return None if got is None or got[2] in self.natural else got[:2]

    def is_cut(self, line: str) -> bool:
        """Whether a text of any length that ends with this line was cut off."""
        got = self.stops(line)
        if got is None:
            return False
        part, follows = fragment(got[0])
        if not any(c.isalnum() for c in part) and not follows:
            return False
        return self.score(part, follows) > (MARKED if got[1] else ANYWHERE)


def spikes(df: DataFrame, *, source: str = "source", text: str = "text") -> DataFrame:
    """``source, measure, length, n, longer``: lengths (``chars`` or ``bytes``) at which the texts of a source pile up, and how many of its texts are longer.

    The different texts of a length (counted in 64 cells by their hash, so copies of one page are no
    pile) are compared with the mean of the lengths up to ``AROUND`` away on the side that has more,
    not counting those up to ``NEAR`` away (limits are smeared when a cut is moved to a word or trimmed).
    A length is a spike if so many would come by chance (Poisson, Chernoff's bound) with a probability
    below ``CHANCE`` over all lengths of the source and measure. No length is left out. At a source's
    maximum ``longer`` is 0 or nearly so.
    """
    cell = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.conv(F.substring(F.md5(F.col(text)), 1, 2), 16, 10).cast("int"), F.lit(64)))
    both = F.explode(F.array(F.struct(F.lit("chars").alias("measure"), F.char_length(text).alias("length")), F.struct(F.lit("bytes").alias("measure"), F.octet_length(text).alias("length"))))
    h = df.where(F.col(text).isNotNull()).select(F.col(source).alias("source"), cell.alias("cell"), both.alias("x")).select("source", "cell", "x.*").where("length > 0")
    h = h.groupBy("source", "measure", "length").agg(F.count("*").alias("n"), F.bit_count(F.bit_or("cell")).alias("cells"))
    # linear counting; all cells full says nothing against n
    d = F.when(F.col("cells") < 64, F.least(F.col("n"), F.greatest(F.col("cells"), F.round(-64 * F.log(1 - F.col("cells") / 64))))).otherwise(F.col("n")).cast("double")
    w = Window.partitionBy("source", "measure").orderBy("length")
    side = lambda a, b: F.coalesce(F.sum("d").over(w.rangeBetween(a, b)), F.lit(0.0)) + 1
    below = side(-AROUND, -NEAR - 1) / F.greatest(F.lit(1), F.least(F.lit(AROUND), F.col("length") - 1) - NEAR)
    above = side(NEAR + 1, AROUND) / (AROUND - NEAR)
    whole = Window.partitionBy("source", "measure")
    h = h.withColumn("d", d).withColumn("usual", F.greatest(F.when(F.col("length") > NEAR + 1, below).otherwise(F.lit(0.0)), above)).withColumn("tried", F.count("*").over(whole))
    h = h.withColumn("longer", F.sum("n").over(whole) - F.sum("n").over(w))
    odds = F.col("d") * F.log(F.col("d") / F.col("usual")) - F.col("d") + F.col("usual")
    return h.where((F.col("d") > F.col("usual")) & (odds >= F.log(F.col("tried") / CHANCE))).select("source", "measure", "length", "n", "longer")


def evidence(df: DataFrame, *, text: str = "text") -> DataFrame:
    """``item, cut, whole``: how many pieces of all texts have each feature; "" and "…" as in ``counted``. What was seen only once says nothing and isn't kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        chars = 0
        for b in batches:
            for t in b.column(0):
                text = t.as_py()
                seen.update(pieces(text))
                chars += len(text)
                if len(seen) >= HELD or chars >= HELD_CHARS:
                    yield rows(seen)
                    seen.clear()
                    chars = 0
        yield rows(seen)

    def rows(seen: Counter) -> pa.RecordBatch:
        cut, whole = counted(seen)
        items = list(cut.keys() | whole.keys())
        return pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array([cut[x] for x in items], pa.int64()), pa.array([whole[x] for x in items], pa.int64())], ["item", "cut", "whole"])

    e = df.select(F.col(text).alias("text")).where(F.char_length("text") > 0).mapInArrow(run, "item string, cut long, whole long")
    return e.groupBy("item").agg(F.sum("cut").alias("cut"), F.sum("whole").alias("whole")).where((F.col("cut") + F.col("whole") > 1) | F.col("item").isin("", "…"))


def weighed(df: DataFrame, *, text: str = "text") -> DataFrame:
    """``item, weight, natural`` of the model of all texts: log-odds in ``UNIT``s, and whether the item is words that an ellipsis belongs to."""
    e = written(evidence(df, text=text), "endings")
    total = {r.item: (r.cut, r.whole) for r in e.where(F.col("item").isin("", "…")).collect()}  # two rows
    a, b = (max(n, 1) + 1 for n in total.get("", (0, 0)))
    least = max(2, total.get("…", (0, 0))[0] / NATURAL)
    weight = F.log((F.col("cut") + 0.5) / a) - F.log((F.col("whole") + 0.5) / b)
    natural = F.startswith("item", F.lit("…"))
    known = F.when(natural, (F.col("item") != "…") & (F.col("cut") >= least)).otherwise(F.col("item") != "")
    return e.where(known).select("item", F.when(natural, 0).otherwise(F.round(weight * UNIT)).cast("long").alias("weight"), natural.alias("natural"))


def verdicts(endings: DataFrame, weights: DataFrame) -> DataFrame:
    """``ending, score, natural`` of each different ending of which the model knows a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[bytes] = []
        items: list[str] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(items, pa.string())], ["ending", "item"])

        for b in batches:
            for i, words, part, follows in zip(*(c.to_pylist() for c in b.columns)):
                fs = {*features(part, follows), *(["…" + words] if words else [])}
                items += fs
                ids += [i] * len(fs)
                if len(ids) >= HELD:
                    yield flush()
                    ids, items = [], []
        yield flush()

    each = endings.select("ending", "words", "part", "follows").dropDuplicates(["ending"]).mapInArrow(run, "ending binary, item string")
    return each.join(weights, "item").groupBy("ending").agg((F.sum("weight") / UNIT).alias("score"), F.bool_or("natural").alias("natural"))


def last_line(text: Column) -> Column:
    return F.substring_index(F.rtrim(text, F.lit(BLANKS)), "\n", -1)


def at_spikes(df: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``<key>, source, at_spike, ended, sure, last`` of every row, by built-in expressions.

    ``ended`` tells that the last line has terminal punctuation or no letters; ``sure`` that nothing in
    it (marks that may follow a cut, damaged characters) could make that wrong.
    """
    s = written(spikes(df, source=source, text=text), "spikes")  # as small as the number of limits; its size is known from the file
    d = df.select(F.col(key), F.col(source).alias("source"), F.char_length(text).alias("chars"), F.octet_length(text).alias("bytes"), last_line(F.col(text)).alias("last"))
    for m in ("chars", "bytes"):
        x = s.where(F.col("measure") == m).select(F.col("source").alias("s_" + m), F.col("length").alias("l_" + m), F.lit(True).alias("at_" + m))
        d = d.join(x, d["source"].eqNullSafe(x["s_" + m]) & (d[m] == x["l_" + m]), "left")
    at = F.coalesce("at_chars", F.lit(False)) | F.coalesce("at_bytes", F.lit(False))
    d = d.select(key, "source", at.alias("at_spike"), "last", F.right("last", F.lit(TAIL)).alias("tail"))
    half = F.col("tail").rlike(HALF)
    core = F.rtrim(F.regexp_replace("tail", MARKS, ""), F.lit(BLANKS))
    d = d.select("*", core.alias("core"), half.alias("half"))
    ended = (F.col("core").rlike(ENDS) & ~F.col("half")) | ~F.col("last").rlike(r"\p{L}")
    sure = (F.col("core") == F.col("tail")) & ~F.col("half") & ~F.col("tail").rlike(r"[^\x00-\x7f]")
    return d.select(key, "source", "at_spike", ended.alias("ended"), sure.alias("sure"), "last")


def judged(df: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``<key>, source, at_spike, cut, by`` for every row; ``by`` is ``spike`` or ``ending`` for texts that were cut, else null.

    * null, empty and blank texts aren't cut; a null source is a source of its own;
    * a text without any line before its last still counts; very long ones are judged by their whole last line;
    * repeated rows each give a row; an empty table gives no rows; other columns aren't read.
    """
    weights = weighed(df, text=text)
    d = at_spikes(df, key=key, source=source, text=text)
    d = d.withColumn("by", F.when(F.col("at_spike") & F.col("sure") & ~F.col("ended"), "spike"))
    # what is left to Python: endings that may be damaged or marked, and unfinished ones at other lengths
    left = F.col("by").isNull() & ~(F.col("sure") & F.col("ended"))
    d = d.select(key, "source", "at_spike", "by", F.when(left, F.col("last")).alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by = b.column(3).to_pylist()
            found: list[tuple] = [(None,) * 5] * len(by)
            for i, (spike, line) in enumerate(zip(b.column(2).to_pylist(), b.column(4).to_pylist())):
                if not line or (got := ending(line)) is None:
                    continue
                core, dotted, words = got
                part, follows = fragment(core)
                if spike and not words:
                    by[i] = "spike"
                elif spike or follows or any(map(str.isalnum, part)):
                    found[i] = hashlib.blake2b(repr((words, part, follows)).encode(), digest_size=16).digest(), words, part, follows, dotted
            kinds = pa.binary(), pa.string(), pa.string(), pa.bool_(), pa.bool_()
            more = [pa.array(x, k) for x, k in zip(zip(*found), kinds)] if found else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(by, pa.string()), *more], [key, "source", "at_spike", "by", "ending", "words", "part", "follows", "dotted"])

    kind = df.schema[key].dataType.simpleString()
    d = written(d.mapInArrow(run, f"`{key}` {kind}, source string, at_spike boolean, by string, ending binary, words string, part string, follows boolean, dotted boolean"), "judged")
    open_ = d.where(F.col("ending").isNotNull())
    # rows without an open ending stay out of the join: they would all have one key
    said = open_.join(verdicts(open_, weights), "ending", "left")
    over = F.coalesce("score", F.lit(0.0)) > F.when(F.col("dotted"), MARKED).otherwise(ANYWHERE)
    by = F.when(F.coalesce("natural", F.lit(False)), None).when(F.col("at_spike"), "spike").when(over, "ending")
    d = d.where(F.col("ending").isNull()).select(key, "source", "at_spike", "by").unionByName(said.select(key, "source", "at_spike", by.alias("by")))
    return d.select(key, "source", "at_spike", F.col("by").isNotNull().alias("cut"), "by")


def by_source(judgements: DataFrame) -> DataFrame:
    """``source, n_docs, n_cut, n_spike, n_ending, share`` of the documents of each source: all that were cut, and those by each way."""
    cut = F.count("by")
    return judgements.groupBy("source").agg(F.count("*").alias("n_docs"), cut.alias("n_cut"), F.count_if(F.col("by") == "spike").alias("n_spike"), F.count_if(F.col("by") == "ending").alias("n_ending"), (cut / F.count("*")).alias("share"))
