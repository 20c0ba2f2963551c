"""Building, extending and querying stores from the command line.

    python -m quadrille build LINES STORE      quads out of build files; faulty lines go to STORE-faulty
    python -m quadrille insert TRIPLES STORE   triples that hold from today (or --day); faulty lines go to STORE-faulty
    python -m quadrille load LOG STORE         rows of a change log in Parquet, into a store that is there
    python -m quadrille query STORE FILE...    queries out of files; --repeat N times each, --out FOLDER for whole answers
    python -m quadrille shell STORE            queries and updates typed in, each ended by an empty line
    python -m quadrille predicates|pages|compact STORE
    python -m quadrille triples STORE          all facts that hold, as lines; --out FOLDER

Answers are printed whole, a line a row; ``--out`` writes them as Parquet instead (lines as text).
"""

from __future__ import annotations

import argparse
import sys
import time
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.shared import written
from quadrille.operators.history import EVERY
from quadrille.plans.execute import UnsupportedQuery
from quadrille.plans.sparql import ParseError, Select, parse, parse_file
from quadrille.sources.saved import Saved
from quadrille.sources.text import as_triples, read_quads, read_triples
from quadrille.store import Store, inserts


def _loaded(rows: DataFrame, path: str, cols: list[str]) -> DataFrame:
    """Parsed once; faulty lines are set apart with file, line and reason, the good ones returned."""
    rows = written(rows, "parsed")
    bad = rows.where(F.col("reason").isNotNull())
    bad.select("file_name", "line", "reason").write.mode("append").parquet(f"{path.rstrip('/')}-faulty")
    return rows.where(F.col("reason").isNull()).select(*cols)


def build(spark: SparkSession, lines: str, path: str) -> None:
    Store.of_quads(_loaded(read_quads(spark, lines), path, ["s", "p", "o", "t"])).save(path)


def insert(spark: SparkSession, triples: str, path: str, day: date | None = None) -> None:
    store = Saved(spark, path)
    store.extend(inserts(_loaded(read_triples(spark, triples), path, ["s", "p", "o"]), day, store.last_seq + 1))


def load(spark: SparkSession, log: str, path: str) -> None:
    Saved(spark, path).extend(spark.read.parquet(log))


def show(answer: DataFrame, out: str | None) -> int:
    """The whole answer, printed as it comes in or written; gives the number of rows."""
    if out:
        (answer.write.mode("overwrite").text if answer.columns == ["value"] else answer.write.mode("overwrite").parquet)(out)
        spark = answer.sparkSession
        return (spark.read.text(out) if answer.columns == ["value"] else spark.read.parquet(out)).count()
    n = 0
    print("\t".join(answer.columns))
    for row in answer.toLocalIterator():  # a partition at a time
        print("\t".join("" if x is None else str(x) for x in row))
        n += 1
    return n


def shell(spark: SparkSession, path: str, mode: str, day: date | None) -> None:
    """Reads queries and updates from standard input, each ended by an empty line or the end; faulty ones are reported and passed over."""
    text: list[str] = []
    for line in [*sys.stdin, ""]:
        if line.strip():
            text.append(line)
            continue
        if not text:
            continue
        try:
            began, q = time.perf_counter(), parse("".join(text))
            store = Store.open(spark, path)
            if isinstance(q, Select):
                n = show(store.answer(q, mode), None)
                print(f"{n} rows, {time.perf_counter() - began:.2f} s")
            else:
                rows = store.changes("".join(text), day, store.stored.last_seq + 1)
                print(f"version {store.stored.extend(rows).version}")
        except (ParseError, UnsupportedQuery) as e:
            print(f"error: {e}")
        text = []


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = argparse.ArgumentParser(prog="quadrille", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    a.add_argument("verb", choices=["build", "insert", "load", "query", "shell", "predicates", "pages", "compact", "triples"])
    a.add_argument("paths", nargs="+")
    a.add_argument("--day", type=date.fromisoformat)
    a.add_argument("--repeat", type=int, default=1)
    a.add_argument("--mode", choices=["end", "any"], default="end")
    a.add_argument("--out")
    args = a.parse_args(argv)
    spark = spark or SparkSession.builder.appName("quadrille").getOrCreate()
    path = args.paths[0]
    if args.verb == "build":
        build(spark, *args.paths)
    elif args.verb == "insert":
        insert(spark, *args.paths, args.day)
    elif args.verb == "load":
        load(spark, *args.paths)
    elif args.verb == "compact":
        print(f"version {Saved(spark, path).compacted().version}")
    elif args.verb == "predicates":
        show(Store.open(spark, path).counts("p").orderBy("p"), args.out)
    elif args.verb == "triples":
        show(as_triples(Store.open(spark, path).facts()), args.out)
    elif args.verb == "pages":  # what of the log lies where
        period = F.floor(F.unix_date("t") / EVERY).alias("period")
        show(Store.open(spark, path).log.groupBy("p", period).agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last")).orderBy("p", "period"), args.out)
    elif args.verb == "shell":
        shell(spark, path, args.mode, args.day)
    else:
        store = Store.open(spark, path)
        for name in args.paths[1:]:
            q, times, n = parse_file(name), [], 0
            for i in range(args.repeat):
                began = time.perf_counter()
                n = show(store.answer(q, args.mode), args.out and f"{args.out}/{i}-{name.rsplit('/', 1)[-1]}")
                times.append(time.perf_counter() - began)
            print(f"{name}: {n} rows, {sum(times) / len(times):.2f} s (first {times[0]:.2f})")


if __name__ == "__main__":
    main()
