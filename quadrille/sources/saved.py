"""Stores on disk that can be extended.

A store is a folder of Parquet folders and manifests.  A manifest (``manifest-00000003.json``) names
the folders that make up one version: parts of the log, parts of the validity periods, parts of the
counts.  Folders are never changed once a manifest names them.  An extension writes new folders and
then the next manifest, in one step that fails if another writer was first, so readers see a version
as a whole or not at all, and a writer that dies leaves nothing but folders nobody names.

* The log grows by a part with the new rows.
* Periods are a base and *replacements*: a replacement has all periods of every fact its rows touch (a
  fact that no longer has any has one row with a null ``t_from``) and takes the place of what older
  parts say about these facts.  A fact that isn't touched is neither read nor written again.
* Counts are parts that add up: a replacement's part has the differences it makes.
* Now and then (``MOST_PARTS``) the predicates that replacements touched are written anew as one part,
  the others stay where they are.

Parts are in folders by predicate, sorted so that a subject is found by row-group statistics.  A heavy
predicate is cut across files by range of subjects; a rare one has one file.  A store made with more
than ``FOLDERS`` predicates has no such folders, and predicates too are found by statistics.

A store is made part by part: each part is one shuffle, whose files go before the next part begins,
and the periods of an insert-only log are made from the part of the log that is already written.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.shared import file_system, partitions, present, shuffles_freed, written
from quadrille.operators import history as H

FACT = ("s", "p", "o")
LOG = "op string, s string, p string, o string, t date, seq long"
PERIODS = "s string, p string, o string, t_from date, t_to date"
COUNTS = {"p": ("p",), "sp": ("s", "p"), "op": ("o", "p")}
#: Up to so many predicates have folders of their own; with more, files are only sorted.
FOLDERS = 5000
#: So many replacements of periods are kept before they are folded into the base.
MOST_PARTS = 16


class Conflict(RuntimeError):
    """Another writer has made the next version."""


def _manifests(spark: SparkSession, path: str) -> list[str]:
    fs, p = file_system(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in names if n.startswith("manifest-") and n.endswith(".json"))


def _commit(spark: SparkSession, path: str, version: int, content: dict) -> None:
    """Makes a version known. The file is complete before it has its name; whoever makes the claim file first has the version."""
    fs, final = file_system(spark, f"{path}/manifest-{version:08d}.json")
    _, claim = file_system(spark, f"{path}/claim-{version:08d}")
    _, draft = file_system(spark, f"{path}/draft-{uuid.uuid4().hex}")
    try:
        fs.create(claim, False).close()
    except Exception as e:
        raise Conflict(f"{claim} is there: another writer has made version {version}, or died while it did and the claim can be deleted") from e
    out = fs.create(draft)
    out.write(json.dumps(content).encode())
    out.close()
    fs.rename(draft, final)


class Saved:
    """One version of a store on disk, the latest if not told otherwise."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path
        names = _manifests(spark, path)
        if not names:
            raise FileNotFoundError(f"no store at {path}")
        name = names[-1] if version is None else f"manifest-{version:08d}.json"
        self.version = int(name.removeprefix("manifest-").removesuffix(".json"))
        self.content = json.loads(spark.read.text(f"{path}/{name}", wholetext=True).first()[0])

    def _parts(self, schema: str, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(schema)
        if names[0].split("/")[1].startswith("v="):  # parts of one kind lie side by side
            read = read.option("basePath", f"{self.path}/{names[0].split('/')[0]}")
        return read.parquet(*[f"{self.path}/{n}" for n in names]).select(*[c.split()[0] for c in schema.split(", ")])

    def log(self) -> DataFrame:
        return self._parts(LOG, self.content["log"])

    def base(self) -> DataFrame:
        """Periods of the base; a part is read without the predicates that were written anew later."""
        parts = []
        for name, without in self.content["base"]:
            d = self._parts(PERIODS, [name])
            parts.append(d.where(~F.col("p").isin(without)) if without else d)
        return reduce(DataFrame.unionAll, parts)

    def replacements(self) -> DataFrame:
        """The latest periods of every fact that replacements touch, and their marks."""
        d = self._parts(PERIODS + ", part int", self.content["replaced"])
        latest = d.groupBy(*FACT).agg(F.max("part").alias("part"))
        return d.join(latest, [*FACT, "part"], "left_semi").select(*[c.split()[0] for c in PERIODS.split(", ")])

    def periods(self) -> DataFrame:
        """``s, p, o, t_from, t_to``. Replacements are few beside the base, so they go to it, not it to them."""
        if not self.content["replaced"]:
            return self.base()
        touched = self._parts(PERIODS, self.content["replaced"]).select(*FACT).distinct()
        return self.base().join(touched, list(FACT), "left_anti").unionAll(self.replacements().where(F.col("t_from").isNotNull()))

    def counts(self, name: str) -> DataFrame:
        """Facts that hold now by ``p``, ``sp`` or ``op``: the columns and ``n``."""
        by = COUNTS[name]
        parts = [f"{x}/{name}" for x in self.content["counts"]]
        d = self._parts(", ".join([*(f"{c} string" for c in by), "n long"]), parts)
        return d if len(parts) == 1 else d.groupBy(*by).agg(F.sum("n").alias("n")).where("n <> 0")

    def predicates(self) -> list[str]:
        """The predicates replacements touch; asked for only where there are folders, so fewer than ``FOLDERS`` and what came since."""
        return [r[0] for r in self._parts(PERIODS, self.content["replaced"]).select("p").distinct().collect()]

    # writing

    def extend(self, rows: DataFrame, stream: tuple[str, int] | None = None) -> Saved:
        """The version with more log rows (op, s, p, o, t, seq). A batch of a ``stream`` (its name, the batch's number) that is in already changes nothing.

        Rows with a null in op, s, p, o or t stay in the log and say nothing.
        """
        if stream and self.content["streams"].get(stream[0], -1) >= stream[1]:
            return self
        rows = written(rows.select("op", "s", "p", "o", F.col("t").cast("date").alias("t"), F.col("seq").cast("long").alias("seq")), "changes")
        new = dict(self.content, streams=dict(self.content["streams"]))
        if stream:
            new["streams"][stream[0]] = stream[1]
        last = rows.agg(F.max("seq").alias("m"), F.count("*").alias("n")).first()
        if last["n"]:
            tag, folders = uuid.uuid4().hex[:12], self.content["folders"]
            touched = written(present(rows.select(*FACT), *FACT).distinct(), "touched")
            before = self.periods().join(touched, list(FACT), "left_semi")
            after = H.history(self.log().join(touched, list(FACT), "left_semi").unionByName(rows))
            after = written(after.unionByName(touched.join(after, list(FACT), "left_anti").withColumns({"t_from": F.lit(None).cast("date"), "t_to": F.lit(None).cast("date")})), "after")
            _write(rows, f"{self.path}/log/v={tag}", ("p", "t", "seq"), folders)
            _write(after.withColumn("part", F.lit(self.version + 1)), f"{self.path}/replaced/v={tag}", ("p", "s", "o"), folders)
            open_ = lambda d, n: present(d.where("t_to IS NULL"), "t_from").select(*FACT, F.lit(n).cast("long").alias("d"))
            _write_counts(open_(after, 1).unionAll(open_(before, -1)).groupBy(*FACT).agg(F.sum("d").alias("n")).where("n <> 0"), f"{self.path}/counts/{tag}")
            new |= {"log": [*new["log"], f"log/v={tag}"], "replaced": [*new["replaced"], f"replaced/v={tag}"], "counts": [*new["counts"], f"counts/{tag}"]}
            new["seq"] = max(new["seq"], last["m"] or 0)
        _commit(self.spark, self.path, self.version + 1, new)
        now = Saved(self.spark, self.path, self.version + 1)
        return now.compacted() if len(now.content["replaced"]) >= MOST_PARTS else now

    def compacted(self) -> Saved:
        """The same store with replacements folded into the base: only the predicates they touch are written anew."""
        if not self.content["replaced"]:
            return self
        tag, folders = uuid.uuid4().hex[:12], self.content["folders"]
        new = dict(self.content, replaced=[])
        if folders:
            names = sorted(self.predicates())
            _write(self.periods().where(F.col("p").isin(names)), f"{self.path}/base/v={tag}", ("p", "s", "o"), True)
            new["base"] = [*([n, sorted({*without, *names})] for n, without in self.content["base"]), [f"base/v={tag}", []]]
        else:
            _write(self.periods(), f"{self.path}/base/v={tag}", ("p", "s", "o"), False)
            new["base"] = [[f"base/v={tag}", []]]
        for name, by in COUNTS.items():
            self.counts(name).repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(f"{self.path}/counts/{tag}/{name}")
        new["counts"] = [f"counts/{tag}"]
        _commit(self.spark, self.path, self.version + 1, new)
        return Saved(self.spark, self.path, self.version + 1)

    @property
    def last_seq(self) -> int:
        return self.content["seq"]


def _write(df: DataFrame, path: str, order: tuple[str, ...], folders: bool) -> None:
    _write_ranges(df.repartitionByRange(partitions(df.sparkSession), *order), path, order, folders)


def _write_ranges(df: DataFrame, path: str, order: tuple[str, ...], folders: bool) -> None:
    d = df.sortWithinPartitions(*order)
    with shuffles_freed(df.sparkSession):
        (d.write.partitionBy("p") if folders else d.write).parquet(path, compression="zstd")


def _write_counts(facts: DataFrame, path: str) -> None:
    """Count tables of ``s, p, o, n``; those by predicate are added up from those by subject and predicate."""
    spark = facts.sparkSession
    for name in ("sp", "op"):
        by = COUNTS[name]
        with shuffles_freed(spark):
            facts.groupBy(*by).agg(F.sum("n").alias("n")).repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(f"{path}/{name}")
    sp = spark.read.schema("s string, p string, n long").parquet(f"{path}/sp")
    with shuffles_freed(spark):
        sp.groupBy("p").agg(F.sum("n").alias("n")).coalesce(1).write.parquet(f"{path}/p")


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_manifests(spark, path))


def _stated(log: DataFrame) -> DataFrame:
    """The periods of a log without deletes. Rows are cut by ranges of facts at once, so facts meet and are in order after one shuffle."""
    d = log.select(*FACT, "t").repartitionByRange(partitions(log.sparkSession), "p", "s", "o")
    return d.groupBy(*FACT).agg(F.min("t").alias("t_from")).withColumn("t_to", F.lit(None).cast("date"))


def create(spark: SparkSession, path: str, log: DataFrame, periods: DataFrame | None, mode: str = "errorifexists") -> Saved:
    """A new store, or with ``overwrite`` a new version of the one that is there, made of this log alone. No periods: all rows of the log are facts that stay."""
    names = _manifests(spark, path)
    if names and mode != "overwrite":
        raise FileExistsError(path)
    version = Saved(spark, path).version + 1 if names else 0
    tag = uuid.uuid4().hex[:12]
    with shuffles_freed(spark):
        folders = log.agg(F.approx_count_distinct("p")).first()[0] <= FOLDERS
    log = log.select("op", "s", "p", "o", F.col("t").cast("date").alias("t"), F.col("seq").cast("long").alias("seq"))
    _write(log, f"{path}/log/v={tag}", ("p", "t", "seq"), folders)
    if periods is None:
        _write_ranges(_stated(spark.read.schema(LOG).parquet(f"{path}/log/v={tag}")), f"{path}/base/v={tag}", ("p", "s", "o"), folders)
    else:
        _write(periods, f"{path}/base/v={tag}", ("p", "s", "o"), folders)
    facts = spark.read.schema(PERIODS).parquet(f"{path}/base/v={tag}").where("t_to IS NULL")
    _write_counts(facts.select(*FACT, F.lit(1).cast("long").alias("n")), f"{path}/counts/{tag}")
    with shuffles_freed(spark):
        last = spark.read.schema(LOG).parquet(f"{path}/log/v={tag}").agg(F.max("seq")).first()[0] or 0
    _commit(spark, path, version, {"log": [f"log/v={tag}"], "base": [[f"base/v={tag}", []]], "replaced": [], "counts": [f"counts/{tag}"], "folders": folders, "streams": {}, "seq": last})
    return Saved(spark, path, version)
