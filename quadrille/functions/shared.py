"""Small helpers every operator needs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: set[str] = set()


class NoSharedFolder(RuntimeError):
    """A cluster without a folder that all its machines see."""


def shared_dir(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh folder under the cluster's shared folder (``spark.checkpoint.dir``), which goes when the session ends unless kept.

    Without the setting a local session (tests) gets a temporary folder; on a cluster, where every
    machine would have its own, that is refused.
    """
    sc = spark.sparkContext
    base = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise NoSharedFolder(f"set {CHECKPOINT_CONF} to a folder that all machines of the cluster share")
        local = tempfile.mkdtemp(prefix="quadrille-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        base = f"file://{local}"
        spark.conf.set(CHECKPOINT_CONF, base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if not keep:
        _made.add(path)
    return path


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def release() -> None:
    """Deletes the intermediate folders made so far; results that still read them become invalid. Called when Python ends."""
    spark = SparkSession.getActiveSession()
    for path in sorted(_made):
        try:
            if path.startswith(("file:", "/")):
                shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
            elif spark is not None:
                fs, p = file_system(spark, path)
                fs.delete(p, True)
            else:
                continue
        except Exception:  # the session may be gone already
            continue
        _made.discard(path)


atexit.register(release)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: survives lost executors, cuts lineage."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written within gives up its shuffle files when it is done, so that steps one after another need the disk of the largest, not of all."""
    was = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_CONF) if was is None else spark.conf.set(CLEANUP_CONF, was)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, which its owner sizes to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def present(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without a null in the columns, said so that the scan can skip by statistics."""
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
