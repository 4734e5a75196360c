"""Session helpers: the folder all executors share, storing what is used again, hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What was written into shared folders and not yet deleted.
_written: list[str] = []


def own_folder(master: str) -> str:
    """A temporary folder for a session that names none, which only one on a single machine may have."""
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    return tempfile.mkdtemp(prefix="tessera-checkpoint-")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session (a test, a notebook) may do without one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or own_folder(sc.master))
    return sc.getCheckpointDir()


def _path(spark: SparkSession, at: str):
    """A path and its file system, whatever that is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _note(spark: SparkSession, at: str) -> None:
    path, fs = _path(spark, at)
    fs.deleteOnExit(path)
    _written.append(at)


def store(df: DataFrame) -> DataFrame:
    """The same rows, written as a table in the shared folder, so that a lost executor costs no recomputation.

    Unlike a checkpoint it is read by column and filter. It is deleted at the end of :func:`scratch` or of the session.
    """
    spark = df.sparkSession
    at = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    _note(spark, at)
    return spark.read.schema(df.schema).parquet(at)


def share(spark: SparkSession, name: str, data: bytes) -> str:
    """Puts bytes into the shared folder as a file that every executor fetches for itself; tasks find it as a local file
    by ``SparkFiles.get(name)``."""
    at = f"{ensure_checkpoint_dir(spark)}/{name}"
    path, fs = _path(spark, at)
    if not fs.exists(path):
        part, _ = _path(spark, f"{at}.{uuid.uuid4().hex}")
        out = fs.create(part)
        out.write(bytearray(data))
        out.close()
        if fs.rename(part, path):
            fs.deleteOnExit(path)
        else:  # someone else put the same there
            fs.delete(part, False)
    spark.sparkContext.addFile(str(path.toUri()) if path.toUri().getScheme() else str(fs.makeQualified(path)))
    return name


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that were stored within; their DataFrames are of no use after that."""
    before = len(_written)
    try:
        yield
    finally:
        for at in _written[before:]:
            path, fs = _path(spark, at)
            fs.delete(path, True)
        del _written[before:]


def hot_keys(df: DataFrame, key: str, weight: str | None, least: int, most: int) -> list[tuple]:
    """The keys that hold at least ``least`` rows (or that sum of ``weight``), largest first, with their size.

    At most ``most`` rows reach the driver, whatever the data: a further hot key is then handled like any other key.
    """
    size = F.sum(weight) if weight else F.count(F.lit(1))
    found = (
        df.where(F.col(key).isNotNull()).groupBy(key).agg(size.alias("__size")).where(F.col("__size") >= least)
        .orderBy(F.desc("__size"), F.col(key)).limit(most)
    )
    return [tuple(r) for r in found.collect()]


def pairs_within(df: DataFrame, group: list[str], item: str, block: int) -> DataFrame:
    """group, ``<item>_a`` < ``<item>_b``: all pairs of a group's distinct items, ``df`` having each once.

    The items of a group are dealt into blocks of about ``block``, and each block meets the whole group in a key of its
    own, so no task has all pairs of a large group.
    """
    sizes = df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / block).alias("__blocks"))
    held = df.select(*group, item).join(sizes, group)
    left = held.select(*group, F.col(item).alias(f"{item}_a"), F.pmod(F.xxhash64(item), "__blocks").alias("__block"))
    right = held.select(*group, F.col(item).alias(f"{item}_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)).alias("__block"))
    return left.join(right, [*group, "__block"]).where(F.col(f"{item}_a") < F.col(f"{item}_b")).drop("__block")
