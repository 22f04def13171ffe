"""Shared plumbing of the training-data operators: the cluster's shared folder and scratch tables.

Nothing here keeps data on one machine: intermediate results are Parquet tables below the folder that
``spark.checkpoint.dir`` names, so a lost executor only costs the tasks it was running.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@lru_cache
def _fresh_dir(application: str) -> str:
    """One folder for each session; the setting itself can't be changed while a session runs."""
    return "file://" + tempfile.mkdtemp(prefix="tessera-shared-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a fresh local one where it is unset on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _fresh_dir(spark.sparkContext.applicationId)
    return found.rstrip("/")


class Scratch:
    """Parquet tables of one operator run, below a unique folder of the shared directory."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        self._next = 0
        self._kept: list[str] = []

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back: its lineage ends there."""
        self._next += 1
        at = self.path(f"{self._next:03d}-{name}")
        self.write(df.write, at)
        self._kept.append(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def write(self, writer, at: str) -> None:
        """Write a table; the shuffle files of the job go when it ends, since nothing but the table is read later."""
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            writer.parquet(at)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)

    def finish(self, df: DataFrame, name: str) -> DataFrame:
        """``keep`` the result of a run and delete all other tables that the run kept."""
        old = list(self._kept)
        out = self.keep(df, name)
        for at in old:
            self.drop(at)
        return out

    def forget(self, kept: DataFrame) -> None:
        """Delete a table that ``keep`` returned and that nothing will read again."""
        for at in {f.rsplit("/", 1)[0] for f in kept.inputFiles()}:
            self.drop(at)

    def drop(self, at: str | None = None) -> None:
        """Delete one path, or everything this run wrote."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(at or self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: A value that stands in more than one of so many rows is heavy; there are fewer of these than this number.
HEAVY = 2000


def heavy_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", keep_count: bool = False) -> DataFrame:
    """``left`` joined (inner or left) to ``right``, whose column ``n`` says how many rows of ``left`` have its value of ``on``.

    Rows of ``left`` with a heavy value meet a broadcast of the heavy rows of ``right``, so they stay spread as they are;
    the others are shuffled, and no value of these has more than a two-thousandth of all rows. Both sides are read
    twice, so they should be stored. ``n`` goes unless ``keep_count``.
    """
    total = right.agg(F.sum("n")).first()[0] or 0
    heavy = right.filter(F.col("n") * HEAVY > total)
    out = lambda df: df if keep_count else df.drop("n")
    if heavy.isEmpty():
        return left.join(out(right).hint("shuffle_merge"), on, how)
    few = F.broadcast(out(heavy))  # HEAVY values at most
    light = left.join(F.broadcast(heavy.select(on).distinct()), on, "left_anti")
    return left.join(few, on).unionByName(light.join(out(right.filter(F.col("n") * HEAVY <= total)).hint("shuffle_merge"), on, how))


def utf8_rows(column: pa.Array) -> list[bytes]:
    """The column's strings as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
