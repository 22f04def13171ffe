"""Tables kept as a series of changes: each is a folder, which counts once its last table is complete.

A change ``n`` has the rows that came and, in the table ``gone``, the ids that went or were replaced; a row counts if no
later change names its id. A folder ``base-n`` stands for all changes up to n.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Changes:
    """Folders below ``root`` of rows with ids of type ``kind``; ``version`` opens them as they were after that change."""

    #: The table that is written last.
    LAST = "gone"

    def __init__(self, spark: SparkSession, root: str, kind: str = "string", version: int | None = None):
        self.spark, self.root, self.kind, self.version = spark, root.rstrip("/"), kind, version

    def _system(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folders(self) -> list[tuple[int, str]]:
        """The newest base and the changes after it, with their numbers."""
        path, system = self._system()
        names = [s.getPath().getName() for s in system.listStatus(path(self.root))] if system.exists(path(self.root)) else []
        names = [n for n in names if re.fullmatch(r"(base-)?\d+", n) and system.exists(path(f"{self.root}/{n}/{self.LAST}/_SUCCESS"))]
        number = lambda n: int(n.removeprefix("base-"))
        names = [n for n in names if self.version is None or number(n) <= self.version]
        first = max((number(n) for n in names if n.startswith("base-")), default=-1)
        out = [(first, f"{self.root}/base-{first}")] if first >= 0 else []
        return out + sorted((number(n), f"{self.root}/{n}") for n in names if n.isdigit() and number(n) > first)

    def last(self) -> int:
        """The number of the last change; 0 before the first."""
        found = self._folders()
        return found[-1][0] if found else 0

    def size(self) -> int:
        """How many folders a search reads."""
        return len(self._folders())

    def _all(self, name: str, schema: str) -> DataFrame:
        """A table of all folders, with ``segment``, the number of the folder."""
        out = self.spark.createDataFrame([], f"{schema}, segment long")
        for number, at in self._folders():
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{at}/{name}").withColumn("segment", F.lit(number).cast("long")))
        return out

    def _live(self, rows: DataFrame, part=None) -> DataFrame:
        """Rows (``id, segment`` and more) of ids that no later change names; ``part`` is a condition on ``id`` that all rows meet."""
        gone = self._all("gone", f"id {self.kind}")
        gone = (gone if part is None else gone.filter(part)).groupBy(F.col("id").alias("gone_id")).agg(F.max("segment").alias("until"))
        return rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("until") > F.col("segment")), "left_anti")

    def clear(self) -> None:
        path, system = self._system()
        system.delete(path(self.root), True)
