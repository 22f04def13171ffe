"""Keeping an index up to date from a stream of file rows: each micro-batch adds the chunks of its own files.

Batch n is a folder ``n`` with ``chunks`` and ``files`` (the paths it brought, also those it deleted); a chunk counts if
no later batch names its file. ``compact`` merges what there is into a folder ``base-n``, which stands for all batches up
to n. So a batch costs what it brings, not what the index holds.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.chunks import CHUNK, chunk_texts

_CHUNKS, _FILES = CHUNK + ", batch long", "source string, batch long"


def _complete(spark: SparkSession, at: str) -> tuple[list[str], int]:
    """Folders to read: the newest base and the batches after it; and the number of the last one (-1 for none)."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(path(at))] if system.exists(path(at)) else []
    names = [n for n in names if re.fullmatch(r"(base-)?\d+", n) and system.exists(path(f"{at}/{n}/files/_SUCCESS"))]
    bases = [int(n[5:]) for n in names if n.startswith("base-")]
    first = max(bases, default=-1)
    later = sorted(int(n) for n in names if n.isdigit() and int(n) > first)
    return [f"{at}/base-{first}"] * (first >= 0) + [f"{at}/{n}" for n in later], max([first, *later])


def _state(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame, int]:
    """The chunks that count, the newest batch of each path, and the last batch."""
    folders, last = _complete(spark, at)
    if not folders:
        return spark.createDataFrame([], _CHUNKS), spark.createDataFrame([], _FILES), last
    files = spark.read.schema(_FILES).parquet(*(f"{x}/files" for x in folders)).groupBy("source").agg(F.max("batch").alias("batch"))
    chunks = spark.read.schema(_CHUNKS).parquet(*(f"{x}/chunks" for x in folders))
    return chunks.join(files, ["source", "batch"], "left_semi").select(*chunks.columns), files, last


def current_chunks(spark: SparkSession, at: str) -> DataFrame:
    """The chunk table after the last complete batch."""
    return _state(spark, at)[0].drop("batch")


def _write(chunks: DataFrame, files: DataFrame, at: str) -> None:
    """Files come last: a folder counts once they are complete."""
    chunks.write.mode("overwrite").parquet(f"{at}/chunks")
    files.write.mode("overwrite").parquet(f"{at}/files")


def compact(spark: SparkSession, at: str) -> int:
    """Merge all complete batches into one folder; returns the last batch that it stands for (-1 if there is none)."""
    chunks, files, last = _state(spark, at)
    if last >= 0 and _complete(spark, at)[0] != [f"{at}/base-{last}"]:
        _write(chunks, files, f"{at}/base-{last}")
    return last


def keep_index(files: DataFrame, at: str, checkpoint: str) -> StreamingQuery:
    """Run over all that is there (``path, content``; null content deletes a file) and stop.

    A batch that runs again writes its folder again; the last row of a path in a batch counts, by ``mtime`` if there is
    one. Rows without a path are left out.
    """

    def batch(rows: DataFrame, number: int) -> None:
        order = F.col("mtime") if "mtime" in rows.columns else F.lit(0)
        last = rows.filter("path is not null").groupBy("path").agg(F.max_by("content", F.struct(order, F.xxhash64("content"))).alias("content")).persist()
        stamp = F.lit(number).cast("long").alias("batch")
        _write(chunk_texts(last).select("*", stamp), last.select(F.col("path").alias("source"), stamp), f"{at}/{number}")
        last.unpersist()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
