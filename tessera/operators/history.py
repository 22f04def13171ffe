"""A commit log as a table: take-while windows, authors, latest commit of each path.

``commits(hash, short_hash, message, author, date)``; ``commit_files(hash, path)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recent(commits: DataFrame, max_count: int = 30, since=None) -> DataFrame:
    """The newest ``max_count`` commits, up to the first one older than ``since`` (a timestamp column or literal).

    The log is in order of date, so taking while newer is a filter; ties go by hash.
    """
    newest = commits.orderBy(F.desc("date"), "hash").limit(max_count)
    return newest if since is None else newest.filter(F.col("date") >= since)


def take_while(rows: DataFrame, position: str, date: str, since) -> DataFrame:
    """Rows in order of ``position`` up to the first whose date is before ``since``, for logs that are not in order."""
    stop = rows.filter(F.col(date) < since).agg(F.min(position).alias("stop"))
    return rows.crossJoin(F.broadcast(stop)).filter(F.col("stop").isNull() | (F.col(position) < F.col("stop"))).drop("stop")


def days_before(when, days: int):
    return F.lit(when).cast("timestamp") - F.make_dt_interval(F.lit(days))


def file_commits(commits: DataFrame, commit_files: DataFrame, path: str, max_count: int = 5) -> DataFrame:
    touching = commit_files.filter(F.col("path") == path).select("hash").distinct()
    return commits.join(touching, "hash", "left_semi").orderBy(F.desc("date"), "hash").limit(max_count)


def latest_per_path(commits: DataFrame, commit_files: DataFrame, since, max_files: int = 50, max_commits: int = 200) -> DataFrame:
    """``path`` with its latest commit of the window, newest first, over the first ``max_commits``."""
    window = recent(commits, max_commits, since)
    newest = window.join(commit_files, "hash").groupBy("path").agg(F.max_by(F.struct("hash", "short_hash", "message", "author", "date"), F.struct(F.col("date"), F.col("hash"))).alias("c"))
    return newest.select("path", "c.*").orderBy(F.desc("date"), "path").limit(max_files)


def author_stats(commits: DataFrame) -> DataFrame:
    return commits.groupBy("author").agg(F.count("*").alias("n"))


def by_author(commits: DataFrame, shown: int = 5) -> DataFrame:
    """Messages of each author, newest first, at most ``shown``, with the number not shown."""
    ranked = commits.withColumn("r", F.row_number().over(Window.partitionBy("author").orderBy(F.desc("date"), "hash")))
    listed = ranked.filter(F.col("r") <= shown).groupBy("author").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "message"))), lambda x: x["message"]).alias("messages"))
    return listed.join(author_stats(commits), "author").select("author", "n", "messages", F.greatest(F.lit(0), F.col("n") - shown).alias("more"))


def mentioning(commits: DataFrame, text: str, max_count: int = 50, since=None, shown: int = 5) -> DataFrame:
    hit = recent(commits, max_count, since).filter(F.contains(F.lower("message"), F.lit(text.lower())))
    return hit.orderBy(F.desc("date"), "hash").limit(shown)
