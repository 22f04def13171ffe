"""Versioned notes: sections carried down lines, appends without duplicates, deletions by header, versions.

A note document is Markdown text; parsed, it is ``seq, level, header, section, line``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.contain import held_strings


def parse(texts: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """One row per line with the section (``## `` header) that it stands under; null before the first."""
    rows = texts.select(F.col(key).alias("doc"), F.posexplode(F.split(text, "\n")).alias("seq", "line"))
    level = F.length(F.regexp_extract("line", r"^(#{1,6}) ", 1))
    header = F.when(F.col("line").startswith("## "), F.trim(F.substr("line", F.lit(4))))
    down = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("level", level).withColumn("header", header).withColumn("section", F.last("header", ignorenulls=True).over(down))


def sections(texts: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """``doc, section, content``: text before the first header is dropped."""
    body = parse(texts, key, text).filter("section is not null and header is null")
    out = body.groupBy("doc", "section").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("lines"))
    return out.select("doc", "section", F.trim(F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("content"))


def keyword_lines(texts: DataFrame, word: str, key: str = "doc", text: str = "text") -> DataFrame:
    """Lines that are not blank and hold the word, whatever the case; rows stay where they are."""
    rows = texts.select(F.col(key).alias("doc"), F.posexplode(F.split(text, "\n")).alias("seq", "line"))
    return rows.filter((F.trim("line") != "") & F.contains(F.lower("line"), F.lit(word.lower()))).select("doc", "seq", "line")


def new_entries(stored: DataFrame, added: DataFrame) -> DataFrame:
    """Rows of ``added(section, content)`` that are not stored yet under the same section, blanks around text aside.

    No section (null) is a section like any other; null and blank contents are left out; of equal entries one stays.
    """
    plain = lambda df: df.withColumn("content", F.trim("content")).filter("content is not null and content <> ''")
    fresh, old = plain(added).dropDuplicates(["section", "content"]), plain(stored).select("section", "content").distinct()
    return fresh.join(old, fresh["section"].eqNullSafe(old["section"]) & (fresh["content"] == old["content"]), "left_anti")


def unmentioned(entries: DataFrame, texts: DataFrame, token: str, text: str = "text") -> DataFrame:
    """Rows of ``entries`` whose token (as a string) is in none of the texts, by whatever characters it stands between.

    A null token is in no text, and an empty one in every text that is not null.
    """
    found = held_strings(texts.select(F.lit(0).alias("k"), F.col(text).alias("t")), "k", F.col("t"), entries.select(F.col(token).cast("string")), once=True).select("string")
    if not texts.filter(F.col(text).isNotNull()).isEmpty():
        found = found.unionAll(entries.sparkSession.range(1).select(F.lit("").alias("string")))
    return entries.join(found, entries[token].cast("string") == found["string"], "left_anti")


def without_headers(content: Column, name: str) -> Column:
    """Markdown without the headers of level two or more that hold ``name``, and without what stands under them."""
    low = name.lower()
    level = lambda x: F.length(F.regexp_extract(x, r"^(#{1,6})\s", 1))
    start = F.struct(F.lit(0).alias("cut"), F.array().cast("array<string>").alias("out"))

    def step(acc, line):
        own = level(line)
        cut = F.when((own >= 2) & F.contains(F.lower(line), F.lit(low)) & ((acc["cut"] == 0) | (own <= acc["cut"])), own).when((own > 0) & (own <= acc["cut"]), 0).otherwise(acc["cut"])
        return F.struct(cut.alias("cut"), F.when(cut == 0, F.array_append(acc["out"], line)).otherwise(acc["out"]).alias("out"))

    return F.array_join(F.aggregate(F.split(content, "\n"), start, step, lambda acc: acc["out"]), "\n")


class NoteStore:
    """Notes in versioned Parquet folders below ``root``: ``seq, section, content, created_at``.

    Every change writes a new folder and then moves a pointer file, so a reader sees the old or the new state.
    """

    SCHEMA = "seq long, section string, content string, created_at timestamp"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, at: str):
        return self._jvm.org.apache.hadoop.fs.Path(at)

    def _names(self, kind: str) -> list[int]:
        if not self._fs.exists(self._path(f"{self.root}/{kind}")):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(self._path(f"{self.root}/{kind}")) if s.getPath().getName().isdigit() and self._fs.exists(self._path(f"{s.getPath()}/_SUCCESS")))

    def read(self) -> DataFrame:
        states = self._names("state")
        return self.spark.createDataFrame([], self.SCHEMA) if not states else self.spark.read.schema(self.SCHEMA).parquet(f"{self.root}/state/{states[-1]}")

    def _write(self, rows: DataFrame) -> None:
        states = self._names("state")
        rows.write.parquet(f"{self.root}/state/{(states[-1] if states else 0) + 1}")

    def update(self, content: str, section: str = "Recent Decisions", at=None) -> bool:
        """Append an entry; False if it is there already. Empty content is refused."""
        if not content or not content.strip():
            raise ValueError("content must not be empty")
        now = self.read()
        if not now.filter((F.col("section") == section) & (F.trim("content") == content.strip())).isEmpty():
            return False
        last = now.agg(F.max("seq")).first()[0] or 0
        when = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
        row = self.spark.range(1).select(F.lit(last + 1).cast("long").alias("seq"), F.lit(section).alias("section"), F.lit(content.strip()).alias("content"), when.alias("created_at"))
        self._write(now.unionByName(row))
        return True

    def delete_section(self, name: str) -> bool:
        """Remove the entries of sections whose name holds ``name``, whatever the case; and inside the entries that stay
        each header of level two or more that holds it, with what follows up to the next header of its level or above."""
        if not name or not name.strip():
            raise ValueError("section name must not be empty")
        hit = F.contains(F.lower("section"), F.lit(name.strip().lower()))
        now = self.read()
        left = now.filter(~hit).withColumn("kept", without_headers(F.col("content"), name.strip()))
        changed = left.filter(F.col("kept") != F.col("content"))
        if now.filter(hit).isEmpty() and changed.isEmpty():
            return False
        self._write(left.filter("trim(kept) <> '' or trim(content) = ''").select("seq", "section", F.col("kept").alias("content"), "created_at"))
        return True

    def clear(self) -> None:
        self._write(self.spark.createDataFrame([], self.SCHEMA))

    def save_version(self, description: str = "") -> int:
        """Copy the state as a version; returns its number."""
        number = (self._names("versions") or [0])[-1] + 1
        self.read().withColumn("description", F.lit(description)).write.parquet(f"{self.root}/versions/{number}")
        self.spark.createDataFrame([(number, description)], "version long, description string").withColumn("created_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{self.root}/about/{number}")
        return number

    def list_versions(self) -> DataFrame:
        """``version, description, created_at``, newest first."""
        schema = "version long, description string, created_at timestamp"
        found = [f"{self.root}/about/{n}" for n in self._names("about")]
        return (self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)).orderBy(F.desc("version"))

    def restore_version(self, number: int) -> None:
        """Make a version the state; the state of before is saved as a version first."""
        if number not in self._names("versions"):
            raise ValueError(f"no version {number}")
        self.save_version(f"before restoring {number}")
        self._write(self.spark.read.parquet(f"{self.root}/versions/{number}").select("seq", "section", "content", "created_at"))
