"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is ``span`` consecutive words of a benchmark item, or a whole shorter item. Of the k-gram hashes inside
every run of ``span`` words the smallest is kept (all of equal ones in documents), so a shared window always shares
its kept hash. Documents and windows meet on that hash; a meeting is then extended to the whole window by comparing
the words themselves, so hash collisions never count.

Words are compared in lower case of A-Z only. Hashes use the cheaper full lower case: it maps equal words to equal
hashes and leaves word borders where they are, so it only adds candidates, which the comparison removes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

SPAN = 10
GRAM = 5
#: Bytes of distinct benchmark windows up to which they are sent to every executor; beyond it they are shuffled.
BROADCAST_BYTES = 64 << 20
#: What a window takes besides its words.
ROW_BYTES = 80
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words as they are written; none for null."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), BREAKS), "")


def plain(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def _hashes(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _gram(hashes: str, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(hashes, at + i) for i in range(n)])


def _from_zero(count: Column) -> Column:
    """0 .. count-1; empty where count is not positive."""
    return F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def item_windows(items: DataFrame, span: int = SPAN) -> DataFrame:
    """``item_id, window``: the windows of each item, as often as they come."""
    words = items.select("item_id", words_of(F.col("text")).alias("words")).withColumn("total", F.size("words"))
    starts = F.when(F.col("total") >= span, _from_zero(F.col("total") - span + 1)).when(F.col("total") > 0, F.array(F.lit(0)))
    cut = words.select("item_id", "words", F.explode(starts).alias("start"))
    return cut.select("item_id", plain(F.array_join(F.slice("words", F.col("start") + 1, span), " ")).alias("window"))


def windows(items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``fp, offset, n, window``: each distinct window of ``item_windows``, its kept hash and where in it that hash stands."""
    distinct = items.select("window").distinct()
    hashed = distinct.select("window", _hashes(F.split("window", " ")).alias("h")).withColumn("n", F.size("h"))
    hashed = hashed.withColumn("grams", F.transform(_from_zero(F.lit(span - gram + 1)), lambda i: _gram("h", i, gram)))
    short = F.lit(None).cast("long")
    for n in range(1, span):
        short = F.when(F.col("n") == n, _gram("h", F.lit(0), n)).otherwise(short)
    full = F.col("n") == span
    return hashed.select(
        F.when(full, F.array_min("grams")).otherwise(short).alias("fp"),
        F.when(full, F.array_position("grams", F.array_min("grams")) - 1).otherwise(0).cast("int").alias("offset"),
        "n", "window",
    )


def _positioned(n: int) -> Column:
    """All n-grams with their positions."""
    return F.transform(_from_zero(F.col("n_words") - n + 1), lambda i: F.struct(i.alias("pos"), _gram("h", i, n).alias("fp")))


def _candidates(docs: DataFrame, lengths: list[int], span: int, gram: int) -> DataFrame:
    """The rows with ``words`` and ``found``: an array of (position, kept hash)."""
    run = span - gram + 1
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    base = base.withColumn("h", _hashes("words"))
    kept = F.array().cast("array<struct<pos:int,fp:long>>")
    if span in lengths:
        base = base.withColumn("g", F.transform(_from_zero(F.col("n_words") - gram + 1), lambda i: _gram("h", i, gram)))
        base = base.withColumn("low", F.transform(_from_zero(F.col("n_words") - span + 1), lambda i: F.least(*[F.get("g", i + j) for j in range(run)])))
        chosen = F.filter(_from_zero(F.col("n_words") - gram + 1), lambda p: F.get("g", p) == F.greatest(*[F.get("low", p - j) for j in range(run)]))
        base = base.withColumn("kept", F.transform(chosen, lambda p: F.struct(p.alias("pos"), F.get("g", p).alias("fp"))))
        kept = F.col("kept")
    parts = [kept]
    for n in sorted(set(lengths) - {span}):
        base = base.withColumn(f"short_{n}", _positioned(n))
        parts.append(F.col(f"short_{n}"))
    return base.select("doc_id", "text_hash", "n_words", "words", F.concat(*parts).alias("found"))


def _verified(rows: DataFrame, benchmark: DataFrame, how: str) -> DataFrame:
    """Meetings with ``start`` and ``hit``; ``words`` are those from word ``base`` on."""
    start = F.col("at.pos") - F.col("offset")
    met = rows.join(benchmark, F.col("at.fp") == F.col("fp"), how).withColumn("start", start)
    fits = (F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words"))
    same = plain(F.array_join(F.slice("words", F.col("start") - F.col("base") + 1, F.col("n")), " ")) == F.col("window")
    return met.withColumn("hit", F.coalesce(F.when(fits, same), F.lit(False)))


def around(rows: DataFrame, span: int, gram: int) -> DataFrame:
    """Rows with ``at``: in place of all words those that a window with its kept hash there can hold."""
    base = F.greatest(F.lit(0), F.col("at.pos") - (span - gram))
    return rows.withColumn("base", base).withColumn("words", F.slice("words", F.col("base") + 1, 2 * span - gram))


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, n_items, item_ids, contaminated``, and ``text_hash``.

    Reads ``doc_id, text`` and ``item_id, text``; other columns are ignored. Null and empty texts have no words and
    no hits; a null doc_id is kept; repeated rows give repeated results; an empty benchmark leaves all clean. Items
    of equal text share their windows; null item_ids are not listed. Windows are sent to the executors while they take
    at most ``broadcast_bytes``; else the documents that share a kept hash are found by a shuffle of hashes alone, and
    of these each kept hash is shuffled with the few words around it. Which items a window is of is looked up only for
    the windows that were hit.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    found = scratch.keep(item_windows(benchmark, span), "item-windows")
    table = scratch.keep(windows(found, span, gram).withColumn("window_id", F.monotonically_increasing_id()), "windows")
    owners = found.filter("item_id is not null").distinct().join(table.select("window", "window_id"), "window").select("window_id", "item_id")
    sizes = [r.n for r in table.select("n").distinct().collect()]  # at most `span` numbers
    taken = table.agg(F.coalesce(F.sum(F.octet_length("window") + ROW_BYTES), F.lit(0))).first()[0]
    rows = _candidates(docs, sizes, span, gram)
    # explode_outer throughout: for explode the optimiser infers a filter on the array and copies its whole expression.
    marker = F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("long").alias("fp"))
    key = ["doc_id", "text_hash", "n_words"]
    if taken <= broadcast_bytes:
        exploded = rows.select(*key, "words", F.lit(0).alias("base"), F.explode_outer(F.concat("found", F.array(marker))).alias("at"))
        met = _verified(exploded, F.broadcast(table), "left").filter("hit or at.pos = -1")
    else:
        flat = rows.select(*key, F.explode_outer("found").alias("at"))
        touched = flat.join(table.select("fp").distinct(), F.col("at.fp") == F.col("fp"), "left_semi").select("doc_id", "text_hash").distinct()
        touched = scratch.keep(touched, "touched").withColumnsRenamed({"doc_id": "d", "text_hash": "t"})
        hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
        some = hashed.join(touched, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left_semi").select("doc_id", "text")
        exploded = around(_candidates(some, sizes, span, gram).select(*key, "words", F.explode_outer("found").alias("at")), span, gram)
        names = [*key, "at", "start", "n", "window_id", "hit"]
        met = _verified(exploded, table, "inner").filter("hit").select(*names)
        plainly = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words_of(F.col("text"))).alias("n_words"))
        met = met.unionByName(plainly.withColumn("at", marker).withColumn("hit", F.lit(False)), allowMissingColumns=True)
    hit = F.col("hit")
    grouped = met.groupBy(*key).agg(
        F.count_if(F.col("at.pos") == -1).alias("copies"),
        F.array_sort(F.collect_set(F.when(hit, F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b"))))).alias("spans"),
        F.collect_set(F.when(hit, F.col("window_id"))).alias("window_ids"),
    )
    grouped = scratch.keep(grouped, "hits")
    listed = grouped.select(*key, F.explode("window_ids").alias("window_id")).join(owners, "window_id").select(*key, "item_id")
    both = grouped.drop("window_ids").unionByName(listed, allowMissingColumns=True)
    grouped = both.groupBy(*key).agg(F.max("copies").alias("copies"), F.max("spans").alias("spans"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda acc, x: F.struct(
            (acc.n + F.greatest(F.lit(0), x.b - F.greatest(x.a, acc.upto))).alias("n"), F.greatest(acc.upto, x.b).alias("upto")
        ),
        lambda acc: acc.n,
    )
    out = grouped.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"), "item_ids", (F.size("spans") > 0).alias("contaminated"), "text_hash", "copies",
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "copy")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """The rows of ``docs`` that hold no window of ``benchmark``, columns as given.

    Each row is judged by its own text: of rows that share a doc_id, or have none, the clean ones stay.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    bad = contamination(docs, benchmark, span).filter("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    bad = scratch.keep(bad, "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_hash"]), "left_anti")
