"""Ranked lexical search by the three phases of a uniform threshold (TPUT) over term-partitioned postings.

The postings of the terms asked for are one table in order of term and falling score, so a frequent term's list lies in
many partitions. First the heads of all lists give each item a lower bound: the k-th best of its partial sums. An entry
below that bound divided by the number of the item's lists can't lift a document over it by itself, so the second phase
takes from each list only what is above this threshold, sums it by document, and keeps the documents that could still be
among the k best. The third looks up all entries of these and ranks them by their exact scores.

Lists travel to documents once, whatever the number of items that ask for them: the items' terms and thresholds, a block
of bounded size, are sent to the tasks, and these hold sums for all items of the block.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, utf8_rows
from tessera.llm.packed import starts_of, whole_groups

#: Pairs of item and term that are answered in one run, about; an item's terms stay together.
BLOCK = 200_000
#: Entries of a list's head, in units of k.
HEAD = 20
#: Candidates' rows that are sent to the tasks; more are shuffled.
SENT = 500_000
#: Sums that a task holds at a time, and postings it adds at a time.
CELLS, ROWS = 4 << 20, 1 << 16

_BREAKS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes.maketrans(_BREAKS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(_BREAKS) + b"abcdefghijklmnopqrstuvwxyz")
# Of the capitals, which stand among the breaks' neighbours, only A-Z become small letters; all else is kept byte by byte.


def terms_of(text: bytes) -> list[bytes]:
    """Terms in order, repeats included: runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case."""
    return text.translate(_TABLE).split()


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term``: the different terms of each item; rows of one item_id are one item."""

    def run(batches):
        for batch in batches:
            found = [sorted(set(terms_of(t))) for t in utf8_rows(batch.column(1))]
            at = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([t.decode("utf-8", "replace") for x in found for t in x], pa.string())], names=["item_id", "term"])

    rows = items.select("item_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"item_id {kind}, term string").distinct()


_COUNTED = "term int, row long, doc_id long, tf long, n long"


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``term, row, doc_id, tf, n`` for each term of the vocabulary that a row of ``docs`` holds; ``n`` is the row's number of terms.

    ``row`` tells rows apart, whatever their doc_id. A row with term -1 has in ``tf`` the documents with terms and in
    ``n`` all their terms, for each part of the table.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        number = held.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            terms, rows, tfs, ids, ns = [], [], [], [], []
            documents = total = 0
            for key, text in zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1))):
                row += 1
                words = terms_of(text)
                if not words:
                    continue
                documents += 1
                total += len(words)
                found = Counter(filter(number.__contains__, words))
                terms += map(number.__getitem__, found)
                tfs += found.values()
                rows += [row] * len(found)
                ids += [key] * len(found)
                ns += [len(words)] * len(found)
            sums = [[-1], [None], [None], [documents], [total]]
            yield pa.RecordBatch.from_arrays([pa.array(a + b, t) for a, b, t in zip((terms, rows, ids, tfs, ns), sums, (pa.int32(), *[pa.int64()] * 4))], names=["term", "row", "doc_id", "tf", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _COUNTED)


def scored(entries: DataFrame) -> DataFrame:
    """``term, impact, row, doc_id`` of entries with a score above zero: what a term adds to a document's score."""
    total = entries.filter("term = -1").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    plain = entries.filter("term >= 0")
    if not total.words:
        return plain.select("term", F.lit(0).cast("long").alias("impact"), "row", "doc_id").limit(0)
    df = plain.groupBy("term").agg(F.count("*").alias("df"))
    w = F.floor(1000 * F.log((2 * F.lit(total.docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = F.broadcast(df.select("term", w.alias("w")))  # as many as the vocabulary of a block
    m = f"(10 + (90L * n * {total.docs}L) div {total.words}L)"
    impact = F.expr(f"w * ((1000000000L * tf) div (1000L * tf + 8L * {m}))")
    return plain.join(weights, "term").select("term", impact.alias("impact"), "row", "doc_id").filter("impact > 0")


def _first(rows: DataFrame, by: str, k: int, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


class _Lists:
    """The lists of a block's items, by term: which items ask for a term, and from which score on."""

    def __init__(self, pairs: list[tuple[int, int]], n_items: int, n_terms: int, bounds: dict[int, int]):
        made = np.array(sorted((t, i) for i, t in pairs), np.int64).reshape(-1, 2)
        self.items = made[:, 1]
        self.starts = np.searchsorted(made[:, 0], np.arange(n_terms + 1))
        self.count = np.bincount(self.items, minlength=n_items).astype(np.int64)
        self.bound = np.array([bounds.get(i, 0) for i in range(n_items)], np.int64)
        self.least = self.bound // np.maximum(self.count, 1)

    def least_of_terms(self) -> list[tuple[int, int]]:
        """Of each term the least threshold of the items that ask for it."""
        return [(t, int(self.least[self.items[a:b]].min())) for t, (a, b) in enumerate(zip(self.starts[:-1], self.starts[1:])) if b > a]

    def sums(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Partial sums by row and item of the entries above the thresholds, and from how many lists they come."""
        size = self.starts[term + 1] - self.starts[term]
        at = np.repeat(np.arange(len(term)), size)
        inside = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        item = self.items[self.starts[term[at]] + inside]
        value = impact[at]
        good = value >= self.least[item]
        cell = row[at[good]] * len(self.count) + item[good]
        shape = n_rows, len(self.count)
        # Sums stay far below 2 to the power of 53, so doubles hold them exactly.
        return np.bincount(cell, value[good], n_rows * len(self.count)).astype(np.int64).reshape(shape), np.bincount(cell, minlength=n_rows * len(self.count)).reshape(shape)


def _candidates(lists, k: int):
    """``item, row, partial, most`` of the rows that may be among the k best of an item, from entries sorted by row."""

    def run(batches):
        own = lists.value
        best = np.zeros((k, len(own.count)), np.int64)
        step = max(1, CELLS // len(own.count))
        for table in whole_groups(batches, ROWS):
            rows, cuts = starts_of(table.column(0).to_numpy())
            term, impact = table.column(1).to_numpy(), table.column(2).to_numpy()
            for at in range(0, len(rows), step):
                upto = min(len(rows), at + step)
                a, b = cuts[at], cuts[upto]
                local = np.repeat(np.arange(upto - at), np.diff(cuts[at : upto + 1]))
                partial, seen = own.sums(local, term[a:b], impact[a:b], upto - at)
                best = np.sort(np.concatenate([best, partial]), axis=0)[-k:]
                most = partial + (own.count - seen) * np.maximum(own.least - 1, 0)
                x, item = np.nonzero((seen > 0) & (most >= np.maximum(own.bound, best[0])))
                yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(rows[at:upto][x]), pa.array(partial[x, item]), pa.array(most[x, item])], names=["item", "row", "partial", "most"])

    return run


def _block(docs: DataFrame, wanted: list, k: int, head: int, scratch: Scratch) -> DataFrame:
    """The ranking of the items of one block; ``wanted`` has their pairs of item_id and term."""
    spark = docs.sparkSession
    names = list(dict.fromkeys(r.item_id for r in wanted))
    item_no = {x: i for i, x in enumerate(names)}
    term_no = {t: i for i, t in enumerate(sorted({r.term for r in wanted}))}
    pairs = [(item_no[r.item_id], term_no[r.term]) for r in wanted]
    asked = F.broadcast(spark.createDataFrame(pairs, "item int, term int"))  # one block

    entries = scratch.keep(counted(docs, {t.encode(): i for t, i in term_no.items()}), "counted")
    postings = scratch.keep(scored(entries).orderBy("term", F.desc("impact"), "row"), "postings")

    # Heads of all lists: lower bounds of the items.
    heads = _first(postings.select("term", "impact", "row"), "term", head * k, F.desc("impact"), "row")
    partial = heads.join(asked, "term").groupBy("item", "row").agg(F.sum("impact").alias("partial"))
    tops = _first(partial, "item", k, F.desc("partial"), "row").groupBy("item").agg(F.count("*").alias("n"), F.min("partial").alias("bound"))
    bounds = {r["item"]: r["bound"] for r in tops.collect() if r["n"] == k}  # a row for each item of the block

    # Entries above the threshold of some item, by document.
    made = _Lists(pairs, len(names), len(term_no), bounds)
    least = F.broadcast(spark.createDataFrame(made.least_of_terms(), "term int, least long"))  # a row for each term of the block
    fetched = postings.join(least, "term").filter("impact >= least").select("row", "term", "impact")
    lists = spark.sparkContext.broadcast(made)
    dealt = fetched.repartition("row").sortWithinPartitions("row")
    found = scratch.keep(dealt.mapInArrow(_candidates(lists, k), "item int, row long, partial long, most long"), "candidates")
    kth = _first(found.select("item", "row", "partial"), "item", k, F.desc("partial"), "row").groupBy("item").agg(F.count("*").alias("found"), F.min("partial").alias("kth"))
    live = scratch.keep(found.join(F.broadcast(kth), "item").filter((F.col("found") < k) | (F.col("most") >= F.col("kth"))).select("item", "row"), "live")

    # Exact scores of the candidates.
    rows = live.select("row").distinct()
    few = rows.limit(SENT + 1).count() <= SENT
    own = postings.join(F.broadcast(rows) if few else rows, "row", "left_semi")
    exact = own.join(asked, "term").join(F.broadcast(live) if few and live.limit(SENT + 1).count() <= SENT else live, ["item", "row"])
    scores = exact.groupBy("item", "row", "doc_id").agg(F.sum("impact").alias("score"))
    ranked = _first(scores, "item", k, F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return scratch.keep(ranked.select("item", "rank", "doc_id", "score"), "ranked"), names


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, head: int = HEAD, block: int = BLOCK) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best rows of ``docs`` (``doc_id, text``) for each item (``item_id, text``).

    Scores are those of the registered query's contract, in 64-bit integers; scores of zero are left out, and equal ones go
    by doc_id, nulls last. Every row is a document of its own, with or without a doc_id and whatever its copies; null
    and empty texts have no terms and don't count. Rows of one item_id, null too, are one item; items without terms and
    empty tables give no rows. Items are answered in blocks of about ``block`` pairs of item and term; each block is one
    pass over the texts. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    asked = scratch.keep(item_terms(items), "items")
    kind = asked.schema["item_id"].dataType
    parts = max(1, -(-asked.count() // block))
    out = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    for part in range(parts):
        wanted = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()  # about a block
        if not wanted:
            continue
        ranked, names = _block(docs, wanted, k, head, scratch)
        named = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {kind.simpleString()}")
        out = out.unionAll(ranked.join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score"))  # names of a block
    return scratch.finish(out, "ranked")
