"""A BM25 index in segments: a change writes what it brings, searches leave out blocks of documents that can't matter.

Each change is a folder with the terms of the documents that came (``docs``), the same by terms and blocks of documents
(``postings``), the ids that went or were replaced (``gone``), what this adds to the document frequencies (``terms``) and, last,
one row of totals (``corpus``); it counts once that is complete. A document counts if no later change names its id. ``compact``
writes a folder ``base-n`` that stands for all changes up to n; ``vacuum`` deletes the folders that it stands for.

A block holds up to BLOCK documents of similar length. Of each of its terms it knows the largest frequency, and of itself the
shortest document, which bound what the term can add to a score whatever the averages are by then. A search first scores the
blocks of the largest bounds; the n-th best score found there is a threshold, and a block whose bound is below it is
never opened.

Disk is what an index of a large table runs out of. A posting names its document by the place in the block, so ids and lengths
are there once. A task that has read documents writes the terms of its blocks by itself, sorted, with no shuffle; a table
that has to be joined whole is joined in up to PASSES passes, each of which deletes its shuffle files.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators.retrieval import EPSILON, K1, QUERY_TERMS, B, idf, top
from tessera.sources.changes import Changes
from tessera.sources.shared import dropped, shared_dir, stored, write_only

#: Documents of a block; blocks that a search scores first for each query.
BLOCK, FIRST = 256, 8
#: Postings of the blocks that a task sorts together; words that a task counts together.
GROUP, COUNTED = 2_000_000, 1_000_000
#: Words of an index that one pass of a join takes, and passes at most: as many times are its documents read.
PASS, PASSES = 16_000_000, 8
#: Ids and terms that are looked up by a filter that reaches the scan; more are joined.
NAMED = 1000

_CORPUS = "n long, length long, mean_idf double"
_TERMS = "term string, df long"


def counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, dl, terms, tfs`` of each document; of rows that share an id one stays, and only these are moved for that."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    more = docs.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("again"))
    if not more.isEmpty():
        again = stored(more, "again")
        same = docs["id"].eqNullSafe(again["again"])
        docs = docs.join(again, same, "left_anti").unionByName(docs.join(again, same, "left_semi").dropDuplicates(["id"]))
    rows = docs.select("id", tokens(F.col("text")).alias("words"))

    def run(batches):
        for batch in batches:
            for at, size in _pieces(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False), COUNTED):
                yield _one_count(batch.slice(at, size))

    return rows.mapInArrow(run, _docs(rows.schema["id"].dataType.simpleString()))


def _pieces(sizes: np.ndarray, most: int):
    """Ranges of rows with at most ``most`` items together, one row at least."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, upto - at
        at = upto


def _one_count(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The different words of each row, in the order in which they come, and how often."""
    dl, words = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).flatten()
    coded = words.dictionary_encode()
    key = np.repeat(np.arange(len(dl)), dl) * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    starts = _starts(key[order])
    first, tfs = order[starts], np.diff(np.append(starts, len(key)))
    again = np.argsort(first)
    first, tfs = first[again], tfs[again].astype(np.int32)
    offsets = pa.array(np.searchsorted(first, np.append(0, np.cumsum(dl))).astype(np.int32))
    terms = pc.binary_join(pa.ListArray.from_arrays(offsets, words.take(pa.array(first))), " ")
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(dl), terms, pa.ListArray.from_arrays(offsets, pa.array(tfs))], names=["id", "dl", "terms", "tfs"])


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where one of these sorted columns changes."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    changes = np.zeros(len(keys[0]), bool)
    changes[0] = True
    for k in keys:
        changes[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(changes)


def _docs(kind: str) -> str:
    """Terms are joined by spaces, which no term holds: a list of strings takes more room."""
    return f"id {kind}, dl long, terms string, tfs array<int>"


def _postings(kind: str) -> str:
    """Two kinds of rows. Of a block: its number, the ids and the lengths of its documents. Of a term: the number that its
    ``blocks`` count from, the largest frequency in each (``tops``), where its postings end (``ends``), and these: places of
    documents in their block (``at``) and frequencies."""
    return f"term string, block long, blocks array<int>, tops array<int>, ends array<int>, at array<smallint>, tfs array<int>, ids array<{kind}>, dls array<long>"


def blocked(docs: DataFrame) -> DataFrame:
    """The blocks of documents and their terms (``_postings``); terms are sorted in each stretch of rows, so that a scan can
    pass over the others."""
    kind, size, most = docs.schema["id"].dataType.simpleString(), BLOCK, GROUP

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held, count = [], 0
        for batch in batches:
            terms = pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, size):
                held.append(batch.slice(at, size))
                count += int(terms[at : at + size].sum())
                if count >= most:
                    table = pa.Table.from_batches(held)
                    yield from _blocks_of(table, number, size)
                    number, held, count = number + -(-table.num_rows // size), [], 0
        if held:
            yield from _blocks_of(pa.Table.from_batches(held), number, size)

    return docs.mapInArrow(run, _postings(kind))


#: Rows of terms that a task hands on at a time.
HANDED = 20_000


def _blocks_of(table: pa.Table, number: int, size: int):
    """Batches of ``_postings``: blocks of ``size`` documents, numbered from ``number``, and their terms."""
    table = table.take(pa.array(np.argsort(table.column("dl").to_numpy(), kind="stable"))).combine_chunks()
    whole = lambda name: pa.concat_arrays(table.column(name).chunks)
    cuts = pa.array(np.append(np.arange(0, table.num_rows, size), table.num_rows).astype(np.int32))
    n = len(cuts) - 1
    names = ["term", "block", "blocks", "tops", "ends", "at", "tfs", "ids", "dls"]
    ints, shorts = pa.list_(pa.int32()), pa.list_(pa.int16())
    none = [pa.nulls(n, k) for k in (ints, ints, ints, shorts, ints)]
    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.array(number + np.arange(n)), *none, pa.ListArray.from_arrays(cuts, whole("id")), pa.ListArray.from_arrays(cuts, whole("dl"))], names=names)

    lists = whole("tfs")
    row, tfs = np.repeat(np.arange(table.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten().to_numpy()
    words = pc.split_pattern(pc.filter(whole("terms"), pc.not_equal(whole("terms"), "")), " ").flatten()
    coded = words.dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int64)
    sort = pc.sort_indices(coded.dictionary)
    rank[sort.to_numpy()] = np.arange(len(rank))
    code = rank[coded.indices.to_numpy()]
    order = np.argsort(code, kind="stable")
    code, row, tfs = code[order], row[order], tfs[order]
    terms, block = _starts(code), row // size
    entries = _starts(code, block)
    tops = np.maximum.reduceat(tfs, entries).astype(np.int32) if len(entries) else tfs
    ends = np.append(entries[1:], len(code)) if len(entries) else entries
    ends = ends - terms[code[entries]]  # codes count up from 0, one for each term
    by_entry, by_posting = np.append(np.searchsorted(entries, terms), len(entries)), np.append(terms, len(code))
    sorted_terms = coded.dictionary.take(sort)
    for a in range(0, len(terms), HANDED):
        b = min(a + HANDED, len(terms))
        e, p = slice(by_entry[a], by_entry[b]), slice(by_posting[a], by_posting[b])
        e_cuts, p_cuts = pa.array((by_entry[a : b + 1] - by_entry[a]).astype(np.int32)), pa.array((by_posting[a : b + 1] - by_posting[a]).astype(np.int32))
        listed = lambda cuts, values, kind: pa.ListArray.from_arrays(cuts, pa.array(values.astype(kind)))  # noqa: E731, B023
        columns = [sorted_terms.slice(a, b - a), pa.array(np.full(b - a, number)), listed(e_cuts, block[entries[e]], np.int32), listed(e_cuts, tops[e], np.int32), listed(e_cuts, ends[e], np.int32)]
        columns += [listed(p_cuts, row[p] % size, np.int16), listed(p_cuts, tfs[p], np.int32), pa.nulls(b - a, pa.list_(table.schema.field("id").type)), pa.nulls(b - a, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _gain(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What an entry adds to a score for each unit of its term's weight: grows with ``tf``, falls with ``dl``."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


class SegmentedIndex(Changes):
    """An index below ``root`` over documents with ids of type ``kind``; ``version`` opens it as it was after that change.

    Ids are unique: of rows that share one in a change, one stays; a later change replaces it. Null is an id like any
    other; null and empty texts are documents without terms.
    """

    LAST = "corpus"

    def corpus(self) -> DataFrame:
        """One row: documents, their words, the mean weight of all terms."""
        found = self._folders()
        return self.spark.read.schema(_CORPUS).parquet(f"{found[-1][1]}/corpus") if found else self.spark.createDataFrame([(0, 0, None)], _CORPUS)

    def term_stats(self) -> DataFrame:
        """``term, df, idf`` of all terms there are."""
        return self._weighed(self._all("terms", _TERMS))

    def _weighed(self, deltas: DataFrame) -> DataFrame:
        df = deltas.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        raw = idf(F.col("df"), F.col("n"))
        return df.crossJoin(F.broadcast(self.corpus())).select("term", "df", F.when(raw < 0, EPSILON * F.col("mean_idf")).otherwise(raw).alias("idf"))  # one row

    def documents(self) -> DataFrame:
        """``id, dl, terms, tfs`` of the documents that count."""
        return self._live(self._all("docs", _docs(self.kind))).drop("segment").withColumn("terms", F.filter(F.split("terms", " "), lambda x: x != ""))

    # -- changes -------------------------------------------------------------------------------------------------

    def change(self, added: DataFrame | None = None, removed: DataFrame | None = None, id_col: str = "chunk_id", text_col: str = "text") -> int:
        """Add or replace documents (``added``) and take out others (ids in the first column of ``removed``).

        Returns the number of the change. A change that was broken off is written anew by the next.
        """
        number = self.last() + 1
        at = f"{self.root}/{number}"
        none = self.spark.createDataFrame([], f"id {self.kind}, text string")
        new = counted(none, "id", "text") if added is None else counted(added.withColumn(id_col, F.col(id_col).cast(self.kind)), id_col, text_col)
        new = self._write(new.sortWithinPartitions("id"), f"{at}/docs")
        ids = new.select("id")
        if removed is not None:
            ids = ids.union(removed.select(F.col(removed.columns[0]).cast(self.kind))).distinct()
        ids = self._write(ids, f"{at}/gone")
        postings = self._write(blocked(new), f"{at}/postings")
        old = self._named(ids)
        self._write(_less(_frequencies(postings), old).sortWithinPartitions("term"), f"{at}/terms")
        self._finish(at, new, old)
        dropped(old)
        return number

    def _write(self, rows: DataFrame, at: str, mode: str = "overwrite") -> DataFrame:
        """Write a table in the most compact form that Spark's readers take, and open it; the job's shuffle files go."""
        write_only(rows.write.mode(mode).option("compression", "zstd").option("parquet.writer.version", "v2"), self.spark, at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def _by_passes(self, rows, at: str) -> DataFrame:
        """The table of ``rows(condition)`` for conditions on ``id`` that divide all documents: a join of these in parts."""
        passes = min(PASSES, max(1, math.ceil((self.corpus().first().length or 0) / PASS)))
        for k in range(passes):
            out = self._write(rows(F.pmod(F.xxhash64("id"), F.lit(passes)) == k), at, "append" if k else "overwrite")
        return out

    def _named(self, ids: DataFrame) -> DataFrame:
        """The documents that count of those ids, stored; a few are looked up by a filter that reaches the scan."""
        few = [r.id for r in ids.limit(NAMED + 1).collect()]
        docs, at = self._all("docs", _docs(self.kind)), f"{shared_dir(self.spark)}/replaced-{uuid.uuid4().hex}"
        if len(few) <= NAMED:
            docs = docs.filter(F.col("id").isin([x for x in few if x is not None]) | (F.col("id").isNull() if None in few else F.lit(False)))
            return self._write(self._live(docs).drop("segment"), at)
        if not self._folders():
            return self._write(docs.drop("segment"), at)
        named = lambda part: ids.filter(part).select(F.col("id").alias("named"))
        return self._by_passes(lambda part: self._live(docs.filter(part).join(named(part), F.col("id").eqNullSafe(F.col("named")), "left_semi"), part).drop("segment"), at)

    def _finish(self, at: str, new: DataFrame, old: DataFrame) -> None:
        """The totals after a change: the deltas of documents and words, and the mean weight over the whole vocabulary."""
        sums = lambda df, sign: df.agg((sign * F.count("*")).alias("n"), (sign * F.coalesce(F.sum("dl"), F.lit(0))).alias("length"))
        totals = self.corpus().select("n", "length").unionAll(sums(new, 1)).unionAll(sums(old, -1)).agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
        terms = self._all("terms", _TERMS).select("term", "df").unionAll(self.spark.read.schema(_TERMS).parquet(f"{at}/terms"))
        df = terms.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        mean = df.crossJoin(F.broadcast(totals)).agg(F.avg(idf(F.col("df"), F.col("n"))).alias("mean_idf"))  # one row of totals
        self._write(totals.crossJoin(mean), f"{at}/corpus")

    def compact(self) -> int:
        """Write one folder for all there is, with new blocks; older folders are left for searches of older versions."""
        number = self.last()
        at = f"{self.root}/base-{number}"
        if not number or self._folders()[0][1] == at:
            return number
        every = self._all("docs", _docs(self.kind))
        docs = self._by_passes(lambda part: self._live(every.filter(part), part).drop("segment").sortWithinPartitions("id"), f"{at}/docs")
        self._write(blocked(docs), f"{at}/postings")
        self._write(self._all("terms", _TERMS).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0").sortWithinPartitions("term"), f"{at}/terms")
        self._write(docs.select("id").limit(0), f"{at}/gone")
        self._write(self.corpus(), f"{at}/corpus")
        return number

    def vacuum(self) -> None:
        """Delete the folders that the newest base stands for; versions before it can't be opened any more."""
        found = self._folders()
        if self.version is None and found and found[0][1].endswith(f"/base-{found[0][0]}"):
            path, system = self._system()
            names = [s.getPath().getName() for s in system.listStatus(path(self.root))]
            for name in names:
                if name.removeprefix("base-").isdigit() and int(name.removeprefix("base-")) <= found[0][0] and name != f"base-{found[0][0]}":
                    system.delete(path(f"{self.root}/{name}"), True)

    # -- searches ------------------------------------------------------------------------------------------------

    def _asked(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``query_id, term, weight`` of the terms of queries that the index has, and the entries of these terms by block."""
        wanted = stored(queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")), "wanted")
        terms = wanted.select("term").distinct()
        names = [r.term for r in terms.limit(QUERY_TERMS + 1).collect()]  # a bounded number
        if len(names) <= NAMED:
            only = lambda df: df.filter(F.col("term").isin(names) if names else F.lit(False))  # noqa: E731  reaches the scan
        else:
            sent = F.broadcast(terms) if len(names) <= QUERY_TERMS else terms
            only = lambda df: df.join(sent, "term", "left_semi")
        stats = self._weighed(only(self._all("terms", _TERMS)))
        asked = stored(wanted.join(stats, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")), "asked")
        return asked, only(self._all("postings", _postings(self.kind)))

    def _places(self) -> DataFrame:
        """``segment, block, ids, dls`` of the documents of each block, shortest first."""
        return self._all("postings", _postings(self.kind)).filter("term is null").select("segment", "block", "ids", "dls")

    def _bounds(self, asked: DataFrame, blocks: DataFrame, average: Column) -> DataFrame:
        """``query_id, segment, block, bound``: no document of the block scores more; lists of documents are not read."""
        gain = F.greatest(F.col("weight") * _gain(F.col("max_tf"), F.col("min_dl"), average), F.lit(0.0))
        listed = F.explode(F.transform("blocks", lambda b, i: F.struct((F.col("block") + b).alias("block"), F.get("tops", i).alias("max_tf"))))
        part = blocks.select("segment", "term", listed.alias("e")).select("segment", "term", "e.*").join(asked, "term")
        shortest = self._places().select("segment", "block", F.get("dls", F.lit(0)).alias("min_dl"))
        part = part.join(shortest, ["segment", "block"])
        return part.groupBy("query_id", "segment", "block").agg((F.sum(gain) + 1e-6).alias("bound")).filter("bound > 2e-6")

    def _scores(self, asked: DataFrame, blocks: DataFrame, which: DataFrame, average: Column) -> DataFrame:
        """``query_id, id, score`` of the documents of the blocks ``which`` (``query_id, segment, block``)."""
        def entry(b, i):
            start = F.coalesce(F.get("ends", i - 1), F.lit(0))
            size = F.get("ends", i) - start
            return F.struct((F.col("block") + b).alias("block"), F.slice("at", start + 1, size).alias("at"), F.slice("tfs", start + 1, size).alias("tfs"))

        listed = blocks.select("segment", "term", F.explode(F.transform("blocks", entry)).alias("e")).select("segment", "term", "e.*")
        entries = listed.join(asked, "term").join(which, ["query_id", "segment", "block"])
        opened = entries.join(self._places(), ["segment", "block"])
        posting = F.explode(F.transform("at", lambda a, i: F.struct(F.get("ids", a.cast("int")).alias("ids"), F.get("tfs", i).alias("tfs"), F.get("dls", a.cast("int")).alias("dls"))))
        flat = opened.select("query_id", "segment", "weight", posting.alias("e")).select("query_id", "segment", "weight", "e.ids", "e.tfs", "e.dls")
        live = self._live(flat.withColumnRenamed("ids", "id"))
        return live.groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") * _gain(F.col("tfs"), F.col("dls"), average)), 6).alias("score"))

    def _chosen(self, queries: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame, Column]:
        """The terms asked for, their blocks, ``query_id, segment, block, bound, first, taken`` of all blocks, the mean length."""
        asked, blocks = self._asked(queries)
        total = self.corpus().first()
        average = F.lit(float(total.length or 0) / total.n if total.n else 1.0)
        bounds = self._bounds(asked, blocks, average)
        ranked = stored(bounds.join(top(bounds, FIRST, F.desc("bound"), "segment", "block").select("query_id", "segment", "block", F.lit(True).alias("first")), ["query_id", "segment", "block"], "left"), "bounds")
        first = self._scores(asked, blocks, ranked.filter("first").select("query_id", "segment", "block"), average)
        best = top(first.filter("score > 0"), n, F.desc("score")).groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("least"))
        least = F.when(F.col("found") == n, F.col("least")).otherwise(F.lit(0.0))
        taken = F.col("bound") >= F.coalesce(least, F.lit(0.0))
        return asked, blocks, ranked.join(best, "query_id", "left").select("query_id", "segment", "block", "bound", F.coalesce("first", F.lit(False)).alias("first"), taken.alias("taken")), average

    def search(self, queries: DataFrame, n: int = 5) -> DataFrame:
        """``query_id, rank, id, score`` of the n best of each query (``query_id, query``), as a full build ranks them.

        Scores of 0 or less are left out, ties go by id. Blocks whose bound is below the n-th best score of the first blocks
        are not opened.
        """
        asked, blocks, chosen, average = self._chosen(queries, n)
        scores = self._scores(asked, blocks, chosen.filter("taken").select("query_id", "segment", "block"), average)
        return top(scores.filter("score > 0"), n, F.desc("score"), F.col("id")).select("query_id", "rank", "id", "score")

    def opened(self, queries: DataFrame, n: int = 5) -> DataFrame:
        """``query_id, blocks, opened``: how many blocks hold terms of a query, and how many of these a search opens."""
        chosen = self._chosen(queries, n)[2]
        return chosen.groupBy("query_id").agg(F.count("*").alias("blocks"), F.count_if("taken").alias("opened"))


def _frequencies(postings: DataFrame) -> DataFrame:
    """``term, df``, a row for each stretch of blocks."""
    return postings.filter("term is not null").select("term", F.element_at("ends", -1).cast("long").alias("df"))


def _less(frequencies: DataFrame, old: DataFrame) -> DataFrame:
    """``term, df``: the frequencies without those of the documents ``old``."""
    words = old.select(F.explode(F.split("terms", " ")).alias("term")).filter("term <> ''")
    gone = words.groupBy("term").agg((-F.count("*")).alias("df"))
    return frequencies.unionByName(gone).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
