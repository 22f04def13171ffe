"""Ranked retrieval: BM25 over an inverted index, exact cosine neighbours, reciprocal rank fusion, hybrid search."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.names import spare
from tessera.functions.text import advanced_relevance, simple_relevance, tokens
from tessera.sources.shared import stored

# Fixed values of the ranking formulas.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
#: Query vectors that are sent to the tasks at a time, and terms of queries that are sent at all.
QUERY_ROWS, QUERY_TERMS = 10_000, 200_000


def idf(df: Column, n: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


@dataclass
class Bm25Index:
    """Tables of an inverted index: ``postings(term, id, dl, tf)``, ``doc_stats(id, dl)``, ``term_stats(term, df, idf)``, ``corpus(n, avgdl, mean_idf)``."""

    postings: DataFrame
    doc_stats: DataFrame
    term_stats: DataFrame
    corpus: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> Bm25Index:
        words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("words")).withColumn("dl", F.size("words").cast("long"))
        postings = words.select("id", "dl", F.explode("words").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
        # Distinct words of a row count once, so document frequencies need no shuffle of all postings; one more entry of
        # each row, the null, brings the totals in the same pass. The counts are used four times,
        # so they are written once.
        entries = words.select("dl", F.explode(F.concat(F.array_distinct("words"), F.array(F.lit(None).cast("string")))).alias("term"))
        counted = stored(entries.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("length")), "terms")
        totals = counted.filter("term is null").agg(F.coalesce(F.max("df"), F.lit(0)).alias("n"), (F.max("length") / F.max("df")).alias("avgdl"))
        raw = counted.filter("term is not null").crossJoin(F.broadcast(totals)).select("term", "df", idf(F.col("df"), F.col("n")).alias("raw"))  # one row of totals
        mean = raw.agg(F.avg("raw").alias("mean_idf"))
        corpus = totals.crossJoin(mean)
        term_stats = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
        return cls(postings, words.select("id", "dl"), term_stats, corpus)

    def save(self, path: str) -> None:
        for name in ("postings", "doc_stats", "term_stats", "corpus"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bm25Index:
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in ("postings", "doc_stats", "term_stats", "corpus")))

    def search(self, queries: DataFrame, n: int = 5) -> DataFrame:
        """``query_id, rank, id, score`` of the n best of each query (``query_id, query``); scores of 0 or less are dropped after ranking.

        The terms are sent to the postings while there are at most ``QUERY_TERMS`` of them; else both are shuffled.
        """
        wanted = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        terms = wanted.select("term").distinct()
        sent = F.broadcast if wanted.limit(QUERY_TERMS + 1).count() <= QUERY_TERMS else (lambda df: df)
        met = self.postings.join(sent(terms), "term", "left_semi")  # pushed below the count of postings
        stats = self.term_stats.join(sent(terms), "term", "left_semi")
        part = met.join(sent(wanted), "term").join(stats, "term").crossJoin(F.broadcast(self.corpus))  # one row
        tf, norm = F.col("tf"), K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
        scored = part.groupBy("query_id", "id").agg(F.round(F.sum(F.col("qtf") * F.col("idf") * tf * (K1 + 1) / (tf + norm)), 6).alias("score"))
        return top(scored, n, F.desc("score"), F.col("id")).filter("score > 0")


def top(scored: DataFrame, n: int, *order: Column, by: str = "query_id") -> DataFrame:
    """The first n rows of each query with their rank; Spark limits groups before the shuffle."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.filter(F.col("rank") <= n)


def _clean(rows: DataFrame, id_col: str, vector_col: str, names: tuple[str, str]) -> DataFrame:
    """Rows with an id and a vector whose components are all numbers."""
    out = rows.select(F.col(id_col).cast("long").alias(names[0]), F.col(vector_col).cast("array<double>").alias(names[1]))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return out.filter(F.col(names[0]).isNotNull() & F.col(names[1]).isNotNull()).filter((F.size(names[1]) > 0) & F.forall(names[1], number))


_FOUND = "query_id long, id long, distance double"


def cosine_neighbours(vectors: DataFrame, queries: DataFrame, n: int, id_col: str = "vec_id", vector_col: str = "embedding", skip_self: bool = False, block: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, id, distance``: exact cosine neighbours of a stated query set (``query_id, vector``).

    The query set is sent to the tasks in blocks of about ``block`` rows of one length; each task keeps its n best per
    query, so that little is shuffled, and each block is one pass. Zero vectors have distance 1 from all. Rows and
    queries without an id, without a vector, or with a component that is null or not a finite number take no part; a
    query meets vectors of its own length alone; repeated rows are each a neighbour; a query_id that comes twice is
    searched once, with the first of its vectors; without queries there are no rows.
    """
    asked = _clean(queries, "query_id", "vector", ("query_id", "vector")).groupBy("query_id").agg(F.min("vector").alias("vector"))
    asked = stored(asked.withColumn("size", F.size("vector")), "queries")
    plain = _clean(vectors, id_col, vector_col, ("id", "vector"))
    found = vectors.sparkSession.createDataFrame([], _FOUND)
    for size, count in sorted((r["size"], r["count"]) for r in asked.groupBy("size").count().collect()):  # a row for each length
        parts = -(-count // block)
        for k in range(parts):
            rows = asked.filter((F.col("size") == size) & (F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k)).orderBy("query_id").collect()  # about `block`
            if rows:
                found = found.unionAll(plain.filter(F.size("vector") == size).mapInArrow(_nearest_of(vectors.sparkSession, rows, n, skip_self), _FOUND))
    return top(found, n, F.col("distance"), F.col("id")).select("query_id", "rank", "id", "distance")


def _nearest_of(spark: SparkSession, rows: list, n: int, skip_self: bool):
    unit = lambda x: x / np.where((norm := np.sqrt((x * x).sum(1, keepdims=True))) > 0, norm, 1)
    ids = np.array([r.query_id for r in rows], dtype=np.int64)
    asked = spark.sparkContext.broadcast(unit(np.array([r.vector for r in rows], dtype=float)))

    def run(batches):
        at, found, distance = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # the n best so far, by query
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            x = unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)) if len(own) else None
            for a in range(0, len(own), 4096):  # distances of a part of the rows to all queries at a time
                part = own[a : a + 4096]
                d = np.round(1 - x[a : a + 4096] @ asked.value.T, 6)
                if skip_self:
                    d[part[:, None] == ids] = np.inf
                # What is not worse than the n-th of the part, ties included, is merged; then the n best stay.
                near = (d <= np.partition(d, min(n, len(part)) - 1, axis=0)[min(n, len(part)) - 1]) & (d < np.inf)
                row, q = np.nonzero(near)
                at, found, distance = np.concatenate([at, q]), np.concatenate([found, part[row]]), np.concatenate([distance, d[row, q]])
                order = np.lexsort((found, distance, at))
                at, found, distance = at[order], found[order], distance[order]
                good = np.arange(len(at)) - np.searchsorted(at, at) < n
                at, found, distance = at[good], found[good], distance[good]
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(found), pa.array(distance)], names=["query_id", "id", "distance"])

    return run


def fuse(vector_side: DataFrame, keyword_side: DataFrame, n: int) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (``query_id, rank, id``): ``query_id, rank, id, score, distance``.

    Ties go to the better vector rank, then the better keyword rank. A hit of the keyword side alone has a null
    distance.
    """
    v = vector_side.select("query_id", "id", F.col("rank").alias("v_rank"), "distance")
    k = keyword_side.select("query_id", "id", F.col("rank").alias("k_rank"))
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    both = v.join(k, ["query_id", "id"], "full").withColumn("score", F.round(part("v_rank") + part("k_rank"), 8))
    ranked = top(both, n, F.desc("score"), F.asc_nulls_last("v_rank"), F.asc_nulls_last("k_rank"))
    return ranked.select("query_id", "rank", "id", "score", "distance")


def fetch_count(n: int) -> int:
    return min(3 * n, 50)


def hybrid(index: Bm25Index, vectors: DataFrame, text_queries: DataFrame, vector_queries: DataFrame, n: int = 5, filtered: bool = False, zero_distance: bool = False, **knn) -> DataFrame:
    """Both sides over-fetched and fused. With a filter set there is no keyword side.

    ``zero_distance`` gives keyword-only hits the distance 0, as the older behaviour had it.
    """
    if filtered:
        return cosine_neighbours(vectors, vector_queries, n, **knn).select("query_id", "rank", "id", F.lit(None).cast("double").alias("score"), "distance")
    many = fetch_count(n)
    out = fuse(cosine_neighbours(vectors, vector_queries, many, **knn), index.search(text_queries, many), n)
    return out.withColumn("distance", F.coalesce("distance", F.lit(0.0))) if zero_distance else out


def search_rows(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """Hits with their ``source`` and both relevances; a null distance counts as 0."""
    d = F.coalesce("distance", F.lit(0.0))
    return hits.join(sources.select("id", "source"), "id").select("query_id", "rank", "id", "source", "score", "distance", simple_relevance(d).alias("relevance"), F.round(advanced_relevance(d), 6).alias("advanced_relevance"), F.col("distance").isNull().alias("keyword_only"))


def summary(results: DataFrame, chunk_count: int) -> DataFrame:
    """One row per query: distinct files, mean distance, confidence, coverage and suggestions."""
    d = F.coalesce("distance", F.lit(0.0))
    out = results.groupBy("query_id").agg(F.count("*").alias("n_results"), F.countDistinct("source").alias("n_files"), F.round(F.avg(d), 6).alias("avg_distance"))
    out = out.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(1 - F.col("avg_distance"), 6)))).withColumn("coverage", F.lit("full" if chunk_count > 100 else "partial"))
    hints = F.array_compact(F.array(F.when(F.col("confidence") < 0.5, "refine the query"), F.when(F.col("n_files") < 3, "few files match"), F.when(F.col("coverage") == "partial", "the index is small")))
    return out.withColumn("suggestions", hints)


def keep_results(results: DataFrame, n: int, file_types: list[str] | None = None, exclude_dirs: list[str] | None = None, min_relevance: float = 0.0, path: str = "source") -> DataFrame:
    """Filters that come after the ranking, then the first n: fewer than n may be left.

    ``rank`` is given anew; rows whose path or relevance is null pass no filter on it. Other columns may have any name.
    """
    keep, before = F.lit(True), spare("first_rank", results)
    if min_relevance > 0:
        keep &= F.col("advanced_relevance") >= min_relevance
    if file_types:
        keep &= F.regexp_extract(path, r"(\.[^./]+)$", 1).isin(file_types)
    if exclude_dirs:
        keep &= ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d.rstrip("/")) for d in exclude_dirs]))
    left = results.filter(keep).withColumnRenamed("rank", before)
    return top(left, n, F.col(before)).drop(before)
