"""A stored index of vectors by k-means cells: searches open the cells near a query and rank their vectors exactly.

Vectors are dealt to the cell of the nearest centre (by angle) and written as a partition for each cell. How many cells a
search opens is measured when the index is built: the fewest for which a sample of rows finds the wanted share of its
true neighbours. Each cell knows its radius, the widest angle of a member to its centre, so no member is nearer to a query
than the query's angle to the centre less the radius: an exact search goes on to every cell that could still hold
something better. Rows come and go by changes (``sources.changes``), with the centres as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.retrieval import QUERY_ROWS, top
from tessera.sources.changes import Changes
from tessera.sources.shared import stored

#: Rows that centres are fitted on, rows that the number of probes is measured with, and most cells.
FITTED, MEASURED, MOST_CELLS = 50_000, 200, 4096
#: Rows of a cell to aim at in small tables, rows that a task holds before it cuts them to the best.
CELL_ROWS, HELD = 256, 50_000
#: The cell of zero vectors, which are at distance 1 from all.
NOWHERE = -1
SLACK = 1e-6


def cell_count(rows: int) -> int:
    """One cell for small tables, some CELL_ROWS in each of the next; of large ones the square root, MOST_CELLS at most."""
    return int(min(MOST_CELLS, max(1, min(rows // CELL_ROWS, 4 * rows**0.5))))


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(-1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _clean(rows: DataFrame, id_col: str, vector_col: str, kind: str, keep: list[str]) -> DataFrame:
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    out = rows.select(F.col(id_col).cast(kind).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), *keep)
    return out.filter(F.col("id").isNotNull() & F.col("vector").isNotNull()).filter((F.size("vector") > 0) & F.forall("vector", number))


class CellIndex(Changes):
    """An index of vectors (``id, vector``) below ``root``, with the columns ``keep`` (a DDL schema) for filters.

    Rows without an id, without a vector, or with a component that is null or not a finite number take no part, nor do
    vectors of another length than the first change's commonest. Of rows that share an id in a change one stays; a later
    change replaces it.
    """

    LAST = "cells"

    def __init__(self, spark, root: str, kind: str = "long", keep: str = "", version: int | None = None):
        super().__init__(spark, root, kind, version)
        self.keep = keep
        self.kept = spark.createDataFrame([], keep).columns if keep else []
        self.schema = f"id {kind}, vector array<double>" + (f", {keep}" if keep else "") + ", cell int"

    def _centres(self) -> tuple[np.ndarray, int] | None:
        """Unit vectors of the centres by cell, and how many cells a search opens."""
        found = self._folders()
        if not found:
            return None
        rows = self.spark.read.schema("cell int, centre array<double>, probes int").parquet(f"{self.root}/centres").orderBy("cell").collect()  # MOST_CELLS at most
        return np.array([r.centre for r in rows]), rows[0].probes

    def build(self, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.95, n: int = 10, seed: int = 42) -> int:
        """Fit the centres, write the rows as the first change, and measure how many cells find ``recall`` of the n nearest."""
        if self.last():
            raise ValueError("the index is there already: use change, or clear it")
        plain = stored(_clean(rows, id_col, vector_col, self.kind, self.kept), "vectors")
        sizes = plain.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
        dim, total = (sizes[0].size, sizes[0]["count"]) if sizes else (1, 0)
        fit = plain.filter((F.size("vector") == dim) & F.exists("vector", lambda x: x != 0)).orderBy(F.xxhash64("id", F.lit(seed))).limit(FITTED)
        fit = stored(fit.select(array_to_vector("vector").alias("features")), "fitted")
        k = cell_count(min(total, fit.count() * 4))
        # Rows in order of a hash are a sample of fixed size; the centres are fitted by tasks.
        made = KMeans(k=k, distanceMeasure="cosine", seed=seed, maxIter=15).fit(fit).clusterCenters() if k > 1 else [np.zeros(dim)]
        centres = unit(np.array(made))
        self._write_centres(centres, len(centres))
        number = self.change(plain, id_col="id", vector_col="vector")
        if k > 1:
            self._write_centres(centres, self._measured(centres, recall, n, seed))
        return number

    def _write_centres(self, centres: np.ndarray, probes: int) -> None:
        rows = [(i, c.tolist(), probes) for i, c in enumerate(centres)]
        self.spark.createDataFrame(rows, "cell int, centre array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/centres")

    def _measured(self, centres: np.ndarray, recall: float, n: int, seed: int) -> int:
        """The fewest cells, nearest first, that hold ``recall`` of the n nearest of a sample of the rows."""
        asked = self._rows().orderBy(F.xxhash64("id", F.lit(seed + 1))).limit(MEASURED).select(F.col("id").alias("query_id"), "vector")
        asked = stored(asked.withColumn("query_id", F.xxhash64("query_id")), "asked")
        found = self.search(asked, n, probes=len(centres))
        at = found.join(self._rows().select("id", "cell"), "id").join(asked, "query_id").select("vector", "cell").collect()  # MEASURED * n at most
        if not at:
            return len(centres)
        near = np.argsort(-(unit(np.array([r.vector for r in at])) @ centres.T), axis=1, kind="stable")
        rank = np.array([0 if r.cell == NOWHERE else int(np.flatnonzero(row == r.cell)[0]) for row, r in zip(near, at)])
        return int(np.sort(rank)[max(0, int(np.ceil(recall * len(rank))) - 1)]) + 1

    def change(self, added: DataFrame | None = None, removed: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> int:
        """Add or replace rows and take out others (ids in the first column of ``removed``); returns the change's number."""
        found = self.spark.read.schema("cell int, centre array<double>, probes int").parquet(f"{self.root}/centres").orderBy("cell").collect()
        centres, number = np.array([r.centre for r in found]), self.last() + 1
        at, dim = f"{self.root}/{number}", centres.shape[1]
        rows = self.spark.createDataFrame([], self.schema).drop("cell") if added is None else _clean(added, id_col, vector_col, self.kind, self.kept)
        rows = rows.filter(F.size("vector") == dim).dropDuplicates(["id"])
        sent = self.spark.sparkContext.broadcast(centres)

        def assign(batches):
            for batch in batches:
                x = unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                near = (x @ sent.value.T).argmax(1) if len(x) else np.zeros(0)
                cell = np.where((x != 0).any(1), near, NOWHERE).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

        dealt = rows.mapInArrow(assign, self.schema)
        # A cell's rows go to one task a part, so that a change writes few files; large cells are spread by a hash of the id.
        parts = max(1, dealt.sparkSession.sparkContext.defaultParallelism // len(centres))
        dealt.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(parts))).write.mode("overwrite").partitionBy("cell").parquet(f"{at}/vectors")
        new = self.spark.read.schema(self.schema).parquet(f"{at}/vectors")
        ids = new.select("id") if removed is None else new.select("id").union(removed.select(F.col(removed.columns[0]).cast(self.kind))).distinct()
        ids.write.mode("overwrite").parquet(f"{at}/gone")

        def radius(batches):
            for batch in batches:
                x, cell = unit(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)), batch.column(1).to_numpy()
                angle = np.arccos(np.clip((x * sent.value[np.maximum(cell, 0)]).sum(1), -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(angle)], names=["cell", "angle"])

        angles = new.select("vector", "cell").mapInArrow(radius, "cell int, angle double")
        angles.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).write.mode("overwrite").parquet(f"{at}/cells")
        return number

    def compact(self) -> int:
        """Write one folder for all there is; radii shrink to the rows that are left."""
        number = self.last()
        at = f"{self.root}/base-{number}"
        if not number or self._folders()[0][1] == at:
            return number
        self._rows().repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{at}/vectors")
        self.spark.createDataFrame([], f"id {self.kind}").write.mode("overwrite").parquet(f"{at}/gone")
        self._cells().groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).write.mode("overwrite").parquet(f"{at}/cells")
        return number

    def _rows(self) -> DataFrame:
        return self._live(self._all("vectors", self.schema)).drop("segment")

    def _cells(self) -> DataFrame:
        return self._all("cells", "cell int, n long, radius double").drop("segment")

    def search(self, queries: DataFrame, n: int, where: Column | None = None, probes: int | None = None, exact: bool = False, skip_self: bool = False) -> DataFrame:
        """``query_id, rank, id, distance``: cosine neighbours of a stated query set (``query_id, vector``), nearest first, ties by id.

        ``where`` is a condition on the kept columns, applied inside the cells before the n best are taken. A query that finds
        fewer than n in the nearest cells goes on to all others. ``exact`` goes on to every cell that could hold a better row.
        Queries are answered in blocks; those that a search would leave out take no part.
        """
        found = self.spark.createDataFrame([], f"query_id long, rank int, id {self.kind}, distance double")
        made = self._centres()
        if made is None:
            return found
        centres, usual = made
        radius = dict.fromkeys(range(len(centres)), None) | {r.cell: r.radius for r in self._cells().groupBy("cell").agg(F.max("radius").alias("radius")).collect()}  # a row for each cell
        asked = stored(_clean(queries, "query_id", "vector", "long", []).filter(F.size("vector") == centres.shape[1]).groupBy("id").agg(F.min("vector").alias("vector")), "queries")
        parts = -(-asked.count() // QUERY_ROWS)
        for part in range(parts):
            rows = asked.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).orderBy("id").collect()  # about QUERY_ROWS
            if rows:
                found = found.unionByName(self._block(rows, n, centres, radius, min(len(centres), probes or usual), where, exact, skip_self))
        return found

    def _block(self, rows: list, n: int, centres: np.ndarray, radius: dict, probes: int, where: Column | None, exact: bool, skip_self: bool) -> DataFrame:
        ids, x = [r.id for r in rows], unit(np.array([r.vector for r in rows]))
        angle = np.arccos(np.clip(x @ centres.T, -1, 1))
        live = np.array([radius[c] is not None for c in range(len(centres))])
        order = np.argsort(np.where(live, angle, np.inf), axis=1, kind="stable")[:, :probes]
        first = np.zeros(angle.shape, bool)
        np.put_along_axis(first, order, True, axis=1)
        ranked = self._scanned(ids, x, first & live, n, where, skip_self)
        if first[:, live].all():
            return ranked
        ranked = stored(ranked, "near")
        tops = {r.query_id: (r.n, r.far) for r in ranked.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("far")).collect()}  # a row for each query of the block
        reach = np.array([np.inf if tops.get(i, (0, 0))[0] < n else (np.arccos(np.clip(1 - tops[i][1], -1, 1)) + 1e-3 if exact else -np.inf) for i in ids])
        # 1e-3 covers the rounding of distances to six digits, which angles near zero magnify.
        wide = np.array([radius[c] if radius[c] is not None else 0.0 for c in range(len(centres))])
        more = ~first & live & (angle - wide <= reach[:, None] + SLACK)
        if not more.any():
            return ranked
        rest = self._scanned(ids, x, more, n, where, skip_self)
        return top(ranked.drop("rank").unionByName(rest.drop("rank")), n, F.col("distance"), F.col("id")).select("query_id", "rank", "id", "distance")

    def _scanned(self, ids: list[int], x: np.ndarray, probed: np.ndarray, n: int, where: Column | None, skip_self: bool) -> DataFrame:
        """The n nearest of each query in the cells that it probes; only partitions that some query probes are read."""
        of = {int(c): np.flatnonzero(probed[:, c]) for c in np.flatnonzero(probed.any(0))}
        of[NOWHERE] = np.arange(len(ids))
        rows = self._all("vectors", self.schema).filter(F.col("cell").isin(list(of)))
        rows = self._live(rows if where is None else rows.filter(where)).select("id", "vector", "cell")
        sent = self.spark.sparkContext.broadcast((np.array(ids, np.int64), x, of))

        def run(batches):
            names, q, of_cell = sent.value
            held, size = [], 0

            def best():
                every = pd.concat(held) if held else pd.DataFrame({"query_id": [], "id": [], "distance": []})
                return every.sort_values(["query_id", "distance", "id"], kind="stable").groupby("query_id").head(n)

            for batch in batches:
                own = batch.column(0).to_pandas()
                y = unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)) if len(own) else None
                cell = batch.column(2).to_numpy()
                for c in np.unique(cell):
                    at = np.flatnonzero(cell == c)
                    for a in range(0, len(at), 4096):
                        some = at[a : a + 4096]
                        d = np.round(1 - y[some] @ q[of_cell[int(c)]].T, 6) + 0.0  # no negative zero
                        if skip_self:
                            d[own.iloc[some].to_numpy()[:, None] == names[of_cell[int(c)]]] = np.inf
                        k = min(n, len(some)) - 1
                        r, col = np.nonzero((d <= np.partition(d, k, axis=0)[k]) & (d < np.inf))
                        held.append(pd.DataFrame({"query_id": names[of_cell[int(c)]][col], "id": own.iloc[some[r]].to_numpy(), "distance": d[r, col]}))
                        size += len(r)
                        if size > HELD:
                            held = [best()]
                            size = len(held[0])
            out = best()
            yield pa.RecordBatch.from_arrays([pa.array(out["query_id"], pa.int64()), pa.array(out["id"], _arrow(kind)), pa.array(out["distance"], pa.float64())], names=["query_id", "id", "distance"])

        kind = self.kind
        found = rows.mapInArrow(run, f"query_id long, id {self.kind}, distance double")
        return top(found, n, F.col("distance"), F.col("id")).select("query_id", "rank", "id", "distance")


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32()}.get(kind, pa.int64())
