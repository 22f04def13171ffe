"""The stored vector index against the exact scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cells
from tessera.operators.cells import CellIndex, cell_count
from tessera.operators.retrieval import cosine_neighbours


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    around = rng.normal(size=(30, 12))
    x = around[rng.integers(0, 30, 3000)] + 0.6 * rng.normal(size=(3000, 12))
    x[7] = 0
    x[11] = x[12]
    rows = [(i, v.tolist(), i % 5) for i, v in enumerate(x)] + [(5000, None, 1), (5001, [float("nan")] * 12, 1), (None, x[3].tolist(), 1), (5002, [1.0, 2.0], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").cache()


def asked(table, n=40):
    return table.filter(f"vec_id % {3000 // n} = 0 and vec_id < 3000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def rows(found):
    return sorted((r.query_id, r["rank"], r.id, r.distance) for r in found.collect())


def recall(got, want):
    pairs = lambda rows: {(q, i) for q, _, i, _ in rows}
    return len(pairs(got) & pairs(want)) / len(want)


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    made = CellIndex(spark, str(tmp_path_factory.mktemp("cells")), keep="label int")
    made.build(table, n=10)
    return made


def test_recall_and_pruned_partitions(spark, table, index):
    centres, probes = index._centres()
    assert len(centres) == cell_count(3000) == 11 and probes < len(centres)
    want = rows(cosine_neighbours(table.filter("size(embedding) = 12"), asked(table), 10))
    assert recall(rows(index.search(asked(table), 10)), want) >= 0.95
    one = cells.unit(np.array([table.filter("vec_id = 75").first().embedding]))
    near = np.argsort(-(one @ centres.T)[0])[:2]
    probed = np.isin(np.arange(len(centres)), near)[None, :]
    plan = index._scanned([75], one, probed, 10, None, False)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan
    read = index.spark.read.parquet(f"{index.root}/1/vectors").select("cell").distinct().count()
    assert read == len(centres) + 1  # with the zero vector's


def test_exact_searches_equal_the_scan(spark, table, index):
    plain = table.filter("size(embedding) = 12")
    assert rows(index.search(asked(table), 10, exact=True, probes=1)) == rows(cosine_neighbours(plain, asked(table), 10))
    assert rows(index.search(asked(table), 10, exact=True, skip_self=True)) == rows(cosine_neighbours(plain, asked(table), 10, skip_self=True))
    some = F.col("label") == 3
    assert rows(index.search(asked(table), 10, where=some, exact=True, probes=1)) == rows(cosine_neighbours(plain.filter(some), asked(table), 10))


def test_a_narrow_filter_goes_on_to_other_cells(table, index):
    rare = F.col("id").isin([3, 500, 900, 1400, 2999])
    found = rows(index.search(asked(table), 10, where=rare, probes=1))
    assert {q: sum(r[0] == q for r in found) for q in {r[0] for r in found}} == {q: 5 for q in range(0, 3000, 75)}


def test_changes(spark, table, tmp_path):
    plain = table.filter("size(embedding) = 12")
    index = CellIndex(spark, str(tmp_path / "index"), keep="label int")
    index.build(plain.filter("vec_id < 2000"))
    index.change(plain.filter("vec_id between 2000 and 2999"))
    moved = plain.filter("vec_id < 40").withColumn("embedding", F.transform("embedding", lambda x: -x))
    index.change(moved, spark.createDataFrame([(100,), (777_777,)], "id long"))
    now = plain.filter("vec_id >= 40 and vec_id <> 100").unionByName(moved)
    assert rows(index.search(asked(table), 8, exact=True)) == rows(cosine_neighbours(now, asked(table), 8))
    before = rows(index.search(asked(table), 8, exact=True))
    index.compact()
    assert index.size() == 1 and rows(index.search(asked(table), 8, exact=True)) == before
    with pytest.raises(ValueError):
        index.build(plain)


def test_small_empty_and_text_ids(spark, tmp_path):
    index = CellIndex(spark, str(tmp_path / "a"), kind="string")
    none = spark.createDataFrame([], "vec_id string, embedding array<double>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert index.search(one, 3).count() == 0
    index.build(none)
    assert index.search(one, 3).count() == 0
    index = CellIndex(spark, str(tmp_path / "b"), kind="string")
    index.build(spark.createDataFrame([("a", [1.0, 0.1]), ("b", [0.0, 1.0]), ("b2", [0.0, 1.0]), ("z", [0.0, 0.0])], "vec_id string, embedding array<double>"))
    assert [(r[1], r[2]) for r in rows(index.search(one, 4))] == [(1, "a"), (2, "b"), (3, "b2"), (4, "z")]
    assert cells.cell_count(0) == cells.cell_count(100) == 1 and cells.cell_count(10**9) == cells.MOST_CELLS
