import numpy as np
import pytest
from tessera.operators import retrieval


@pytest.fixture(scope="module")
def index(spark):
    rows = [("d1", "alpha beta beta"), ("d2", "alpha gamma"), ("d3", "delta Beta epsilon zeta"), ("d4", "eta theta"), ("d5", "iota kappa lambda alpha"), ]
    return retrieval.Bm25Index.build(spark.createDataFrame(rows, "chunk_id string, text string"))


@pytest.mark.parametrize("query,expected", [
    ("Beta gamma", [("d2", 1.292485), ("d1", 0.480675), ("d3", 0.292585)]),
    ("alpha alpha", [("d2", 0.528744), ("d1", 0.449432), ("d5", 0.390811)]),
    ("nothing", []),
    ("", []),
])
def test_bm25_by_hand(spark, index, query, expected):
    got = index.search(spark.createDataFrame([(1, query)], "query_id long, query string"), 5).orderBy("rank").collect()
    assert [(r.id, pytest.approx(r.score, abs=1e-6)) for r in got] == expected


def test_bm25_statistics(index):
    corpus = index.corpus.first()
    assert corpus.n == 5 and corpus.avgdl == 3.0 and corpus.mean_idf == pytest.approx(0.898865, abs=1e-6)
    assert index.term_stats.filter("term = 'alpha'").first().idf == pytest.approx(0.224716, abs=1e-6)


def test_index_round_trip(spark, index, tmp_path):
    index.save(str(tmp_path))
    again = retrieval.Bm25Index.load(spark, str(tmp_path))
    asked = spark.createDataFrame([(1, "alpha"), (2, "beta")], "query_id long, query string")
    assert sorted(map(tuple, again.search(asked).collect())) == sorted(map(tuple, index.search(asked).collect()))


def test_fusion_by_hand(spark):
    v = spark.createDataFrame([(1, i + 1, x, 0.1 * i) for i, x in enumerate("abc")], "query_id long, rank int, id string, distance double")
    k = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate("cda")], "query_id long, rank int, id string")
    got = retrieval.fuse(v, k, 4).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("a", 0.03226646), ("c", 0.03226646), ("b", 0.01612903), ("d", 0.01612903)]
    assert got[3].distance is None


def test_cosine_neighbours_are_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8))
    x[5] = 0
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(900, None)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, x[0].tolist()), (2, x[3].tolist())], "query_id long, vector array<double>")
    got = retrieval.cosine_neighbours(df, asked, 7).collect()
    for q, row in ((1, 0), (2, 3)):
        norm = np.linalg.norm(x, axis=1) * np.linalg.norm(x[row])
        d = np.round(1 - x @ x[row] / np.where(norm > 0, norm, 1), 6)
        assert [r.id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == np.lexsort((np.arange(200), d))[:7].tolist()


def test_filters_after_ranking(spark):
    rows = spark.createDataFrame([(1, 1, "tests/test.py", 0.9), (1, 2, "src/main.py", 0.8), (1, 3, "src/a.js", 0.2)], "query_id long, rank int, source string, advanced_relevance double")
    assert [r.source for r in retrieval.keep_results(rows, 5, exclude_dirs=["tests/"]).orderBy("rank").collect()] == ["src/main.py", "src/a.js"]
    assert [r.source for r in retrieval.keep_results(rows, 5, [".py"], None, 0.85).collect()] == ["tests/test.py"]


def test_summary_hints(spark):
    rows = spark.createDataFrame([(1, "a", 0.9), (1, "b", None)], "query_id long, source string, distance double")
    r = retrieval.summary(rows, 100).first()
    assert r.coverage == "partial" and r.confidence == pytest.approx(0.55) and len(r.suggestions) == 2


def test_search_plan_filters_terms_before_counting(index, spark):
    asked = spark.createDataFrame([(1, "alpha")], "query_id long, query string")
    plan = index.search(asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_cosine_neighbours_on_dirty_rows_and_in_blocks(spark):
    bad = [(None, [1.0, 0.0]), (50, None), (51, [1.0, None]), (52, [float("nan"), 1.0]), (53, [1.0, 2.0, 3.0]), (54, []), (55, [float("inf"), 0.0])]
    rows = [(i, [float(i), 1.0]) for i in range(20)] + [(3, [3.0, 1.0])]
    df = spark.createDataFrame([(*r, 0.5) for r in rows + bad], "vec_id long, embedding array<double>, distance double")
    asked = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)] + [(90, [1.0, 2.0, 3.0])] + [(100 + i, v) for i, v in bad[1:] if i != 53] + [(None, [1.0, 1.0]), (4, [4.0, 1.0])], "query_id long, vector array<double>")
    whole = sorted(map(tuple, retrieval.cosine_neighbours(df, asked, 3).collect()))
    assert sorted(map(tuple, retrieval.cosine_neighbours(df, asked, 3, block=4).collect())) == whole
    assert {r[0] for r in whole} == {*range(20), 90} and [r for r in whole if r[0] == 90] == [(90, 1, 53, 0.0)]
    assert [r[2] for r in whole if r[0] == 3] == [3, 3, 4]
    assert retrieval.cosine_neighbours(df, asked.limit(0), 3).collect() == [] and retrieval.cosine_neighbours(df.limit(0), asked, 3).collect() == []


def test_searching_many_terms_by_a_shuffle(spark, index, monkeypatch):
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (None, "alpha"), (3, None)], "query_id long, query string")
    sent = sorted(map(tuple, index.search(asked).collect()), key=repr)
    monkeypatch.setattr(retrieval, "QUERY_TERMS", 1)
    assert sorted(map(tuple, index.search(asked).collect()), key=repr) == sent and sent
