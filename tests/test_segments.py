"""The segmented index against a full build, over random series of changes."""

import os
import random

import pytest

from tessera.operators import segments
from tessera.operators.retrieval import Bm25Index
from tessera.operators.segments import SegmentedIndex

QUERIES = [(1, "the and of"), (2, "rare17 w3 w3"), (3, "nothing there"), (4, ""), (5, "w1 w2 w4 rare2 the")]


def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id long, query string")


def text(rng):
    words = [f"w{i}" for i in range(40)] + ["the", "and", "of"] * 4 + [f"rare{i}" for i in range(30)]
    return " ".join(rng.choices(words, k=rng.randrange(0, 40)))


def table(spark, state):
    return spark.createDataFrame(sorted(state.items(), key=repr), "chunk_id string, text string")


def rows(found):
    return sorted((r.query_id, r["rank"], r.id, pytest.approx(r.score, abs=2e-6)) for r in found.collect())


def same(spark, index, state, n=7):
    full = Bm25Index.build(table(spark, state))
    assert rows(index.search(asked(spark), n)) == rows(full.search(asked(spark), n))
    got, want = index.corpus().first(), full.corpus.first()
    assert got.n == want.n and (not got.n or got.length / got.n == pytest.approx(want.avgdl)) and got.mean_idf == pytest.approx(want.mean_idf)
    assert {(r.term, r.df, round(r.idf, 6)) for r in index.term_stats().collect()} == {(r.term, r.df, round(r.idf, 6)) for r in full.term_stats.collect()}


def size(at):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(at) for f in names)


@pytest.mark.parametrize("block,named", [(256, 1000), (4, 2)])
def test_changes_equal_a_full_build(spark, tmp_path, monkeypatch, block, named):
    monkeypatch.setattr(segments, "BLOCK", block)
    monkeypatch.setattr(segments, "NAMED", named)
    monkeypatch.setattr(segments, "FIRST", 2)
    rng = random.Random(block)
    index, state = SegmentedIndex(spark, str(tmp_path / "index")), {}
    for step in range(5):
        added = {f"d{rng.randrange(120)}": text(rng) for _ in range(rng.choice([2, 60]))}
        removed = rng.sample(sorted(state), min(len(state), rng.choice([0, 1, 12]))) + ["never there"]
        removed = [i for i in removed if i not in added]
        index.change(table(spark, added), spark.createDataFrame([(i,) for i in removed], "id string"))
        state = {i: t for i, t in state.items() if i not in removed} | added
        if step in (1, 4):
            same(spark, index, state)
        if step == 2:
            before = rows(index.search(asked(spark), 5))
            index.compact()
            assert index.size() == 1 and rows(index.search(asked(spark), 5)) == before
    assert index.last() == 5


def test_odd_documents(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "index"), "long")
    assert index.search(asked(spark)).count() == 0 and index.last() == 0 and index.compact() == 0
    docs = [(1, "the a"), (2, None), (3, ""), (None, "the rare17 b"), (4, "x " * 3000), (5, "y z"), (6, "q"), (7, "r")]
    index.change(spark.createDataFrame([(t, i, "x") for i, t in docs], "body string, key int, id string"), id_col="key", text_col="body")
    assert index.corpus().first()[:2] == (8, 2 + 3 + 3000 + 4)
    assert {r.id for r in index.search(asked(spark)).filter("query_id = 1").collect()} == {1, None}
    index.change(removed=spark.createDataFrame([(None,), (4,)], "gone long"))
    assert index.corpus().first()[:2] == (6, 6) and {r.id for r in index.search(asked(spark)).filter("query_id = 1").collect()} == {1}
    assert {r.id for r in SegmentedIndex(spark, index.root, "long", version=1).search(asked(spark)).filter("query_id = 1").collect()} == {1, None}
    index.change()
    assert index.last() == 3 and index.corpus().first().n == 6
    index.clear()
    assert index.last() == 0


def test_a_broken_change_does_not_count(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "index"))
    index.change(table(spark, {"a": "the x", "b": "y", "c": "z", "d": "q"}))
    index.change(table(spark, {"a": "other"}))
    os.remove(tmp_path / "index/2/corpus/_SUCCESS")
    assert index.last() == 1 and {r.id for r in index.search(asked(spark)).filter("query_id = 1").collect()} == {"a"}
    index.change(table(spark, {"e": "the e"}))
    same(spark, index, {"a": "the x", "b": "y", "c": "z", "d": "q", "e": "the e"})


def test_small_changes_write_little_and_searches_skip_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 16)
    monkeypatch.setattr(segments, "FIRST", 3)
    rng = random.Random(3)
    state = {f"d{i}": "the " * rng.randrange(1, 4) + " ".join(rng.choices([f"w{k}" for k in range(3000)], k=rng.randrange(20, 300))) for i in range(1200)}
    for i in range(12):
        state[f"hot{i}"] = "w1 w2 w3 w1 w2 w3"
    index = SegmentedIndex(spark, str(tmp_path / "index"))
    index.change(table(spark, state))
    whole = size(tmp_path / "index/1")
    index.change(table(spark, {"d5": "w1 w2"}), spark.createDataFrame([("d6",)], "id string"))
    assert size(tmp_path / "index/2") < whole / 10
    queries = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w7")], "query_id long, query string")
    found = {r.query_id: r for r in index.opened(queries, 5).collect()}
    assert found[1].blocks > 50 and found[1].opened < found[1].blocks / 3
    state = {i: t for i, t in state.items() if i != "d6"} | {"d5": "w1 w2"}
    assert rows(index.search(queries, 5)) == rows(Bm25Index.build(table(spark, state)).search(queries, 5))
    plan = index.search(queries, 5)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan


def test_words_of_documents_are_not_moved_where_no_id_repeats(spark):
    from tessera.operators import segments

    docs = spark.createDataFrame([(i, f"a b{i} a") for i in range(50)] + [(None, "c")], "id long, text string")
    plain = segments.counted(docs, "id", "text")
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString() and plain.count() == 51
    twice = segments.counted(docs.union(docs.filter("id < 5 or id is null")), "id", "text")
    assert sorted(map(repr, twice.select("id", "dl").collect())) == sorted(map(repr, plain.select("id", "dl").collect()))


def test_an_index_takes_little_disk(spark, tmp_path, monkeypatch):
    """Ids and lengths are there once for each block, no table of postings is shuffled, and joins in passes lose nothing."""
    monkeypatch.setattr(segments, "NAMED", 2)
    monkeypatch.setattr(segments, "PASS", 1500)
    rng = random.Random(9)
    state = {f"d{i}": text(rng) for i in range(300)}
    index = SegmentedIndex(spark, str(tmp_path / "index"))
    index.change(table(spark, state))
    docs = spark.read.parquet(f"{index.root}/1/docs")
    assert "Exchange" not in segments.blocked(docs)._jdf.queryExecution().executedPlan().toString()
    postings = spark.read.parquet(f"{index.root}/1/postings")
    assert sum(len(r.ids) for r in postings.filter("term is null").collect()) == 300 and postings.filter("term is not null and ids is not null").isEmpty()
    new = {f"d{i}": text(rng) for i in range(0, 200, 2)}
    index.change(table(spark, new), spark.createDataFrame([(f"d{i}",) for i in range(1, 60, 2)], "id string"))
    state = {i: t for i, t in state.items() if i not in {f"d{k}" for k in range(1, 60, 2)}} | new
    before = rows(index.search(asked(spark), 7))
    index.compact()
    index.vacuum()
    assert [n for n in os.listdir(index.root) if not n.startswith(".")] == ["base-2"] and rows(index.search(asked(spark), 7)) == before
    same(spark, index, state)
