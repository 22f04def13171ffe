"""Null keys, repeated rows and clashing names in the index and note operators."""

from tessera.functions.names import spare
from tessera.operators import incremental, notes, retrieval


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_null_keys_are_keys(spark):
    schema = "path string, mtime double, _old string, _key int"
    current = spark.createDataFrame([("a", 2.0, "x", 1), ("b", 1.0, "y", 2), (None, 5.0, "z", 3), ("n", 1.0, "new", 4), ("t", None, "t", 5)], schema)
    stored = spark.createDataFrame([("a", 1.0), ("b", 1.0), (None, 5.0), ("gone", 1.0), ("t", 1.0), ("b", 0.5)], "path string, mtime double")
    found = incremental.changed(current, stored)
    assert found.columns == current.columns
    assert sorted(r.path for r in found.collect()) == ["a", "n", "t"]
    assert rows(incremental.changed(current, stored.filter("path is not null")).select("path")) == [("a",), ("n",), ("t",), (None,)]
    assert rows(incremental.deleted(current, stored).select("path")) == [("gone",)]
    assert rows(incremental.deleted(current.filter("path is not null"), stored).select("path")) == [("gone",), (None,)]


def test_a_null_stamp_that_is_stored_counts_as_changed(spark):
    current = spark.createDataFrame([("a", 2.0), ("b", 2.0)], "path string, mtime double")
    stored = spark.createDataFrame([("a", None), ("b", 3.0)], "path string, mtime double")
    assert rows(incremental.changed(current, stored)) == [("a", 2.0)]


def test_null_keys_are_replaced(spark):
    table = spark.createDataFrame([(None, 1), ("a", 1), ("b", 1), ("b", 2)], "source string, _key int")
    fresh = spark.createDataFrame([(None, 9), ("a", 9), ("a", 8)], "source string, _key int")
    assert rows(incremental.replaced(table, fresh, table.limit(0))) == rows(spark.createDataFrame([("b", 1), ("b", 2), (None, 9), ("a", 9), ("a", 8)], "source string, _key int"))
    assert rows(incremental.replaced(table, fresh.limit(0), fresh)) == [("b", 1), ("b", 2)]
    assert incremental.replaced(table.limit(0), fresh.limit(0), fresh.limit(0)).count() == 0


def test_newest_state_keeps_every_column(spark):
    states = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), (None, 1, "x"), (None, 3, "y")], "path string, indexed_at int, _r string")
    assert rows(incremental.newest_state(states)) == rows(spark.createDataFrame([("a", 2, "new"), (None, 3, "y")], states.schema))


def test_entries_without_a_section(spark):
    schema = "section string, content string"
    stored = spark.createDataFrame([(None, "same"), ("s", "same"), ("s", None)], schema)
    added = spark.createDataFrame([(None, " same "), ("s", "same"), ("t", "same"), (None, "other"), (None, "other"), ("s", " "), ("s", None)], schema)
    assert rows(notes.new_entries(stored, added)) == [("t", "same"), (None, "other")]
    assert notes.new_entries(stored, added.limit(0)).count() == 0


def test_results_with_clashing_names(spark):
    found = spark.createDataFrame([(1, 1, "a/x.py", 0.9, "p"), (1, 2, "b/y.js", 0.8, "q"), (1, 3, "a/z.py", 0.7, "r"), (1, 4, None, 0.6, "s")], "query_id int, rank int, source string, advanced_relevance double, first_rank string")
    kept = retrieval.keep_results(found, 5, file_types=[".py"])
    assert set(kept.columns) == set(found.columns)
    assert [(r.rank, r.first_rank) for r in kept.orderBy("rank").collect()] == [(1, "p"), (2, "r")]
    assert spare("A", found.select("rank").withColumnRenamed("rank", "a")) == "A_"
