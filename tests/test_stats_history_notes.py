import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import history, incremental, notes, stats
from tessera.operators.contain import held_strings

NOW = datetime(2024, 5, 1, 12)


def test_tagged_lines(spark):
    text = "# TODO: x\n// fixme y\n#note z\n# TODOS\nplain"
    got = stats.tagged_lines(spark.createDataFrame([("a.py", text)], "path string, text string")).orderBy("line_no").collect()
    assert [(r.line_no, r.tag, r.text) for r in got] == [(1, "TODO", "x"), (2, "FIXME", "y"), (3, "NOTE", "z")]
    found = stats.tagged_lines(spark.createDataFrame([("a.py", text)], "path string, text string"))
    assert stats.tag_counts(found).filter("tag is null and path is null").first().n == 3


@pytest.mark.parametrize("names,style", [(["a_b.py", "c_d.py", "fooBar.js"], "snake_case"), (["fooBar.js"], "camelCase"), (["a_b.py", "fooBar.js", "x-y.js"], "kebab-case"), (["a_b.py", "fooBar.js"], "mixed"), (["Main.py"], "unknown")])
def test_naming(spark, names, style):
    assert stats.naming_style(spark.createDataFrame([(n,) for n in names], "path string")).first().style == style


def test_versions(spark):
    deps = spark.createDataFrame([("a", "==1"), ("b", ">=2"), ("c", ""), ("A", "<3")], "name string, version string")
    r = stats.version_classes(deps).first()
    assert (r.total, r.pinned, r.ranged, r.unpinned) == (4, 1, 2, 2)
    assert [x.name for x in stats.duplicate_names(deps).collect()] == ["a"]


def log(spark, rows):
    return spark.createDataFrame([(h, h[:7], m, a, d) for h, m, a, d in rows], "hash string, short_hash string, message string, author string, date timestamp")


def test_authors_and_windows(spark):
    commits = log(spark, [("recent1x", "fix crash", "Alice", NOW), ("h2", "more", "Alice", NOW - timedelta(days=1)), ("h3", "old crash", "Bob", NOW - timedelta(days=30))])
    assert {r.author: r.n for r in history.author_stats(commits).collect()} == {"Alice": 2, "Bob": 1}
    since = history.days_before(F.lit(NOW), 7)
    assert [r.short_hash for r in history.recent(commits, 30, since).collect()] == ["recent1", "h2"]
    assert [r.hash for r in history.mentioning(commits, "CRASH").collect()] == ["recent1x", "h3"]


def test_more_commits_than_shown(spark):
    commits = log(spark, [(f"h{i:02}", f"m{i}", "A", NOW - timedelta(hours=i)) for i in range(15)])
    r = history.by_author(commits, 5).first()
    assert r.messages == [f"m{i}" for i in range(5)] and r.more == 10


def test_take_while(spark):
    rows = spark.createDataFrame([(0, 9), (1, 8), (2, 3), (3, 9)], "pos int, date int")
    assert sorted(r.pos for r in history.take_while(rows, "pos", "date", 5).collect()) == [0, 1]


def test_latest_commit_of_each_path(spark):
    commits = log(spark, [("h1", "a", "A", NOW), ("h2", "b", "A", NOW - timedelta(days=1))])
    files = spark.createDataFrame([("h1", "x"), ("h2", "x"), ("h2", "y")], "hash string, path string")
    got = history.latest_per_path(commits, files, history.days_before(F.lit(NOW), 7))
    assert [(r.path, r.hash) for r in got.collect()] == [("x", "h1"), ("y", "h2")]


def test_sections(spark):
    doc = spark.createDataFrame([("n", "intro\n## One\na\nb\n## Two\n\nc")], "doc string, text string")
    assert {r.section: r.content.strip() for r in notes.sections(doc).collect()} == {"One": "a\nb", "Two": "c"}
    assert [r.line for r in notes.keyword_lines(doc, "INTRO").collect()] == ["intro"]


def test_unmentioned(spark):
    commits = spark.createDataFrame([("abc1234",), ("ffff000",), ("zz",)], "short string")
    texts = spark.createDataFrame([("saw [abc1234] and xzzy",)], "text string")
    assert [r.short for r in notes.unmentioned(commits, texts, "short").collect()] == ["ffff000"]


def test_note_store(spark, tmp_path):
    store = notes.NoteStore(spark, str(tmp_path / "n"))
    assert store.read().count() == 0
    assert store.update("first", "A") and not store.update(" first ", "A") and store.update("first", "B")
    with pytest.raises(ValueError):
        store.update("  ")
    one = store.save_version("before")
    assert store.delete_section("a") and not store.delete_section("nothing")
    assert [r.section for r in store.read().collect()] == ["B"]
    store.restore_version(one)
    assert store.read().count() == 2 and [r.version for r in store.list_versions().collect()] == [2, 1]
    with pytest.raises(ValueError):
        store.restore_version(99)
    store.clear()
    assert store.read().count() == 0


def test_changed_and_deleted(spark):
    stored = spark.createDataFrame([("old.py", 100.0), ("gone.py", 1.0)], "path string, mtime double")
    current = spark.createDataFrame([("old.py", 200.0), ("new.py", 1.0)], "path string, mtime double")
    assert sorted(r.path for r in incremental.changed(current, stored).collect()) == ["new.py", "old.py"]
    assert incremental.changed(stored, stored).count() == 0
    assert [r.path for r in incremental.deleted(current, stored).collect()] == ["gone.py"]


def test_batches_under_a_limit(spark):
    rows = spark.createDataFrame([(0, i, s) for i, s in enumerate([200, 200, 200, 900, 10])], "part int, seq long, size long")
    got = incremental.batch_numbers(rows, "size", 500).orderBy("seq").collect()
    assert [r.batch_no for r in got] == [0, 0, 1, 2, 3]
    total = incremental.chunk_totals(incremental.batch_numbers(rows, "size", 500)).first()
    assert (total.chunks, total.batches) == (5, 4)


def test_metadata(spark):
    empty = spark.createDataFrame([], "path string, mtime double, indexed_at timestamp")
    assert tuple(incremental.metadata_stats(empty).first()) == (0, None)
    two = spark.createDataFrame([("a", 1.0, datetime(2024, 1, 1, 10)), ("b", 1.0, datetime(2024, 1, 1, 11))], "path string, mtime double, indexed_at timestamp")
    assert tuple(incremental.metadata_stats(two).first()) == (2, datetime(2024, 1, 1, 11))


def test_unmentioned_looks_for_tokens_of_every_length(spark):
    from tessera.operators.notes import unmentioned

    texts = spark.createDataFrame([("a" * 80,)], "text string")
    entries = spark.createDataFrame([("a" * n,) for n in range(1, 73)] + [("zz",)], "token string")
    assert [r.token for r in unmentioned(entries, texts, "token").collect()] == ["zz"]


def test_unmentioned_against_brute_force(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab-c. é\n") for _ in range(rng.randrange(0, 40))) for _ in range(60)] + [None, "x" * 5000 + "ab-cd" + "y" * 200]
    tokens = ["".join(rng.choice("ab-c. é") for _ in range(rng.randrange(1, 5))) for _ in range(120)] + ["ab-cd", "", None, "x" * 120, "x" * 119 + "a", *("y" * n for n in range(1, 101))]
    entries = spark.createDataFrame([(t, i) for i, t in enumerate(tokens)] + [(tokens[0], 999)], "token string, string int")
    want = sorted(i for i, t in enumerate([*tokens]) if t is None or not any(t in x for x in texts if x is not None))
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    assert sorted(r.string for r in notes.unmentioned(entries, table, "token").filter("string < 999").collect()) == want
    assert notes.unmentioned(entries, table.limit(0), "token").count() == entries.count()
    found = held_strings(table.withColumn("id", F.monotonically_increasing_id()), "id", F.col("text"), entries)
    assert {r.string for r in found.collect()} == {t for t in tokens if t and any(t in x for x in texts if x is not None)}


def test_batches_keep_every_row(spark):
    rows = [("p", 2, 300), ("p", 1, 300), ("p", 1, 300), ("p", 3, None), (None, 1, 700), (None, 2, 600), ("q", None, 50)]
    out = incremental.batch_numbers(spark.createDataFrame([(*r, 9) for r in rows], "part string, seq long, size long, batch_no int"), "size", 600)
    assert sorted(((r.part or "", r.seq or 0, r.size or 0, r.batch_no) for r in out.collect())) == [("", 1, 700, 0), ("", 2, 600, 1), ("p", 1, 300, 0), ("p", 1, 300, 0), ("p", 2, 300, 1), ("p", 3, 0, 1), ("q", 0, 50, 0)]
    assert out.columns == ["part", "seq", "size", "batch_no"] and incremental.batch_numbers(out.limit(0), "size", 5).count() == 0


def test_long_names_and_headers(spark):
    long = "a" * 1500
    assert stats.naming_style(spark.createDataFrame([(f"{long}B.py",)], "path string")).first().camel == 1
    assert notes.parse(spark.createDataFrame([(1, "## " + long)], "doc int, text string")).first().header == long


@pytest.mark.parametrize("slab,bits,few", [(1 << 18, 1 << 27, 64), (7, 64, 0), (1 << 18, 1 << 27, 10_000)])
def test_held_strings_against_brute_force(spark, monkeypatch, slab, bits, few):
    """Strings of 1 to 100 characters, cut from texts or not; texts with characters of all planes, repeated rows and nulls."""
    from tessera.operators import contain

    monkeypatch.setattr(contain, "SLAB", slab)
    monkeypatch.setattr(contain, "MOST_BITS", bits)
    monkeypatch.setattr(contain, "FEW", few)
    rng = random.Random(slab)
    letters = "abAé\n \U0001f600\u0301"
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 40, 400]))) for _ in range(60)] + [None, "", "the end"]
    strings = {rng.choice(letters) for _ in range(5)} | {None, "", "never", "x" * 100, "the end"}
    for t in texts[:40]:
        for _ in range(4):
            a, n = rng.randrange(0, len(t or "") + 1), rng.randrange(1, 101)
            strings |= {(t or "")[a : a + n], (t or "")[a : a + n][::-1]}
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[2]), (3, texts[3])]
    asked = spark.createDataFrame([(s,) for s in sorted(strings, key=repr)] * 2, "s string")
    got = contain.held_strings(spark.createDataFrame(rows, "k int, t string"), "k", F.col("t"), asked)
    want = sorted(((k, s) for k, t in rows if t is not None for s in strings if s and s in t), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) > 500


def test_strings_that_share_their_grams_are_not_candidates_of_each_other(spark):
    """30,000 numbers of seven digits that begin alike: a text meets those that it holds, not all that share a gram with it."""
    from tessera.operators import contain

    numbers = [str(1_200_000 + i) for i in range(0, 60_000, 2)]
    text = " ".join(f"12{i:05d}" for i in range(0, 3000, 3))
    words = np.zeros(1 << 14, np.uint64)
    for batch in contain._whole_bits((1 << 20) - 1)([pa.RecordBatch.from_arrays([pa.array(numbers)], names=["s"])]):
        np.bitwise_or.at(words, batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64))
    held = {n for n in numbers if n in text}
    handed = [s for found in contain._pieces(text, words, [7]) for s in found]
    assert held <= set(handed) and len(handed) == len(set(handed)) < 1.2 * len(held)
    rows = spark.createDataFrame([(1, text), (1, text), (2, "12")], "k int, t string")
    asked = spark.createDataFrame([(n,) for n in numbers], "s string")
    for once in (False, True):
        got = [r.string for r in contain.held_strings(rows, "k", F.col("t"), asked, once=once).collect()]
        assert sorted(got) == sorted([*held] * (1 if once else 2))
