import random

import pytest

from tessera.llm.decontaminate import _candidates, around, contamination, drop_contaminated

KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B))


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if ord(c) in KEEP or ord(c) > 0x7F else " " for c in low).split(" ")


def brute(docs, items, span):
    out = []
    cut = []
    for item, text in items:
        w = [x for x in words(text) if x]
        n = min(span, len(w))
        cut += [(item, tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n]
    for doc, text in docs:
        w = [x for x in words(text) if x]
        hit, found = set(), set()
        for item, window in set(cut):
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found.add(item)
        out.append((doc, len(w), len(hit), tuple(sorted(found)), bool(hit)))
    return sorted(out, key=repr)


def case(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "été", "Été", "x1", "İs", "K", "zz", "the", "q"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([0, 2, 5, 9, 10, 12, 30]))) for i in range(12)] + [(90, None), (91, ""), (92, "a")]
    items += [(93, items[0][1]), (94, "b B b b b b b b b b b b")]
    docs = [(i, text(rng.choice([0, 1, 4, 9, 40, 200]))) for i in range(30)]
    docs += [(100 + i, text(7) + " " + (items[i][1] or "").upper().replace("É", "é") + " " + text(9)) for i in range(12)]
    docs += [(200, None), (201, ""), (202, "B " * 40), (None, items[3][1]), (7, docs[7][1]), (300, text(4000))]
    return docs, items


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_against_brute_force(spark, broadcast):
    docs, items = case(5 + bool(broadcast))
    got = contamination(spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, items string, n int"), spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=broadcast).collect()
    have = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in got), key=repr)
    assert have == brute(docs, items, 10)


def test_every_shared_span_is_found(spark):
    rng = random.Random(9)
    item = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(51):
        before = [f"p{rng.randrange(50)}" for _ in range(rng.randrange(12))]
        docs.append((i, " ".join(before + item[i : i + 10] + ["z"])))
    docs.append((99, " ".join(item[:9] + ["q"] + item[10:19])))
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id: r.n_hit for r in got} == {**{i: 10 for i in range(51)}, 99: 0}


def test_shuffled_rows_do_not_grow_with_the_text(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(n, " ".join(f"w{i % 89}" for i in range(n))) for n in (200, 20_000)], "doc_id long, text string")
    rows = around(_candidates(docs, [10], 10, 5).select("doc_id", "words", F.explode_outer("found").alias("at")), 10, 5)
    found = {r.doc_id: r for r in rows.groupBy("doc_id").agg(F.max(F.size("words")).alias("most"), F.count("*").alias("n")).collect()}
    assert {r.most for r in found.values()} == {15} and found[20_000].n < 110 * found[200].n


def test_windows_of_many_items(spark):
    items = [(i, "a b c d e f g h i j k") for i in range(300)] + [(None, "a b c d e f g h i j")]
    docs = [(1, "x a b c d e f g h i j k"), (2, "x"), (None, "a b c d e f g h i j")]
    got = {r.doc_id: r for r in contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got[1].item_ids == list(range(300)) == got[None].item_ids and got[1].n_hit == 11 and got[2].item_ids == []


def test_empty_tables_and_dropping(spark):
    docs = spark.createDataFrame([(1, "a b c", "k"), (2, None, "k"), (None, "a b c d", "k")], "doc_id long, text string, bad_id string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs.limit(0), none).count() == 0
    assert [r.contaminated for r in contamination(docs, none).collect()] == [False] * 3
    left = drop_contaminated(docs, spark.createDataFrame([(1, "b c")], "item_id long, text string"))
    assert [r.doc_id for r in left.collect()] == [2] and left.columns == docs.columns


def test_each_row_is_judged_by_its_own_text(spark):
    rows = [(None, "a clean text"), (None, "x a b c d"), (2, "another clean text"), (2, "a b c d y"), (3, None), (2, "another clean text"), (None, None)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, text_hash int")
    left = drop_contaminated(docs, spark.createDataFrame([(1, "a b c d")], "item_id long, text string"))
    assert sorted(map(repr, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(repr, (r for r in rows if "a b c d" not in (r[1] or ""))))
    assert left.columns == docs.columns
